"""Listing of picture files below a folder; Spark's own listing would skip names that begin with '_' and hidden folders."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from prismarium.functions.paths import IMAGE_EXTENSIONS
from prismarium.operators.files import group_files
from prismarium.session import Scratch

FILES = "path string, size long"


def is_image_name(name: str) -> bool:
    base, dot, extension = name.rpartition(".")
    return bool(base and dot) and not name.startswith(".") and extension.lower() in IMAGE_EXTENSIONS


def list_folder(folder: str) -> tuple[list[tuple[str, int]], list[str]]:
    """Pictures (path, size) in a folder and its subfolders. What can't be read is skipped, links are ignored, an unknown size is 0."""
    files, folders = [], []
    try:
        entries = list(os.scandir(folder))
    except OSError:
        return [], []
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            folders.append(e.path)
        elif e.is_file(follow_symlinks=False) and is_image_name(e.name):
            try:
                size = e.stat(follow_symlinks=False).st_size
            except OSError:
                size = 0
            files.append((e.path, size))
    return files, folders


def scan(spark: SparkSession, root: str, spread: int = 64) -> DataFrame:
    """(path, size) of all pictures below ``root``, an error if that is no folder.

    Tasks list level by level, until there are ``spread`` folders to share out; then each task walks its own. The driver
    sees at most so many names of folders.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                files, folders = list_folder(folder)
                yield pd.DataFrame([(*f, False) for f in files] + [(f, 0, True) for f in folders], columns=["path", "size", "folder"])

    scratch, found = Scratch(spark), None
    todo = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    while True:
        listed = scratch.save(todo.repartition(min(spread, max(1, todo.count()))).mapInPandas(level, FILES + ", folder boolean"))
        files = listed.where("not folder").select("path", "size")
        found = files if found is None else found.union(files)
        todo = listed.where("folder").select("path")
        some = todo.limit(spread).count()
        if some == 0:
            return found
        if some == spread:
            break

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in b["path"]:
                below = [start]
                while below:
                    files, folders = list_folder(below.pop())
                    below += folders
                    if files:
                        yield pd.DataFrame(files, columns=["path", "size"])

    return found.union(todo.repartition(todo.count()).mapInPandas(walk, FILES))


def scan_grouped(spark: SparkSession, root: str) -> DataFrame:
    return group_files(scan(spark, root))
