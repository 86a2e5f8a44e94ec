"""Copying files into dated folders after a plan."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismarium.functions.paths import parent
from prismarium.operators.files import name_copies, target_dir
from prismarium.sources.content import extract_metadata
from prismarium.sources.scan import scan


def plan_copies(sources: DataFrame, destination: str, pattern: str, existing: DataFrame | None = None, keep_below: str | None = None) -> DataFrame:
    """(source, target) for ``sources`` (seq, path) below a destination, which must be a folder.

    With ``keep_below``, sources below that folder keep their place below it instead of going to dated folders.
    """
    if not os.path.isdir(destination):
        raise NotADirectoryError(destination)
    spark = sources.sparkSession
    dated = sources.select("seq", F.col("path").alias("source"), F.lit(None).cast("string").alias("taken"))
    if pattern:
        read = extract_metadata(sources.select("path")).select(F.col("path").alias("source"), F.date_format(F.timestamp_seconds("taken_at"), "yyyy:MM:dd HH:mm:ss").alias("taken"))
        dated = dated.drop("taken").join(read.dropDuplicates(["source"]), "source", "left")
    if existing is None:
        existing = scan(spark, destination)
    where = target_dir(destination, pattern, "taken")
    if keep_below is not None:
        root = keep_below.rstrip("/") + "/"
        inside = F.substring(parent("source"), len(root) + 1, 1 << 20)
        where = F.when(F.startswith("source", F.lit(root)), F.when(inside == "", F.lit(destination)).otherwise(F.concat_ws("/", F.lit(destination), inside))).otherwise(where)
    return name_copies(dated.select(where.alias("dir"), "source", "seq"), existing)


def copy_files(plan: DataFrame, verify: bool = False) -> DataFrame:
    """(source, target, error) after copying each file of a plan; one that fails does not stop the others. ``verify`` compares contents afterwards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import filecmp

        for b in batches:
            errors = []
            for source, target in zip(b["source"], b["target"]):
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    shutil.copyfile(source, target)
                    errors.append(None if not verify or filecmp.cmp(source, target, shallow=False) else "the copy differs")
                except OSError as e:
                    errors.append(str(e)[:200])
            yield b.assign(error=pd.Series(errors, dtype=object, index=b.index))

    return plan.select("source", "target").mapInPandas(run, "source string, target string, error string")


def watched(results: DataFrame, total: int, on_progress: Callable[[int, int, str], None]) -> list[tuple[str, str, str | None]]:
    """Runs the copies of `copy_files` and tells (done, total, source) after each, as results come in partition by partition."""
    out = []
    for done, r in enumerate(results.toLocalIterator(prefetchPartitions=True), 1):
        on_progress(done, total, r.source)
        out.append((r.source, r.target, r.error))
    return out


def summarize(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull()).alias("copied"), F.count_if(F.col("error").isNotNull()).alias("failed"))
