"""Groups of files that belong to one shot, copy plans, and reconciliation with the library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismarium.functions import ascii_lower
from prismarium.functions.dates import exif_fields, folder
from prismarium.functions.paths import basename, is_raw, order_key, parent, stem
from prismarium.operators.grouped import by_group


def group_files(files: DataFrame) -> DataFrame:
    """Files (path, size) of one folder and stem (in any case of A to Z) as struct display and array companions.

    The display file is the first, by parts of its path, that is not raw, or else the first; the others follow
    in that order. A null path is left out.
    """
    keyed = files.where("path is not null").select(parent("path").alias("dir"), ascii_lower(stem("path")).alias("stem"), F.struct(is_raw("path").alias("raw"), order_key("path").alias("parts"), "path", "size").alias("f"))
    grouped = keyed.groupBy("dir", "stem").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    rest = F.sort_array(F.transform(F.slice("fs", 2, F.greatest(F.size("fs"), F.lit(1))), lambda f: F.struct(f["parts"].alias("parts"), f["path"].alias("path"), f["size"].alias("size"))))
    thin = lambda f: F.struct(f["path"].alias("path"), f["size"].alias("size"))
    return grouped.select("dir", "stem", thin(F.element_at("fs", 1)).alias("display"), F.transform(rest, thin).alias("companions"))


def paths_for_copy(groups: DataFrame, mode: str) -> DataFrame:
    """One row per path to copy: mode all, raw_only (the display file where a group has no raw companion) or display_only."""
    raws = F.filter("companions", lambda c: is_raw(c["path"]))
    chosen = {
        "all": F.concat(F.array("display"), F.col("companions")),
        "raw_only": F.when(F.size(raws) > 0, raws).otherwise(F.array("display")),
        "display_only": F.array("display"),
    }[mode]
    return groups.select(F.col("display.path").alias("display_path"), F.explode(chosen).alias("f")).select("display_path", F.col("f.path").alias("path"), F.col("f.size").alias("size"))


def target_dir(destination: str, pattern: str, taken: Column | str) -> Column:
    """The destination, or a folder below it named after the camera's date where there are both a pattern and a date."""
    if not pattern:
        return F.lit(destination)
    sub = folder(exif_fields(taken), pattern)
    return F.when(sub.isNotNull() & (sub != ""), F.concat_ws("/", F.lit(destination), sub)).otherwise(F.lit(destination))


def name_copies(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, target): ``plan`` (source, dir, seq) gets the first free of name, name_1, name_2, ... in its folder, in the order of seq.

    ``existing`` (path) holds the files there. Naming is sequential within one folder and name, as an earlier copy takes a
    name away from later ones; only stems that could meet share a task, not whole folders.
    """
    meet = lambda d, c: F.xxhash64(d, F.regexp_replace(ascii_lower(stem(c)), r"(_\d+)+$", ""))
    new = plan.select(meet(F.col("dir"), "source").alias("meet"), "dir", "source", "seq", F.lit(None).cast("string").alias("taken"))
    old = existing.select(meet(parent("path"), "path").alias("meet"), parent("path").alias("dir"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("seq"), basename("path").alias("taken"))

    def place(bounds: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        folders, sources, taken = (rows.column(k).to_pylist() for k in (1, 2, 4))
        out = []
        for start, end in zip(bounds, bounds[1:]):
            used = {(folders[i], taken[i]) for i in range(start, end) if sources[i] is None}
            counters: dict[tuple[str, str], int] = {}
            for i in range(start, end):
                if sources[i] is None:
                    continue
                name = sources[i].rpartition("/")[2]
                base, dot, ext = name.rpartition(".")
                if not base:
                    base, dot, ext = name, "", ""
                free, n = name, counters.get((folders[i], name), 0)
                while (folders[i], free) in used:
                    n += 1
                    free = f"{base}_{n}{dot}{ext}"
                counters[folders[i], name] = n
                used.add((folders[i], free))
                out.append((sources[i], f"{folders[i]}/{free}"))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(2)], ["source", "target"])

    ordered = new.union(old).repartition("meet").sortWithinPartitions("meet", "seq", "source")
    return ordered.mapInArrow(by_group(0, place), "source string, target string")


def merge_raw_rows(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, gone): a picture and a raw file of one folder and stem become the picture's row with raw_path.

    Of each group the first picture and the first raw file by id are merged; the raw rows' ids are ``gone``, and what
    hangs on them is to be deleted.
    """
    keyed = images.where("path is not null").select(parent("path").alias("dir"), ascii_lower(stem("path")).alias("stem"), "id", "path", is_raw("path").alias("raw"))
    pairs = keyed.groupBy("dir", "stem").agg(
        F.min(F.when(~F.col("raw"), F.col("id"))).alias("keep"),
        F.min(F.when(F.col("raw"), F.struct("id", "path"))).alias("raw"),
    ).where("keep is not null and raw is not null").select("keep", F.col("raw.id").alias("gone"), F.col("raw.path").alias("merged_path"))
    role = lambda c, kept: F.struct(F.col(c).alias("id"), F.lit(kept).alias("_kept"), F.col("merged_path").alias("_merged"))
    roles = pairs.select(F.explode(F.array(role("keep", True), role("gone", False))).alias("r")).select("r.*")  # one join for both roles
    rows = images.join(roles, "id", "left").where(F.coalesce("_kept", F.lit(True))).withColumn("raw_path", F.coalesce("_merged", "raw_path"))
    return rows.select(*images.columns), pairs.select(F.col("gone").alias("id"))


def reconcile(library: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, action, size, raw_path): mark_missing, mark_present or insert, where the library (path, status) and the groups on disk disagree.

    A path in the library several times is compared once per row's status; a new group's raw_path is its first companion.
    """
    disk = groups.select(F.col("display.path").alias("path"), F.col("display.size").alias("size"), F.try_element_at("companions", F.lit(1))["path"].alias("raw_path"), F.lit(True).alias("on_disk"))
    known = library.select("path", F.when(F.col("status") == "missing", "missing").otherwise("present").alias("status")).where("path is not null").distinct()
    both = known.join(disk, "path", "full_outer")
    action = F.when(F.col("status").isNull(), "insert").when(F.col("on_disk").isNull() & (F.col("status") == "present"), "mark_missing").when(F.col("on_disk") & (F.col("status") == "missing"), "mark_present")
    insert = action == "insert"
    return both.select("path", action.alias("action"), F.when(insert, F.col("size")).alias("size"), F.when(insert, F.col("raw_path")).alias("raw_path")).where("action is not null")


def companions_count(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.size("companions") > 0).alias("with_companions"))


def listing(images: DataFrame) -> DataFrame:
    """(path, size): the files that image rows speak of, their raw companions included."""
    own = images.where("path is not null").groupBy("path").agg(F.max("file_size").alias("size"))
    raw = images.where("raw_path is not null").select(F.col("raw_path").alias("path")).distinct().join(own.select("path"), "path", "left_anti").withColumn("size", F.lit(0).cast("long"))
    return own.unionByName(raw)


