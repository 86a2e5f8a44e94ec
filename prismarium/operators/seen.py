"""Which content was seen before: exact sets of 32-byte hashes and their bloom form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismarium.functions.bloom import PROBES, bits_for, position_column
from prismarium.operators.ranges import PART, ranged
from prismarium.session import Scratch


def duplicates(images: DataFrame) -> DataFrame:
    """(hash, copies, first_id) of every 32-byte hash that more than one row has."""
    return images.where(F.length("hash") == 32).groupBy("hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def flags(files: DataFrame, imported: DataFrame, rejected: DataFrame) -> DataFrame:
    """``files`` with imported and rejected: whether their hash is in the sets (exact; a null hash is in none)."""
    out = files
    for name, seen in (("imported", imported), ("rejected", rejected)):
        out = out.join(seen.select("hash", F.lit(True).alias(name)).where("hash is not null").distinct(), "hash", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def visible(flagged: DataFrame, hide_seen: bool = True) -> DataFrame:
    return flagged.where(~F.col("imported") & ~F.col("rejected")) if hide_seen else flagged


def bloom_table(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(word, mask): the set bits of the filter over ``hashes`` as 32-bit words, and its number of bits. The filter is a table, so it may be of any size."""
    bits = bits_for(hashes.count())
    at = hashes.where(F.length("hash") == 32).select(F.explode(position_column("hash", bits)).alias("p"))
    return at.groupBy(F.shiftrightunsigned("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("mask")), bits


def probably_seen(files: DataFrame, bloom: DataFrame, bits: int) -> DataFrame:
    """``files`` (with a unique id and hash) whose every probe hits a set bit."""
    probes = files.where(F.length("hash") == 32).select("id", F.explode(position_column("hash", bits)).alias("p"))
    hits = probes.withColumn("word", F.shiftrightunsigned("p", 5)).join(bloom, "word").where(F.col("mask").bitwiseAND(F.expr("shiftleft(1L, cast(p & 31 as int))")) != 0)
    found = hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == PROBES).select("id")
    return files.join(found, "id", "left_semi")


def parse_seen(files: DataFrame) -> DataFrame:
    """(path, seq, hash) of seen-set files (path, content): a version of 1, a count, then 32 bytes each, both numbers little-endian. A file that is short or of another version holds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes = read_seen(data or b"")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(hashes), pa.string()), pa.array(range(len(hashes)), pa.int64()), pa.array(hashes, pa.binary())], ["path", "seq", "hash"])

    return files.select("path", "content").mapInArrow(run, "path string, seq long, hash binary")


def read_seen(data: bytes) -> list[bytes]:
    if len(data) < 8:
        return []
    version, count = np.frombuffer(data, "<u4", 2).tolist()
    if version != 1 or len(data) < 8 + 32 * count:
        return []
    return [data[8 + 32 * k : 40 + 32 * k] for k in range(count)]


def write_seen(hashes: list[bytes]) -> bytes:
    """The file of a set: its entries in order, repeated ones kept."""
    return np.array([1, len(hashes)], "<u4").tobytes() + b"".join(hashes)


def neighbours_visible(files: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(folder, idx, previous_visible, next_visible): for every file (folder, idx, imported, rejected) the nearest ones that are not hidden.

    A folder may hold any share of the files: it is cut into ranges, and each range is told what lies before and behind it.
    """
    shown = F.when(~F.col("imported") & ~F.col("rejected"), F.col("idx"))
    placed, key = ranged(files.select("folder", "idx", shown.alias("shown")), ["folder"], ["idx"], scratch), ["folder", PART]
    w = Window.partitionBy(*key).orderBy("idx")
    before = F.last("shown", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("shown", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    # What the parts of a folder before and behind a part have to offer, one row per folder and part.
    ends, over = placed.groupBy(*key).agg(F.min("shown").alias("low"), F.max("shown").alias("high")), Window.partitionBy("folder").orderBy(PART)
    carried = ends.select(*key, F.max("high").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    return placed.withColumn("b", before).withColumn("a", after).alias("p").join(carried.alias("c"), (F.col("p.folder").eqNullSafe(F.col("c.folder"))) & (F.col(f"p.{PART}") == F.col(f"c.{PART}"))).select(
        "p.folder", "idx", F.coalesce("b", "_before").alias("previous_visible"), F.coalesce("a", "_after").alias("next_visible")
    )
