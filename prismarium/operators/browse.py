"""Browsing a folder before an import: which groups are new, and what became of them while someone went through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismarium.operators.seen import flags
from prismarium.sources.content import hash_files
from prismarium.sources.scan import scan_grouped


def scan_with_flags(spark: SparkSession, root: str, imported: DataFrame, rejected: DataFrame, tasks: int | None = None) -> DataFrame:
    """Groups below ``root`` with the display file's hash and whether the seen sets (hash) hold it. Files are hashed in ``tasks`` tasks."""
    groups = scan_grouped(spark, root)
    shown = groups.select("display.path", "display.size")
    hashed = hash_files(shown.repartition(tasks) if tasks else shown)
    return flags(groups.join(hashed.select(F.col("path").alias("_p"), "hash"), F.col("display.path") == F.col("_p"), "left").drop("_p"), imported, rejected)


def decisions(log: DataFrame, images: DataFrame) -> DataFrame:
    """(session, idx, selected, rejected) after a log (session, seq, idx, action) over images (session, idx, imported, rejected).

    'toggle' selects an image or takes that back; selecting clears a rejection. 'leave' rejects an image that is neither selected
    nor imported. Images without any action keep their state.
    """
    w = Window.partitionBy("session", "idx").orderBy("seq")
    known = log.join(images.select("session", "idx", F.col("imported").alias("_imported")), ["session", "idx"])
    on = F.sum(F.when(F.col("action") == "toggle", 1).otherwise(0)).over(w) % 2 == 1
    steps = known.withColumn("on", on)
    last = steps.groupBy("session", "idx").agg(
        F.max_by("on", "seq").alias("selected"),
        F.max(F.when((F.col("action") == "toggle") & F.col("on"), F.col("seq"))).alias("chosen"),
        F.max(F.when((F.col("action") == "leave") & ~F.col("on") & ~F.col("_imported"), F.col("seq"))).alias("left"),
    )
    state = images.join(last, ["session", "idx"], "left")
    was = F.col("rejected") & F.col("chosen").isNull()
    now = F.col("left").isNotNull() & (F.col("chosen").isNull() | (F.col("left") > F.col("chosen")))
    return state.select("session", "idx", F.coalesce("selected", F.lit(False)).alias("selected"), (was | now).alias("rejected"))


def with_results(infos: DataFrame, results: DataFrame) -> DataFrame:
    """What was to be copied (position, ...) beside what came of it (position, dest, error)."""
    return infos.join(results.select("position", "dest", "error"), "position")
