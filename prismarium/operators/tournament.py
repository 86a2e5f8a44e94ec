"""Planned in the original, not built there: a knock-out tournament among similar pictures, and groups by a similarity threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismarium.operators.components import connected_components, union_labels
from prismarium.operators.grouped import by_group
from prismarium.operators.ranges import numbered
from prismarium.session import Scratch

DEFAULT_THRESHOLD = 0.92
#: Rows of a block of vectors, about; a task compares one block with one. Rows of a matrix product.
BLOCK, AT_ONCE = 20_000, 500


def first_round(entries: DataFrame) -> DataFrame:
    """(group_id, match, a, b) of ``entries`` (group_id, id, seed): the best seed meets the last; with an odd number the best has a bye (b is null)."""
    ranked = numbered(entries.select("group_id", "id", "seed"), "group_id", ["seed", "id"], "r", "n")
    odd = F.col("n") % 2
    match = F.when((odd == 1) & (F.col("r") == 1), F.lit(0)).otherwise(F.least(F.col("r") - odd, F.col("n") - F.col("r") + 1))
    return ranked.withColumn("match", match).groupBy("group_id", "match").agg(F.min_by("id", "r").alias("a"), F.when(F.count("*") > 1, F.max_by("id", "r")).alias("b"))


def advance(matches: DataFrame, winners: DataFrame) -> DataFrame:
    """Entries of the next round: the winners (group_id, match, id), byes included, seeded by their match. Undoing a round is asking with the matches before."""
    won = matches.join(winners, ["group_id", "match"], "left")
    return won.where("b is null or id is not null").select("group_id", F.when(F.col("b").isNull(), F.col("a")).otherwise(F.col("id")).alias("id"), F.col("match").alias("seed"))


def threshold_groups(pairs: DataFrame, threshold: float = DEFAULT_THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """(id, group_id) from pairs (a, b, similarity) at or above the threshold; what has no such pair is alone and left out."""
    scratch = scratch or Scratch(pairs.sparkSession)
    roots = connected_components(pairs.where(F.col("similarity") >= threshold), "a", "b", scratch)
    return roots.select(F.col("node").alias("id"), F.col("root").alias("group_id")).union(roots.select("root", "root").distinct())


def cosine_groups(vectors: DataFrame, dim: int, threshold: float = DEFAULT_THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """(id, group_id) of vectors (id, embedding) joined by chains of cosines at or above the threshold; singletons are left out.

    Every pair of blocks is one task's work and gives at most one link per row, so similar pairs are never listed. Null vectors, zero
    ones and ones of another length or with values that are not finite are alone.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    good = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good & F.col("id").isNotNull()).select("id", "embedding")
    blocks = max(1, -(-rows.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    # A block meets itself and each later one: as the first of a pair, and as the second.
    first = rows.select(F.explode(F.transform(F.sequence(own, F.lit(blocks - 1).cast("long")), lambda j: own * blocks + j)).alias("cell"), F.lit(True).alias("first"), "id", "embedding")
    later = rows.where(own > 0).select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), own - 1), lambda i: i * blocks + own)).alias("cell"), F.lit(False).alias("first"), "id", "embedding")

    def compare(bounds: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for start, end in zip(bounds, bounds[1:]):
            part = b.slice(start, end - start)
            v = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            length = np.sqrt((v * v).sum(1))
            keep = np.flatnonzero(length > 0)
            ids, v, lead = part.column(2).to_numpy()[keep], v[keep] / length[keep, None], part.column(1).to_numpy(zero_copy_only=False)[keep]
            a = np.flatnonzero(lead)
            c = np.flatnonzero(~lead) if not lead.all() else a
            label = np.arange(len(ids))
            for x in range(0, len(a), AT_ONCE):
                hit = np.round(v[a[x : x + AT_ONCE]] @ v[c].T, 9) >= threshold
                while True:  # one link per column, then what is still apart
                    cols = np.flatnonzero(hit.any(0))
                    if not len(cols):
                        break
                    label = union_labels(len(ids), *(np.concatenate(p) for p in ((np.arange(len(ids)), label[c[cols]]), (label, label[a[x + hit[:, cols].argmax(0)]]))))
                    hit &= label[a[x : x + AT_ONCE]][:, None] != label[c][None, :]
            moved = np.flatnonzero(label != np.arange(len(ids)))
            left.append(ids[moved])
            right.append(ids[label[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    cells = first.union(later).repartition("cell").sortWithinPartitions("cell")
    roots = connected_components(cells.mapInArrow(by_group(0, compare), "a long, b long"), "a", "b", scratch)
    return roots.select(F.col("node").alias("id"), F.col("root").alias("group_id")).union(roots.select("root", "root").distinct())
