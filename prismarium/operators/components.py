"""Connected components of an edge table, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismarium.session import Scratch


def union_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b), the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of one partition become stars around their components' smallest nodes."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = union_labels(len(ids), flat[: len(u)], flat[len(u) :])
    keep = label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[label[keep]])], ["node", "root"])


#: A root with more links than this is spread over several partitions.
HOT_ROOT = 1_000_000


def _meeting(now: DataFrame, size: int) -> DataFrame:
    """(node, root, at): every edge at both its ends. Links of a hot root are spread by their other end, and what is known of the root itself goes to all its places."""
    ends = F.explode(F.array(F.struct(F.col("node").alias("end"), F.col("root").alias("other")), F.struct(F.col("root").alias("end"), F.col("node").alias("other")))).alias("e")
    sent = now.select("node", "root", ends).select("node", "root", "e.end", "e.other")
    if size <= HOT_ROOT:
        return sent.select("node", "root", F.col("end").alias("at"))
    many = now.groupBy("root").count().where(F.col("count") > HOT_ROOT).select(F.col("root").alias("end"), F.ceil(F.col("count") / HOT_ROOT).alias("places"))  # at most size / HOT_ROOT rows
    placed = sent.join(F.broadcast(many), "end", "left")
    own = F.pmod(F.xxhash64("other"), F.col("places"))
    below = F.col("root") == F.col("end")  # a link of the hot root; else the root's own link to a smaller one
    at = F.when(F.col("places").isNull(), F.array(F.lit(0).cast("long"))).when(below, F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("places") - 1))
    return placed.select("node", "root", F.explode(at).alias("place"), "end").select("node", "root", F.when(F.col("place") == 0, F.col("end")).otherwise(F.xxhash64("end", "place")).alias("at"))


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that is not the smallest id of its component.

    Each round sends every edge to the partitions of both its ends, where a vectorised union-find turns
    the edges met there into stars; the rounds end when the set of stars no longer changes. Self loops,
    repeated edges and edges with a null end are ignored; an empty edge table gives an empty result.
    Callers pass one node per locally linked group, not per row, so that a group holding a
    third of all rows is already collapsed.
    """
    both = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
        .distinct()
    )
    before, now = None, both
    while True:  # labels only get smaller, so this ends
        sent = _meeting(now, before[0] if before else 0).repartition("at")
        stars = sent.select("node", "root").mapInArrow(_stars, "node long, root long").distinct()
        saved = scratch.save(stars)
        mark = saved.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = saved
        if mark == before:
            return now
        before = mark
