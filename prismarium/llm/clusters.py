"""Problem 4: groups of mutually similar vectors, their sizes and most typical members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismarium.llm import vectors as V
from prismarium.llm.linking import link
from prismarium.session import Scratch


def clusters(df: DataFrame, threshold: float = 0.75, least_size: int = 5, dim: int = 96, scratch: Scratch | None = None) -> DataFrame:
    """(cluster_id, member): groups of rows of ``df`` (id, embedding) joined by chains of pairs with a cosine of at least ``threshold``.

    Trees of cluster features per partition are merged, their leaves agglomerated by Ward's distance, and one pass assigns
    every row to the centres that result, around which exact pairs link rows (see `linking`). Groups of fewer than
    ``least_size`` rows are left out; cluster_id is the smallest member. Rows without a valid vector
    belong to no group; an empty table gives an empty result; other columns of ``df`` are ignored.
    """
    scratch = scratch or Scratch(df.sparkSession)
    groups = scratch.save(link(df.select("id", "embedding"), threshold, scratch, dim))
    large = groups.groupBy(F.col("grp").alias("cluster_id")).agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    return groups.withColumnRenamed("grp", "cluster_id").join(large, "cluster_id").select("cluster_id", F.col("id").alias("member"), "size")


def describe(df: DataFrame, members: DataFrame, top: int = 3, dim: int = 96) -> DataFrame:
    """(cluster_id, size, rank, member, similarity): the ``top`` members most similar to their cluster's mean, the smaller id first on ties.

    Means are summed per task before they are brought together, so a cluster may hold any share of the rows.
    """

    def sums(key: int, col: int, count: int | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column(key).to_numpy()
                if count is None:
                    at, values = V.matrix(b.column(col), dim)
                    keys, values, n = keys[at], V.unit(values, np.float64), np.ones(len(at), np.int64)
                else:
                    values, n = V.raw(b.column(col))[0].view(np.float64).reshape(-1, dim), b.column(count).to_numpy()
                found, inverse = np.unique(keys, return_inverse=True)
                total = np.zeros((len(found), dim))
                np.add.at(total, inverse, values)
                many = np.zeros(len(found), np.int64)
                np.add.at(many, inverse, n)
                for c, t, m in zip(found.tolist(), total, many.tolist()):
                    have = held.setdefault(c, [np.zeros(dim), 0])
                    have[0] += t
                    have[1] += m
                if len(held) > 50_000:
                    yield batch(held)
                    held = {}
            if held:
                yield batch(held)

        def batch(held: dict[int, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), V.binary(np.array([x[0] for x in held.values()])), pa.array([x[1] for x in held.values()])], ["cluster_id", "total", "n"])

        return run

    ddl = "cluster_id long, total binary, n long"
    joined = df.select(F.col("id").alias("member"), "embedding").join(members.select("member", "cluster_id", "size"), "member")
    means = joined.select("cluster_id", "embedding").mapInArrow(sums(0, 1), ddl).repartition("cluster_id").mapInArrow(sums(0, 1, 2), ddl)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, values = V.matrix(b.column(2), dim)
                mean = V.unit(V.raw(b.column(3))[0].view(np.float64).reshape(-1, dim)[at], np.float64)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(4).take(rows), pa.array((V.unit(values, np.float64) * mean).sum(1))], ["cluster_id", "member", "size", "similarity"])

    scored = joined.join(means, "cluster_id").select("cluster_id", "member", "embedding", "total", "size").mapInArrow(score, "cluster_id long, member long, size long, similarity double")
    order = Window.partitionBy("cluster_id").orderBy(F.round("similarity", 9).desc(), "member")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster_id", "size", "rank", "member", F.round("similarity", 6).alias("similarity"))
