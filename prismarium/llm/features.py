"""Mergeable trees of cluster features: (count, vector sum) of rows that lie close together.

A tree holds a bounded number of leaf features however many rows it has taken in: when there are too many, its
radius grows and the leaves are put into a new tree. Trees built per partition are merged in a reduction tree,
so what travels is leaf summaries. `agglomerate` joins leaves by Ward's distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismarium.llm import vectors as V

#: Leaves of a tree, leaves below an inner node, and trees merged into one by a task, at most.
LEAVES, FAN_OUT, FAN_IN = 512, 32, 16
#: Cosine to a leaf's mean from which on a row belongs to it, at first, and how it falls when leaves are too many.
CLOSENESS, SHRINK = 0.95, 0.92
#: Rows put into a tree at once.
CHUNK = 1024
LEAF_DDL = "n double, total binary"


class FeatureTree:
    """Leaf features below inner nodes; a row descends to the nearest node and to the nearest leaf there."""

    def __init__(self, dim: int, leaves: int = LEAVES):
        self.dim, self.most, self.closeness = dim, leaves, CLOSENESS
        self._clear()

    def _clear(self) -> None:
        self.n, self.total, self.node = np.zeros(0), np.zeros((0, self.dim)), np.zeros(0, np.int64)
        self.inner = np.zeros((0, self.dim))

    def add(self, totals: np.ndarray, n: np.ndarray) -> None:
        """Takes in features; rows are features of one unit vector."""
        for x in range(0, len(n), CHUNK):
            self._insert(totals[x : x + CHUNK], n[x : x + CHUNK])
            while len(self.n) > self.most:
                self.closeness *= SHRINK
                n_, total = self.n, self.total
                order = np.argsort(-n_, kind="stable")
                self._clear()
                for y in range(0, len(order), CHUNK):
                    self._insert(total[order[y : y + CHUNK]], n_[order[y : y + CHUNK]])

    def _insert(self, totals: np.ndarray, n: np.ndarray) -> None:
        units = V.unit(totals)
        leaf = np.full(len(n), -1)
        if len(self.n):
            at = (units @ V.unit(self.inner).T).argmax(1)
            means = V.unit(self.total)
            for k in np.unique(at):
                rows, below = np.flatnonzero(at == k), np.flatnonzero(self.node == k)
                s = units[rows] @ means[below].T
                best = s.argmax(1)
                good = s[np.arange(len(rows)), best] >= self.closeness
                leaf[rows[good]] = below[best[good]]
            taken = np.flatnonzero(leaf >= 0)
            np.add.at(self.total, leaf[taken], totals[taken])
            np.add.at(self.n, leaf[taken], n[taken])
            np.add.at(self.inner, self.node[leaf[taken]], totals[taken])
        rest = np.flatnonzero(leaf < 0)
        if not len(rest):
            return
        near = units[rest] @ units[rest].T >= self.closeness
        owner = np.full(len(rest), -1)
        for i in range(len(rest)):  # the first free row opens a leaf and takes the free rows close to it
            if owner[i] < 0:
                owner[(owner < 0) & near[i]] = i
        heads, inverse = np.unique(owner, return_inverse=True)
        total, count = np.zeros((len(heads), self.dim)), np.zeros(len(heads))
        np.add.at(total, inverse, totals[rest])
        np.add.at(count, inverse, n[rest])
        self._attach(total, count)

    def _attach(self, total: np.ndarray, n: np.ndarray) -> None:
        """New leaves go below the nearest inner node; a node with too many leaves is split around two of them that lie far apart."""
        if not len(self.inner):
            self.inner = total[:1] * 0 + total.sum(0)
        node = (V.unit(total) @ V.unit(self.inner).T).argmax(1)
        np.add.at(self.inner, node, total)
        self.n, self.total, self.node = np.concatenate([self.n, n]), np.concatenate([self.total, total]), np.concatenate([self.node, node])
        full = [k for k in np.unique(self.node).tolist() if (self.node == k).sum() > FAN_OUT]
        while full:
            k = full.pop()
            below = np.flatnonzero(self.node == k)
            if len(below) <= FAN_OUT:
                continue
            units = V.unit(self.total[below])
            a = int((units @ units[0]).argmin())
            b = int((units @ units[a]).argmin())
            to_b = units @ units[b] > units @ units[a]
            to_b[b] = True
            to_b[a] = False
            new = len(self.inner)
            self.node[below[to_b]] = new
            self.inner = np.concatenate([self.inner, self.total[below[to_b]].sum(0, keepdims=True)])
            self.inner[k] = self.total[below[~to_b]].sum(0)
            full += [k, new]


def leaves(df: DataFrame, dim: int, most: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """(vector sums, counts) of the leaf features of all valid rows of ``df`` (id, embedding): a tree per partition, merged by a reduction tree.

    At most ``most`` leaves reach the driver; every row has been taken in.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = FeatureTree(dim, most)
        for b in batches:
            values = V.matrix(b.column(1), dim)[1]
            if len(values):
                tree.add(V.unit(values).astype(np.float64), np.ones(len(values)))
        if len(tree.n):
            yield pa.RecordBatch.from_arrays([pa.array(tree.n), V.binary(tree.total)], ["n", "total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = FeatureTree(dim, most)
        for b in batches:
            if b.num_rows:
                tree.add(V.raw(b.column(b.num_columns - 1))[0].view(np.float64).reshape(-1, dim), b.column(b.num_columns - 2).to_numpy())
        if len(tree.n):
            yield pa.RecordBatch.from_arrays([pa.array(tree.n), V.binary(tree.total)], ["n", "total"])

    df = df.select("id", "embedding")
    trees = df.rdd.getNumPartitions()
    found = df.mapInArrow(build, LEAF_DDL)
    while trees > 1:
        trees = -(-trees // FAN_IN)
        found = found.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(trees))).select("at", "n", "total").repartition(trees, "at").mapInArrow(merge, LEAF_DDL)
    got = found.toArrow()
    if not len(got):
        return np.zeros((0, dim)), np.zeros(0)
    return V.raw(got["total"].combine_chunks())[0].view(np.float64).reshape(-1, dim).copy(), got["n"].to_numpy()


def agglomerate(totals: np.ndarray, n: np.ndarray, count: int) -> np.ndarray:
    """Joins features, the two with the least Ward distance first, until ``count`` are left; gives the position of the first feature of each one's cluster."""
    label = np.arange(len(n))
    if len(n) <= count:
        return label
    n = n.astype(np.float64).copy()
    means = totals / n[:, None]
    square = (means**2).sum(1)
    cost = np.maximum(square[:, None] + square[None, :] - 2 * means @ means.T, 0) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(n) - count):
        i, j = divmod(int(cost.argmin()), len(n))
        i, j = min(i, j), max(i, j)
        together = cost[i, j]
        with np.errstate(invalid="ignore"):
            row = ((n[i] + n) * cost[i] + (n[j] + n) * cost[j] - n * together) / (n[i] + n[j] + n)
        n[i] += n[j]
        row[[i, j]] = np.inf
        row[~np.isfinite(row)] = np.inf
        cost[i], cost[:, i] = row, row
        cost[j], cost[:, j] = np.inf, np.inf
        label[label == j] = i
    return label
