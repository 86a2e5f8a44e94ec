"""What the vector operators share: usable rows, compact encoding, the hash-prefix forest.

Every tree of the forest has its own centres, fitted on a bounded sample of the rows. The hash string of a row in a
tree names the centres in order of similarity; the tree is the array of all rows sorted by their strings, and
rows that share a prefix lie together in it. All rows are counted by prefix, and a prefix that holds too many
rows is continued by further digits, so prefixes are as long as the rows below them are many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismarium.operators.components import union_labels

#: Rows to a centre of a tree, about, and rows of the sample that a centre needs at least.
CELL_ROWS, SAMPLED_PER_CENTRE = 400, 30
#: Beyond so many centres a tree gets more only for so many rows each: the more centres, the more lie near a row, which visits them all.
FEW_CENTRES, WIDE_CELL = 12, 24_000
#: Rows in the sample that gives centres, about; its size never exceeds twice this.
SAMPLE_ROWS = 24_000
#: A prefix with more rows than this gets longer, up to so many digits.
HOT_ROWS, DIGITS = 48_000, 5
#: Steps of an ascent at most.
PROBES = 8
#: Centres with a cosine from here on divide one dense group.
DENSE = 0.93
#: Rows of a block of a similarity matrix.
BLOCK = 256


def usable_face() -> Column:
    """Confidence >= 0 and a box that is not all zero; a null corner counts as zero. Vectors are tested in `decode`."""
    box = [F.coalesce(F.col(f"bbox_{c}"), F.lit(0.0)) != 0 for c in ("x1", "y1", "x2", "y2")]
    return (F.col("confidence") >= 0) & (box[0] | box[1] | box[2] | box[3]) & F.col("id").isNotNull()


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list column: the rows that hold ``dim`` finite numbers, not all zero; their values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    at = np.concatenate([[0], np.cumsum(length)])[:-1]
    rows = np.flatnonzero(length == dim)
    values = flat.reshape(-1, dim) if len(rows) * dim == len(flat) else flat[at[rows][:, None] + np.arange(dim)]
    good = np.isfinite(values).all(1) & (values != 0).any(1)
    return rows[good], values[good]


def unit(values: np.ndarray, kind: type = np.float32) -> np.ndarray:
    values = values.astype(kind)
    peak = np.abs(values).max(1, keepdims=True)
    values = values / np.where(peak > 0, peak, 1)  # so that very large values don't overflow when squared
    norm = np.sqrt((values * values).sum(1, keepdims=True))
    return values / np.where(norm > 0, norm, 1)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row of a 2-d array."""
    size = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def pack_exact(values: np.ndarray) -> pa.Array:
    """Each row as half floats where that loses nothing, else as floats; `unpack_exact` gives the same values back."""
    with np.errstate(over="ignore"):
        half = values.astype(np.float16)
    same = (half.astype(np.float32) == values).all(1)
    if same.all():
        return binary(half)
    return pa.array([h.tobytes() if s else v.tobytes() for h, v, s in zip(half, values.astype(np.float32), same)], pa.binary())


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where its rows begin (and end)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def unpack_exact(column: pa.Array, dim: int) -> np.ndarray:
    data, at = raw(column)
    size = np.diff(at)
    if (size == 2 * dim).all():
        return data.view(np.float16).reshape(-1, dim).astype(np.float32)
    return np.array([np.frombuffer(data[a:b].tobytes(), np.float16 if b - a == 2 * dim else np.float32) for a, b in zip(at, at[1:])], np.float32).reshape(-1, dim)


def pack_small(units: np.ndarray) -> pa.Array:
    """Unit rows as bytes scaled by their largest value; the cosine of two such rows is within 0.01 of the true one."""
    return binary(np.rint(units * (127 / np.abs(units).max(1, keepdims=True))).astype(np.int8))


def unpack_small(column: pa.Array, dim: int) -> np.ndarray:
    return unit(raw(column)[0].view(np.int8).reshape(-1, dim))


@dataclass
class Tree:
    """One sorted array of the forest: its centres, which of them form one cell, and what is known of its prefixes.

    The hash string of a row names the tree's cells in order of the row's similarity to them, up to ``DIGITS`` of them.
    ``sizes`` holds the exact number of rows below each prefix of one digit, ``hot`` per length the prefixes that hold
    more than HOT_ROWS rows and are therefore continued by another digit.
    """

    centres: np.ndarray
    owner: np.ndarray
    dense: np.ndarray
    sizes: np.ndarray
    hot: list[np.ndarray]

    def strings(self, units: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``most`` digits of each row's hash string (cell numbers), and the similarities that order them."""
        s = units @ self.centres.T
        if len(self.dense) < len(self.owner):
            s = np.maximum.reduceat(s, np.searchsorted(self.owner, np.arange(len(self.dense))), axis=1)
        most = min(most, s.shape[1])
        if most == 1:
            first = s.argmax(1)[:, None]
            return first, np.take_along_axis(s, first, 1)
        digits = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        value = np.take_along_axis(s, digits, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        return np.take_along_axis(digits, order, 1), np.take_along_axis(value, order, 1)

    def prefixes(self, digits: np.ndarray, length: int | None = None) -> np.ndarray:
        """Descends: the number of each string's shortest prefix that is not hot (or of the given length, 0 where a shorter one is not hot)."""
        wide = len(self.dense) + 1
        code = digits[:, 0].astype(np.int64) + 1
        for level in range(1, digits.shape[1]):
            if length == level or level > len(self.hot):
                break
            go = np.isin(code, self.hot[level - 1])
            code = np.where(go, code * wide + digits[:, level] + 1, code if length is None else 0)
        return code


class Forest:
    """Trees fitted on a bounded sample of unit vectors; every row is indexed, and counted exactly by `counted`.

    A tree has one centre per CELL_ROWS rows, at least four, beyond FEW_CENTRES one per WIDE_CELL rows, and no more than its sample can place. Centres that lie
    closer to each other than DENSE form one cell: they divide one dense group, which no prefix cuts well.
    """

    def __init__(self, centres: list[np.ndarray], dense: float | None = None):
        self.trees = []
        for c in centres:
            label = linked_labels(c, DENSE if dense is None else dense)
            heads, owner, many = np.unique(label, return_inverse=True, return_counts=True)
            order = np.argsort(owner, kind="stable")
            self.trees.append(Tree(c[order], owner[order], many > 1, np.zeros(len(heads), np.int64), []))

    @staticmethod
    def fit(sample: np.ndarray, rows: int, trees: int, seed: int = 7) -> Forest:
        if not len(sample):
            return Forest([])
        count = int(min(max(4, min(rows // CELL_ROWS, max(FEW_CENTRES, rows // WIDE_CELL))), max(4, len(sample) // SAMPLED_PER_CENTRE), len(sample)))
        return Forest([centroids(sample, count, seed + t) for t in range(trees)])

    def counted(self, df: DataFrame, dim: int) -> Forest:
        """Counts all rows of (id, embedding) by prefix: one digit for all, one more for what lies below a hot prefix.

        What is kept is bounded: a number per cell, and a number per prefix with more than HOT_ROWS rows.
        """
        spark = df.sparkSession
        for length in range(1, DIGITS + 1):
            shared = spark.sparkContext.broadcast(self)

            def count(batches: Iterator[pa.RecordBatch], length: int = length) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    _, values = matrix(b.column(1), dim)
                    if len(values):
                        for t, tree in enumerate(shared.value.trees):
                            code = tree.prefixes(tree.strings(unit(values), length)[0], length)
                            found, n = np.unique(code[code > 0], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t, np.int32)), pa.array(found), pa.array(n)], ["tree", "code", "n"])

            sums = df.select("id", "embedding").mapInArrow(count, "tree int, code long, n long").groupBy("tree", "code").agg(F.sum("n").alias("n"))
            got = (sums if length == 1 else sums.where(F.col("n") > HOT_ROWS)).toArrow()
            shared.unpersist()
            t, code, n = (got[c].to_numpy() for c in ("tree", "code", "n"))
            for k, tree in enumerate(self.trees):
                if length == 1:
                    tree.sizes[code[t == k] - 1] = n[t == k]
                    hot = np.flatnonzero((tree.sizes > HOT_ROWS) & ~tree.dense) + 1
                else:
                    hot = np.sort(code[t == k])
                tree.hot.append(hot)
            if not any(len(tree.hot[-1]) for tree in self.trees):
                break
        return self

    def visits(self, units: np.ndarray, margin: float, enough: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Per tree and step of the ascent: (rows, prefix number). Step 0 is each row's own prefix.

        A row ascends in all trees at once, each step adding to every tree the prefix that begins with the row's next
        digit, until the prefixes hold ``enough`` rows together; prefixes within ``margin`` of the best are added in any case.
        """
        read = [tree.strings(units, PROBES + DIGITS) for tree in self.trees]
        out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.trees]
        held = np.zeros(len(units), np.int64)
        for step in range(PROBES):
            short = held < enough
            gone = 0
            for t, (tree, (digits, value)) in enumerate(zip(self.trees, read)):
                if step >= digits.shape[1]:
                    gone += 1
                    continue
                rows = np.flatnonzero(short | (value[:, step] >= value[:, 0] - margin))
                string = np.concatenate([digits[rows, step : step + 1], digits[rows, :step], digits[rows, step + 1 :]], axis=1)[:, :DIGITS]
                out[t].append((rows, tree.prefixes(string)))
                if not step:  # the parts of a hot prefix share rows with their neighbours, as its rows visit the part beginning with their next digit
                    for level in range(1, min(len(tree.hot), string.shape[1] - 2) + 1):
                        below = np.flatnonzero(np.isin(tree.prefixes(string, level), tree.hot[level - 1]))
                        turned = string[below].copy()
                        turned[:, [level, level + 1]] = turned[:, [level + 1, level]]
                        if len(below):
                            out[t].append((rows[below], tree.prefixes(turned)))
                held[rows] += tree.sizes[digits[rows, step]]
            if gone == len(self.trees):
                break
        return out


def centroids(sample: np.ndarray, count: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Unit means that divide the sample: a few rounds of reassigning from drawn rows on."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(sample[x : x + 8192] @ centres.T).argmax(1) for x in range(0, len(sample), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, at, sample)
        used = (np.abs(total) > 1e-9).any(1)
        centres[used] = unit(total[used])
    return centres


def sample_units(df: DataFrame, dim: int, rows: int, seed: int = 7) -> np.ndarray:
    """Unit vectors of a sample of (id, embedding), chosen by a hash of the id: about SAMPLE_ROWS rows, whatever the table's size."""
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    picked = df if share >= 1 else df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pack_small(unit(values)) if len(at) else pa.array([], pa.binary())], ["id", "v"])

    got = picked.select("id", "embedding").mapInArrow(small, "id long, v binary").toArrow().sort_by("id")
    if not len(got):
        return np.zeros((0, dim), np.float32)
    return unpack_small(got["v"].combine_chunks(), dim)[: 2 * SAMPLE_ROWS]


def linked_labels(units: np.ndarray, least: float, own: int | None = None) -> np.ndarray:
    """For each row the first row of its group, groups being joined by pairs with a cosine of at least ``least``, one of each among the first ``own`` rows if given.

    Pairs are used block by block and never kept, so a cell in which everything is similar needs no more memory: of a
    dense block every column gives one link, and only hits between rows that are still apart are looked at again.
    """
    n = len(units)
    label = np.arange(n)
    own = n if own is None else own
    for start in range(0, own, BLOCK):
        hit = units[start : min(start + BLOCK, own)] @ units[start:].T >= least
        rows = np.arange(start, start + len(hit))
        while True:
            if np.count_nonzero(hit) <= 8 * hit.shape[1]:
                i, j = np.divmod(np.flatnonzero(hit), hit.shape[1])
                label = _joined(label, rows[i], j + start)
                break
            j = np.flatnonzero(hit.any(0))
            label = _joined(label, rows[hit[:, j].argmax(0)], j + start)
            hit &= label[rows][:, None] != label[None, start:]
    return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = label[a], label[b]
    apart = a != b
    return union_labels(len(label), a[apart], b[apart])[label] if apart.any() else label
