"""Problem 1: the k most similar vectors of every vector, by a hash-prefix forest.

1. The rows of each tree are brought together by the prefixes of their hash strings (`vectors.Forest`): a row lies
   below its own prefix, and visits further prefixes by ascending in all trees at once until it has met enough rows.
   Vectors travel as bytes here; what is found is only which rows may be near each other.
   Where many rows lie below a prefix, centres of its own part them within the task (`meetings`).
2. Every row's candidates are fetched to the prefix where the row lies in the first tree, its home. There each row is
   compared exactly, in double precision, with all rows of its home and all that were fetched to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismarium.llm import vectors as V
from prismarium.operators.grouped import by_group
from prismarium.session import Scratch

#: Trees, the rows an ascent has to meet (over all trees), and how near a prefix is visited in any case.
TREES, ENOUGH, MARGIN = 2, 800, 0.06
#: Rows of a block of a dense prefix, and of a block of the whole table, at most, about; asking rows of a similarity matrix.
BLOCK_ROWS, WIDE_ROWS, SCAN_ROWS = 32_768, 131_072, 512
#: The similarity from which on `nearest` lets the forest find neighbours.
CLOSE = 0.8
#: The prefixes, and then the homes, are searched in so many turns, so that only a part of the sent vectors is on disk at a time.
TURNS = 2
#: From so many answering rows on a prefix is parted by centres of its own, one per LOCAL_ROWS rows, placed by so many rows each.
LOCAL_LEAST, LOCAL_ROWS, LOCAL_SAMPLED = 1_500, 150, 20
#: How near to its best a centre within a prefix is visited: for candidates, which either side may find, and for the exact search.
LOCAL_MARGIN, HOME_MARGIN = 0.14, 0.22
#: Similarities in single precision are wrong by less than half of this.
SLACK = 4e-6
#: Cosines of vectors sent as bytes are wrong by less than this.
SMALL_ERROR = 0.012
ASKS, ANSWERS = 1, 2
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
FOUND_DDL = "a long, b long, similarity double"
#: Marks rows of the result that name the copy whose neighbours they share.
COPY = 2.0


def _packer(dim: int) -> Callable:
    """For mapInArrow over (..., id, embedding): valid rows with their vector packed as v."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = V.matrix(b.column(b.num_columns - 1), dim)
            if len(at):
                kept = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], V.pack_exact(values)], [*b.schema.names[:-1], "v"])

    return pack


def copies(ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows that repeat a vector which k + 1 smaller ids of this batch have already, and the smallest such id of each."""
    _, same = np.unique(np.ascontiguousarray(values).view(np.dtype((np.void, values.shape[1] * values.itemsize))).ravel(), return_inverse=True)
    same = same.ravel()
    n = np.bincount(same)
    if n.max() <= k + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((ids, same))
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    rank = np.arange(len(order)) - begin[same[order]]
    late = order[rank > k]
    return late, ids[order[begin[same[late]]]]


def spots(code: np.ndarray, tree: int, blocks: np.ndarray, ids: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows go that lie below, visit or are fetched to prefixes: (row, cell, role) with the cells of a square where a prefix has several blocks."""
    many = blocks[np.minimum(code, len(blocks) - 1)] if len(blocks) else np.ones(len(code), np.int64)
    many = np.where(code < len(blocks), many, 1)
    one = np.flatnonzero(many == 1)
    out = [(one, code[one] * 8 + tree, np.full(len(one), role, np.int8))]
    for b in np.unique(many[many > 1]).tolist():
        rows = np.flatnonzero(many == b)
        own = ((ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % b
        base = (code[rows] * 8 + tree) << 26
        for other in range(b):
            if role & ASKS:
                out.append((rows, -1 - (base | own << 13 | other), np.where(own == other, role, ASKS).astype(np.int8)))
            if role & ANSWERS:
                off = rows[own != other] if role & ASKS else rows
                at = own[own != other] if role & ASKS else own
                bb = base[own != other] if role & ASKS else base
                out.append((off, -1 - (bb | other << 13 | at), np.full(len(off), ANSWERS, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def meetings(asks: np.ndarray, answers: np.ndarray, ids: np.ndarray, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of asking and of answering unit rows that are to be compared: all with all where few answer.

    Else each answering row, their ids being ``ids``, lies at the nearest of some centres placed among them, and an asking row meets those
    at the centres within ``margin`` of its best. So what a row meets grows far slower than the rows below its prefix.
    """
    n, count = len(answers), len(answers) // LOCAL_ROWS
    if n < LOCAL_LEAST:
        yield np.arange(len(asks)), np.arange(n)
        return
    drawn = np.argsort(ids, kind="stable")[np.random.default_rng(n).choice(n, min(n, LOCAL_SAMPLED * count), replace=False)]
    centres = V.centroids(answers[drawn], count, n, rounds=3)
    own = np.concatenate([(answers[x : x + 8192] @ centres.T).argmax(1) for x in range(0, n, 8192)])
    who, at = [], []
    for x in range(0, len(asks), 8192):
        s = asks[x : x + 8192] @ centres.T
        i, j = np.nonzero(s >= s.max(1, keepdims=True) - margin)
        who.append(i + x)
        at.append(j)
    who, at, shelf = np.concatenate(who), np.concatenate(at), np.argsort(own, kind="stable")
    who = who[np.argsort(at, kind="stable")]
    visited, held = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=count))]) for x in (at, own))
    for c in range(count):
        if visited[c] < visited[c + 1] and held[c] < held[c + 1]:
            yield who[visited[c] : visited[c + 1]], shelf[held[c] : held[c + 1]]


def neighbours(df: DataFrame, k: int = 5, least: float = 0.8, dim: int = 96, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, similarity): of each row a of ``df`` (id, embedding) the k most similar other rows with a cosine of at least ``least``.

    Ties go to the smaller id. Rows without a valid vector have no neighbours and are nobody's; other columns
    of ``df`` are ignored; an empty table gives an empty result. A pair is missed only if no tree brings the two, or
    a candidate of one and the home of the other, below one prefix; a table that an ascent covers is searched exactly.
    Further copies of a vector that k + 1 rows of the same batch hold get their neighbours from the first of these.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    df = df.select("id", "embedding")
    rows = df.count()
    forest = V.Forest.fit(V.sample_units(df, dim, rows), rows, TREES).counted(df, dim)
    if not forest.trees:
        return spark.createDataFrame([], FOUND_DDL)
    blocks = [np.concatenate([[1], np.maximum(1, -(-tree.sizes // np.where(tree.dense, BLOCK_ROWS, max(BLOCK_ROWS, V.HOT_ROWS))))]) for tree in forest.trees]
    shared = spark.sparkContext.broadcast((forest, blocks))

    def send(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        forest, blocks = shared.value
        for b in batches:
            at, values = V.matrix(b.column(1), dim)
            if not len(at):
                continue
            ids = b.column(0).to_numpy()[at]
            stay = np.setdiff1d(np.arange(len(ids)), copies(ids, values, k)[0])
            ids, units = ids[stay], V.unit(values[stay])
            small, visits = V.pack_small(units), forest.visits(units, MARGIN, ENOUGH)
            home = np.zeros(len(ids), np.int64)
            home[visits[0][0][0]] = visits[0][0][1]
            for t, steps in enumerate(visits):
                for step, (who, code) in enumerate(steps):
                    now = code % TURNS == turn
                    who, code = who[now], code[now]
                    row, cell, role = spots(code, t, blocks[t], ids[who], ASKS if step else ASKS | ANSWERS)
                    if not t and not step:  # rows of one home meet there anyway
                        keep = role != ASKS
                        row, cell, role = row[keep], cell[keep], np.full(keep.sum(), ANSWERS, np.int8)
                    row = who[row]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(role), pa.array(ids[row]), pa.array(home[row]), small.take(pa.array(row))], ["cell", "role", "id", "home", "v"])

    def meet(bounds: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells, roles, ids, homes = (b.column(c).to_numpy() for c in range(4))
        out: list[np.ndarray] = []
        for start, end in zip(bounds, bounds[1:]):
            role = roles[start:end]
            ask, answer = np.flatnonzero(role & ASKS), np.flatnonzero(role & ANSWERS)
            if not len(ask) or not len(answer):
                continue
            units, own, home = V.unpack_small(b.column(4).slice(start, end - start), dim), ids[start:end], homes[start:end]
            hits = []
            for who, others in meetings(units[ask], units[answer], own[answer], LOCAL_MARGIN) if cells[start] >= 0 else [(np.arange(len(ask)), np.arange(len(answer)))]:
                who, others = ask[who], answer[others]
                there = units[others].T
                for x in range(0, len(who), SCAN_ROWS):
                    s = units[who[x : x + SCAN_ROWS]] @ there
                    i, j = _top(s, k + 2, least - SMALL_ERROR)
                    hits.append((who[x + i], others[j], s[i, j]))
            if not hits:
                continue
            a, c, s = (np.concatenate(x) for x in zip(*hits))
            rank = np.lexsort((c, -s, a))
            a, c = a[rank], c[rank]
            few = (np.arange(len(a)) - np.searchsorted(a, a) < k + 2) & (home[a] != home[c])
            a, c = a[few], c[few]
            out.append(np.stack([np.concatenate([home[a], home[c]]), np.concatenate([own[c], own[a]])], axis=1))  # each is a candidate for the other
        if out:
            found = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["home", "id"])

    met = []
    for turn in range(TURNS):
        routed = df.mapInArrow(partial(send, turn=turn), "cell long, role byte, id long, home long, v binary").repartition("cell").sortWithinPartitions("cell")
        met.append(scratch.save(routed.mapInArrow(by_group(0, meet), "home long, id long").distinct()))
    asked = reduce(DataFrame.union, met)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at their homes; copies that need no search."""
        forest, blocks = shared.value
        for b in batches:
            at, values = V.matrix(b.column(1), dim)
            if not len(at):
                continue
            ids = b.column(0).to_numpy()[at]
            late, head = copies(ids, values, k)
            if len(late):
                spread = pa.array(-1 - (ids[late] & 1023))
                yield pa.RecordBatch.from_arrays([spread, spread, pa.array(np.zeros(len(late), np.int8)), pa.array(ids[late]), V.binary(head[:, None])], ["home", "cell", "role", "id", "v"])
            stay = np.setdiff1d(np.arange(len(ids)), late)
            ids, values = ids[stay], values[stay]
            tree = forest.trees[0]
            home = tree.prefixes(tree.strings(V.unit(values), V.DIGITS)[0])
            row, cell, role = spots(home, 0, blocks[0], ids, ASKS | ANSWERS)
            yield pa.RecordBatch.from_arrays([pa.array(home[row]), pa.array(cell), pa.array(role), pa.array(ids[row]), V.pack_exact(values).take(pa.array(row))], ["home", "cell", "role", "id", "v"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blocks = shared.value
        for b in batches:
            if b.num_rows:
                ids = b.column(1).to_numpy()
                row, cell, role = spots(b.column(0).to_numpy(), 0, blocks[0], ids, ANSWERS)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(role), pa.array(ids[row]), b.column(2).take(pa.array(row))], ["cell", "role", "id", "v"])

    def exact(bounds: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells, roles, ids = (b.column(c).to_numpy() for c in (0, 1, 2))
        for start, end in zip(bounds, bounds[1:]):
            part, role, own = b.column(3).slice(start, end - start), roles[start:end], ids[start:end]
            if not role.any():
                head = V.raw(part)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(head), pa.array(np.full(len(own), COPY))], schema=FOUND)
                continue
            values, ask, answer = V.unpack_exact(part, dim), (role & ASKS) > 0, (role & ANSWERS) > 0
            if ask.any() and answer.any():
                a, c, s = (scan_near if cells[start] >= 0 else scan)(own[ask], values[ask], own[answer], values[answer], k, least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s)], schema=FOUND)

    ddl = "cell long, role byte, id long, v binary"
    turns = []
    for turn in range(TURNS):
        here = lambda c, turn=turn: F.pmod(F.col(c), F.lit(TURNS)) == turn
        wanted = asked.where(here("home")).repartition("id").distinct()
        fetched = wanted.join(df.mapInArrow(_packer(dim), "id long, v binary").hint("merge"), "id").select("home", "id", "v")
        at_home = df.mapInArrow(settle, f"home long, {ddl}").where(here("home")).drop("home").union(fetched.mapInArrow(fetch, ddl))
        turns.append(scratch.save(at_home.repartition("cell").sortWithinPartitions("cell").mapInArrow(by_group(0, exact), FOUND_DDL)))
    found = reduce(DataFrame.union, turns)
    for m in met:
        scratch.drop(m)
    near = found.where(F.col("similarity") < COPY)
    if max(b.max() for b in blocks) > 1:
        near = _first(near, k)
    late = found.where(F.col("similarity") == COPY).select(F.col("a").alias("id"), F.col("b").alias("a"))
    if late.isEmpty():
        return near
    heads = near.union(late.select("a", F.col("a").alias("b"), F.lit(1.0)).distinct())
    return near.union(_first(late.join(heads, "a").select(F.col("id").alias("a"), "b", "similarity"), k))


def _top(s: np.ndarray, k: int, least: float, slack: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k largest entries of each row, and of those less than ``slack`` below them, that reach ``least``."""
    hit = s >= least
    many = np.count_nonzero(hit, axis=1)
    full = np.flatnonzero(many > k)
    if len(full) and k < s.shape[1]:
        bound = np.partition(s[full], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        hit[full] &= s[full] >= bound[:, None] - slack
    return np.divmod(np.flatnonzero(hit), s.shape[1])


def nearest(df: DataFrame, k: int = 5, dim: int = 96, scratch: Scratch | None = None, asked: DataFrame | None = None) -> DataFrame:
    """As `neighbours`, but k for every row (or those whose id is in ``asked``) however dissimilar they are, fewer only if there are fewer rows.

    Rows for which the forest finds fewer than k close ones are compared with all rows, block by block: no prefix tells which of the
    far ones are the nearest, so that part takes time in proportion to such rows times all rows.
    """
    scratch = scratch or Scratch(df.sparkSession)
    df = df.select("id", "embedding")
    some = (lambda x, key: x.join(asked.select(F.col("id").alias(key)), key, "left_semi")) if asked is not None else lambda x, key: x
    near = scratch.save(some(neighbours(df, k, CLOSE, dim, scratch), "a"))
    full = near.groupBy("a").count().where(F.col("count") >= k).select("a")
    rows = df.mapInArrow(_packer(dim), "id long, v binary")
    short = scratch.save(some(rows, "id").join(full.withColumnRenamed("a", "id"), "id", "left_anti"))
    asking = short.count()
    if not asking:
        return near
    across, down = _blocks(asking, df.count())
    numbers = {"part": F.lit(0).cast("long"), "across": F.lit(across).cast("long"), "down": F.lit(down).cast("long")}
    return near.join(full, "a", "left_semi").union(_first(_scanned(short.withColumns(numbers), rows.withColumns(numbers), k, -2, dim), k))


def offers(faces: DataFrame, near: DataFrame) -> DataFrame:
    """(face_id, person_id, votes, similarity): for every face without a person, the persons of its neighbours, how many neighbours each has and the best similarity."""
    persons = faces.where("person_id is not null").select(F.col("id").alias("b"), "person_id")
    open_ = faces.where("person_id is null").select(F.col("id").alias("a"))
    found = near.join(open_, "a", "left_semi").join(persons, "b").groupBy("a", "person_id").agg(F.count("*").alias("votes"), F.max("similarity").alias("similarity"))
    return found.select(F.col("a").alias("face_id"), "person_id", "votes", F.round("similarity", 6).alias("similarity"))


def _few_copies(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Positions in order of ids without the copies of a vector that k + 1 smaller ids have: these can't be among anyone's k."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(values[order]).view(np.dtype((np.void, values.shape[1] * values.itemsize))).ravel(), return_inverse=True)
    run = np.argsort(same.ravel(), kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(same.ravel()))])[:-1]
    return order[np.sort(run[np.arange(len(run)) - begin[same.ravel()[run]] <= k])]


def scan(ids: np.ndarray, values: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k most similar of the other rows, every pair being compared; ties as in `best`.

    Single precision only rules pairs out, with a margin; what it leaves is compared in double precision.
    """
    order = _few_copies(other_ids, others, k)
    other_ids, others = other_ids[order], others[order]
    units, norm = V.unit(others), np.sqrt(np.einsum("ij,ij->i", others, others, dtype=np.float64))
    out = []
    for start in range(0, len(ids), SCAN_ROWS):
        own, q = ids[start : start + SCAN_ROWS], V.unit(values[start : start + SCAN_ROWS], np.float64)
        m, at, step, small = len(own), 0, 2048, q.astype(np.float32)
        who, value, found = np.repeat(np.arange(m), k), np.full(m * k, -2.0), np.full(m * k, -1, np.int64)
        while at < len(others):
            s = small @ units[at : at + step].T
            bound = np.maximum(value.reshape(m, k)[:, -1], least)
            if not at and s.shape[1] > k + 1:  # one more than k, as the row itself may be among them
                bound = np.maximum(bound, np.partition(s, -k - 1, axis=1)[:, -k - 1])
            i, j = np.divmod(np.flatnonzero(s >= (bound - 2e-6)[:, None].astype(np.float32)), s.shape[1])
            j += at
            apart = own[i] != other_ids[j]
            i, j = i[apart], j[apart]
            exact = [np.einsum("ij,ij->i", q[i[x : x + 50_000]], others[j[x : x + 50_000]].astype(np.float64)) / norm[j[x : x + 50_000]] for x in range(0, len(i), 50_000)]
            at, step = at + step, min(16_384, max(2048, at + step))
            if not len(i):
                continue
            w, v, f = np.concatenate([who, i]), np.concatenate([value, *exact]), np.concatenate([found, other_ids[j]])
            rank = np.lexsort((f, -np.rint(v * 1e9), w))
            first = np.searchsorted(w[rank], np.arange(m))
            rank = rank[np.arange(len(rank)) - first[w[rank]] < k]
            value, found = v[rank], f[rank]
        good = (value >= least) & (value > -2)
        out.append((own[who[good]], found[good], value[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def scan_near(ids: np.ndarray, values: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `scan`, but of many other rows only those that `meetings` brings to a row."""
    if len(others) < LOCAL_LEAST:
        return scan(ids, values, other_ids, others, k, least)
    order = _few_copies(other_ids, others, k)
    other_ids, others = other_ids[order], others[order]
    units, there, hits = V.unit(values), V.unit(others), []
    for who, at in meetings(units, there, other_ids, HOME_MARGIN):
        near = there[at].T
        for x in range(0, len(who), SCAN_ROWS):
            s = units[who[x : x + SCAN_ROWS]] @ near
            i, j = _top(s, k + 1, least - SLACK, SLACK)  # the row itself may be among them
            hits.append((who[x + i], at[j], s[i, j]))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, s = (np.concatenate(x) for x in zip(*hits))
    apart = ids[a] != other_ids[b]
    a, b, s = a[apart], b[apart], s[apart]
    rank = np.lexsort((-s, a))
    a, b, s = a[rank], b[rank], s[rank]
    last = np.minimum(np.searchsorted(a, a) + k, np.searchsorted(a, a, "right")) - 1
    near = s >= s[last] - SLACK
    a, b = a[near], b[near]
    q, norm = V.unit(values, np.float64), np.sqrt(np.einsum("ij,ij->i", others, others, dtype=np.float64))
    s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[a[x : x + 50_000]], others[b[x : x + 50_000]].astype(np.float64)) / norm[b[x : x + 50_000]] for x in range(0, len(a), 50_000))])
    good = s >= least
    a, b, s = a[good], b[good], s[good]
    rank = np.lexsort((other_ids[b], -np.rint(s * 1e9), a))
    a, b, s = a[rank], b[rank], s[rank]
    few = np.arange(len(a)) - np.searchsorted(a, a) < k
    return ids[a[few]], other_ids[b[few]], s[few]


def _blocks(asking: int, rows: int) -> tuple[int, int]:
    """Into how many blocks so many asking rows and rows are cut: few for little traffic, enough of them for all cores."""
    return -(-asking // WIDE_ROWS), min(-(-rows // (WIDE_ROWS // 4)), max(12, -(-rows // WIDE_ROWS)))


def _scanned(asking: DataFrame, rows: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """(a, b, similarity): of each asking row the k nearest of each block of rows, all compared block by block.

    Both have part (a number per group), id, v and the group's numbers of blocks, across and down.
    """
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sent = asking.select("part", own("across").alias("x"), every("down").alias("y"), F.lit(1).cast("byte").alias("asks"), "id", "v").union(
        rows.select("part", every("across").alias("x"), own("down").alias("y"), F.lit(0).cast("byte").alias("asks"), "id", "v")
    )
    cell = (F.col("part") * 8192 + F.col("x")) * 8192 + F.col("y")

    def within(bounds: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asks, ids = b.column(1).to_numpy() == 1, b.column(2).to_numpy()
        for start, end in zip(bounds, bounds[1:]):
            who, values = asks[start:end], V.unpack_exact(b.column(3).slice(start, end - start), dim)
            if who.any() and not who.all():
                a, c, s = scan(ids[start:end][who], values[who], ids[start:end][~who], values[~who], k, least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s)], schema=FOUND)

    return sent.select(cell.alias("cell"), "asks", "id", "v").repartition("cell").sortWithinPartitions("cell").mapInArrow(by_group(0, within), "a long, b long, similarity double")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.round("similarity", 9).desc(), "b")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "similarity")
