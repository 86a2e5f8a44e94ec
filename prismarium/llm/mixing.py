"""Problem 7: a mixture of sources with target shares.

Every document of a source gets the same expected number of copies. The whole part is given; the
fractions are rounded by pivotal dependent rounding, weighted by size: two fractions at a time, mass moves
from one to the other (keeping their sum of tokens) until one is 0 or 1, in a direction drawn
so that expectations stay. Every task leaves at most one open fraction per source; these are combined
in a reduction tree. So a source's tokens miss its target by less than one document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismarium.llm.bpe import VOCABULARY, counted
from prismarium.session import Scratch

#: Open fractions that one task of the reduction tree combines, per source.
FAN_IN = 64
#: Documents of a task of the first pass, about.
TASK_ROWS = 25_000
EPSILON = 1e-9
DOCS = "doc_id long, source string, tokens long, whole long, part double, open boolean, hand long"


def pivotal(rows: list[tuple[int, int, float]], seed: int) -> tuple[list[tuple[int, float]], tuple[int, int, float] | None]:
    """Rounds (id, tokens, fraction): the settled (id, 0.0 or 1.0), and the one that stays open."""
    settled: list[tuple[int, float]] = []
    held: tuple[int, int, float] | None = None
    for key, weight, p in rows:
        if p <= EPSILON or p >= 1 - EPSILON:
            settled.append((key, float(round(p))))
            continue
        if held is None:
            held = (key, weight, p)
            continue
        k, w, q = held
        up = min((1 - q) * w, p * weight)  # tokens that the held one can gain
        down = min(q * w, (1 - p) * weight)
        draw = xxhash.xxh3_64_intdigest(f"{seed}:{k}:{key}".encode()) / 2**64
        move = up if draw < down / (up + down) else -down
        q, p = q + move / w, p - move / weight
        held_open, new_open = EPSILON < q < 1 - EPSILON, EPSILON < p < 1 - EPSILON
        if not held_open:
            settled.append((k, float(round(q))))
        if not new_open:
            settled.append((key, float(round(p))))
        held = (k, w, q) if held_open else (key, weight, p) if new_open else None
    return settled, held


def _round(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, int, float, int]] = {}
        hand = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "source", "tokens", "whole", "part", "open", "hand"])

        for b in batches:
            if not b.num_rows:
                continue
            doc, source, tokens, whole, part = (b.column(k).to_pylist() for k in range(5))
            hand = hand or xxhash.xxh3_64_intdigest(str(doc[0]).encode()) & 0x7FFFFFFF
            of = dict(zip(doc, zip(tokens, whole)))
            rows = []
            by: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
            for d, s, t, p in zip(doc, source, tokens, part):
                by[s].append((d, t, p))
            for s, mine in by.items():
                if s in held:
                    d, t, p, w = held.pop(s)
                    of[d] = (t, w)
                    mine.insert(0, (d, t, p))
                settled, open_ = pivotal(mine, seed)
                rows += [(d, s, *of[d], p, False, 0) for d, p in settled]
                if open_:
                    held[s] = (*open_, of[open_[0]][1])
            if rows:
                yield out(rows)
        rest = []
        for s, (d, t, p, w) in held.items():
            if last:
                p = float(xxhash.xxh3_64_intdigest(f"{seed}:last:{d}".encode()) / 2**64 < p)
            rest.append((d, s, t, w, p, not last, hand))
        if rest:
            yield out(rest)

    return run


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies) of the documents in the mixture, and a report of every target.

    ``documents`` has doc_id, source and text, ``targets`` (a list of sources, which the driver holds) source, target_share and max_repeats.
    The same seed gives the same mixture however the documents are split into files.
    ``total`` tokens; by default the most at which every source that has documents reaches its share, the shares
    of sources without documents being divided among the others in proportion. With a larger total, sources
    give what max_repeats allows and the report shows the shares reached. Documents of other or null
    sources and documents without tokens are not used; targets without a share or repeats give nothing.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    listed = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    plan = [r.asDict() for r in listed.orderBy("source").collect()]
    chosen = documents.where("doc_id is not null").join(listed.select("source"), "source", "left_semi").select(*documents.columns)
    sizes = scratch.save(counted(chosen, "doc_id", "source", vocabulary=vocabulary).where("tokens > 0"))
    there = {r.source: (r.tokens, r.docs) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    usable = [p for p in plan if p["source"] in there and p["target_share"] > 0 and p["max_repeats"] > 0]
    shares = sum(p["target_share"] for p in usable)
    most = min((p["max_repeats"] * there[p["source"]][0] * shares / p["target_share"] for p in usable), default=0.0)
    wanted = most if total is None else float(total)
    rates = [(p["source"], min(float(p["max_repeats"]), wanted * p["target_share"] / shares / there[p["source"]][0])) for p in usable]
    spark = documents.sparkSession
    spread = sizes.join(spark.createDataFrame(rates, "source string, rate double"), "source").where("rate > 0").select("doc_id", "source", "tokens", F.floor(F.col("rate") + EPSILON).alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + EPSILON)).alias("part"))
    # Whom a document is paired with must not depend on files: rows of a task are chosen by a hash and seen in one order.
    tasks = -(-sum(n for _, n in there.values()) // TASK_ROWS) or 1
    ordered = spread.repartition(tasks, F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(tasks))).sortWithinPartitions("source", F.xxhash64("doc_id"), "doc_id")
    done = scratch.save(ordered.mapInArrow(_round(seed, False), DOCS))
    settled, level = [done.where("not open")], 0
    open_ = done.where("open")
    while True:
        left = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if not left:
            break
        level += 1
        tasks = -(-left // FAN_IN)
        last = tasks == 1
        # Whoever holds an open fraction hands it to one of the next level's tasks, which sees them in one order.
        sent = open_.select("doc_id", "source", "tokens", "whole", "part", F.pmod(F.xxhash64("doc_id"), F.lit(tasks)).alias("task"))
        next_ = scratch.save(sent.repartition(tasks, "task").sortWithinPartitions("source", "tokens", "doc_id").drop("task").mapInArrow(_round(seed + level, last), DOCS))
        settled.append(next_.where("not open"))
        open_ = next_.where("open")
    mixed = settled[0]
    for s in settled[1:]:
        mixed = mixed.union(s)
    mixed = mixed.select("doc_id", "source", "tokens", (F.col("whole") + F.col("part").cast("long")).alias("copies")).where("copies > 0")
    used = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most_copies"))
    all_ = F.sum(F.coalesce("mixed", F.lit(0))).over(Window.partitionBy(F.lit(0)))  # one row per target
    have = spark.createDataFrame([(p["source"], float(p["target_share"]), int(p["max_repeats"]), *map(int, there.get(p["source"], (0, 0)))) for p in plan], "source string, target_share double, max_repeats long, tokens_there long, documents_there long")
    report = have.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "documents_there", "tokens_there",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "most_copies")),
        F.coalesce("mixed", F.lit(0)).alias("tokens"), F.coalesce(F.round(F.col("mixed") / F.nullif(all_, F.lit(0)), 6), F.lit(0.0)).alias("actual_share"),
    )
    return mixed, report
