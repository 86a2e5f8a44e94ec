"""Groups of rows joined by chains of similar pairs, found through trees of cluster features.

1. Every partition builds a tree of cluster features; the trees are merged (see `features`), and their leaves are
   agglomerated by Ward's distance into as many centres as the rows need.
2. In one assignment pass every row goes to its nearest centre, and as a visitor to those beyond the
   boundaries near it. Around a centre, exact similarities link its rows with each other and with the visitors.
3. The labels that a row has around several centres are edges of a small graph (one node per local set); its
   components give every row its group, so chains may cross any number of boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismarium.llm import vectors as V
from prismarium.llm.features import agglomerate, leaves
from prismarium.llm.neighbours import copies
from prismarium.operators.components import connected_components
from prismarium.operators.grouped import by_group
from prismarium.session import Scratch

#: A row visits centres until these have so many rows together, and those within this similarity of its best in any case.
ENOUGH, MARGIN = 1_200, 0.07
#: Rows to a centre, about.
CENTRE_ROWS = 1_000
#: The centres are handled in so many turns, so that only a part of the visiting vectors is on disk at a time.
TURNS = 2
ROWS_DDL, LINKS_DDL = "cell long, own boolean, id long, v binary", "own boolean, id long, label long"


def link(df: DataFrame, threshold: float, scratch: Scratch, dim: int = 96) -> DataFrame:
    """(id, grp) of every row that is linked to another: grp is the smallest id of the group.

    ``df`` has id and embedding. Rows whose embedding is null, of another length, all zero or not finite
    are left out; an empty table gives an empty result. Similarities decide on the given numbers. Of the copies of a vector in
    a batch one travels, the others are linked to it.
    """
    spark = df.sparkSession
    totals, n = leaves(df, dim)
    if not len(n):
        return spark.createDataFrame([], "id long, grp long")
    label = agglomerate(totals, n, max(4, int(n.sum()) // CENTRE_ROWS))
    heads, inverse = np.unique(label, return_inverse=True)
    sums = np.zeros((len(heads), dim))
    np.add.at(sums, inverse, totals)
    shared = spark.sparkContext.broadcast(V.Forest([V.unit(sums)], dense=2).counted(df, dim))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = V.matrix(b.column(1), dim)
            if not len(at):
                continue
            ids = b.column(0).to_numpy()[at]
            late, head = copies(ids, values, 0)
            if len(late):
                heads = np.unique(head)  # these also name themselves, so that their label around a centre is tied to their copies
                who, to = np.concatenate([ids[late], heads]), np.concatenate([head, heads])
                yield pa.RecordBatch.from_arrays([pa.array(-1 - (who & 1023)), pa.array(np.arange(len(who)) < len(late)), pa.array(who), V.binary(to[:, None])], ["cell", "own", "id", "v"])
            stay = np.setdiff1d(np.arange(len(ids)), late)
            ids, values = ids[stay], values[stay]
            packed = V.pack_exact(values)
            for step, (who, code) in enumerate(shared.value.visits(V.unit(values), MARGIN, ENOUGH)[0]):
                rows = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.full(len(who), not step)), pa.array(ids[who]), packed.take(rows)], ["cell", "own", "id", "v"])

    def local(bounds: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells, own, ids = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
        owns, members, labels = [], [], []
        for start, end in zip(bounds, bounds[1:]):
            part = b.column(3).slice(start, end - start)
            if cells[start] < 0:
                owns.append(own[start:end])
                members.append(ids[start:end])
                labels.append(V.raw(part)[0].view(np.int64))
                continue
            order = np.lexsort((ids[start:end], ~own[start:end]))  # the centre's own rows first
            here, mine = ids[start:end][order], own[start:end][order]
            flat = V.linked_labels(V.unit(V.unpack_exact(part, dim))[order], threshold, int(mine.sum()))
            linked = np.bincount(flat, minlength=len(here))[flat] > 1
            owns.append(mine[linked])
            members.append(here[linked])
            labels.append(here[flat[linked]])
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owns)), pa.array(np.concatenate(members)), pa.array(np.concatenate(labels))], ["own", "id", "label"])

    routed, found = df.select("id", "embedding").mapInArrow(send, ROWS_DDL), None
    for turn in range(TURNS):
        here = routed.where(F.pmod(F.xxhash64("cell"), F.lit(TURNS)) == turn)
        linked = scratch.save(here.repartition("cell").sortWithinPartitions("cell").mapInArrow(by_group(0, local), LINKS_DDL))
        found = linked if found is None else found.union(linked)
    # A row stands for itself where its own centre links it with nothing.
    per_row = scratch.save(found.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("own"), F.col("label"))), F.col("id")).alias("first"), F.collect_set("label").alias("labels")))
    crossing = per_row.select(F.col("first").alias("a"), F.explode("labels").alias("b"))
    roots = connected_components(crossing, "a", "b", scratch)
    return (
        per_row.select("id", "first")
        .union(roots.select(F.explode(F.array("node", "root")).alias("id"), F.col("id").alias("first")))  # rows known as labels only
        .dropDuplicates(["id"])
        .join(roots.withColumnRenamed("node", "first"), "first", "left")
        .select("id", F.coalesce("root", "first").alias("grp"))
    )
