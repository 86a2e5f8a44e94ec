"""Matching faces against faces of known persons, in blocks; vector functions."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismarium.functions import col
from prismarium.functions.geometry import real_face

#: Rows of a block of queries and of a block of known faces (a task compares one block with one), and queries in one matrix product.
QUERY_BLOCK, KNOWN_BLOCK, AT_ONCE = 50_000, 50_000, 500
PAIRS = "query_id long, person_id long, similarity double"


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, 0 for empty vectors and ones of different length; a cosine if both are normalised."""
    same = (F.size(col(a)) == F.size(col(b))) & (F.size(col(a)) > 0)
    terms = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(same, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """The vector over its length; unchanged if that is next to nothing."""
    return F.when(norm(v) > 1e-10, F.transform(col(v), lambda x: (x / norm(v)).cast("float"))).otherwise(col(v))


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian floats."""
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian floats; bytes of a part of one at the end are ignored."""
    return blobs.map(lambda b: np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"), na_action="ignore")


def finite(v: Column | str) -> Column:
    return F.forall(col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dimension(embeddings: DataFrame) -> int:
    """Length of the first vector (by face_id) that is not empty, 0 without one."""
    row = embeddings.where(F.size("embedding") > 0).agg(F.min_by(F.size("embedding"), "face_id").alias("dim")).first()
    return row.dim or 0


def _blocks(df: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
    """``df`` with a column ``block``, and how many there are."""
    count = max(1, -(-df.count() // size))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(count)).cast("int")), count


def best_per_person(queries: DataFrame, known: DataFrame, dim: int, threshold: float | None, most: int | None = None) -> DataFrame:
    """(query_id, person_id, similarity): the highest similarity of every query (query_id, embedding) to the faces of each person; with ``most`` at least to so many of the best persons.

    ``known`` has person_id and embedding. Blocks of queries meet blocks of known faces, so neither side has to fit
    in a task, and a side that is one block travels no more than the other has blocks. A block's matrix product is
    reduced to one value per query and person, and to the block's best persons, as the best of all are among them.
    Vectors of another length than ``dim`` and ones that are not finite count as unlike everything and are left out.
    """
    valid = (F.size("embedding") == dim) & finite("embedding")
    left, queries_n = _blocks(queries.where(valid & F.col("query_id").isNotNull()).select(F.col("query_id").alias("id"), "embedding"), "id", QUERY_BLOCK)
    right, known_n = _blocks(known.where(valid & F.col("person_id").isNotNull()).select(F.col("person_id").alias("id"), "embedding", F.xxhash64("embedding").alias("_k")), "_k", KNOWN_BLOCK)
    a = left.select(F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(known_n - 1))).alias("j"), F.lit(0).alias("side"), "id", "embedding")
    b = right.select(F.explode(F.sequence(F.lit(0), F.lit(queries_n - 1))).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "embedding")

    def compare(batch: pa.Table) -> pa.Table:
        side, ids = batch["side"].to_numpy(), batch["id"].to_numpy()
        v = batch["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        q, k = side == 0, side == 1
        if not q.any() or not k.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "person_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        order = np.argsort(ids[k], kind="stable")
        persons, start = np.unique(ids[k][order], return_index=True)
        asked, faces_t, parts = ids[q], np.ascontiguousarray(v[k][order].T), []
        for at in range(0, len(asked), AT_ONCE):
            best = np.maximum.reduceat(v[q][at : at + AT_ONCE] @ faces_t, start, axis=1)
            good = np.ones(best.shape, bool) if threshold is None else best >= threshold - 1e-9
            if most is not None and most < best.shape[1]:
                last = np.partition(best, best.shape[1] - max(most, 1), axis=1)[:, best.shape[1] - max(most, 1)]
                good &= best >= last[:, None] - 2e-9  # ties with the k-th stay
            r, c = np.nonzero(good)
            parts.append((asked[at : at + AT_ONCE][r], persons[c], best[r, c]))
        return pa.table(dict(zip(("query_id", "person_id", "similarity"), map(np.concatenate, zip(*parts)))))

    found = a.union(b).groupBy("i", "j").applyInArrow(compare, PAIRS).groupBy("query_id", "person_id").agg(F.max("similarity").alias("similarity"))
    return found if threshold is None else found.where(F.round("similarity", 9) >= threshold)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc_nulls_last(), "person_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_matches(queries: DataFrame, known: DataFrame, dim: int, threshold: float, k: int) -> DataFrame:
    """(query_id, rank, person_id, similarity): the k persons most similar to each query, at or above the threshold; none for k = 0."""
    return _ranked(best_per_person(queries, known, dim, threshold, k), k).select("query_id", "rank", "person_id", "similarity")


def top_k(queries: DataFrame, known: DataFrame, persons: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, rank, person_id, name, similarity): without a threshold; persons without faces come last and have a null similarity.

    A query without a vector of the right length gets the first k persons by name, unscored. Only the k
    first unscored persons by id can be among anyone's k, so no more are joined to a query.
    """
    who = persons.select(F.col("id").alias("person_id"), "name")
    scored = _ranked(best_per_person(queries, known, dim, None, k), k).select("query_id", "person_id", "similarity")
    valid = (F.size("embedding") == dim) & finite("embedding")
    with_faces = known.where(valid).select("person_id").distinct()
    unscored = [r.person_id for r in who.join(with_faces, "person_id", "left_anti").orderBy("person_id").limit(k).collect()]  # k rows at most
    first = [(n, r.person_id, r.name) for n, r in enumerate(who.orderBy("name", "person_id").limit(k).collect(), 1)]
    asked = queries.select("query_id", F.coalesce(valid, F.lit(False)).alias("valid"))
    fill = asked.where("valid").select("query_id", F.explode(F.array(*map(F.lit, unscored)).cast("array<long>")).alias("person_id"), F.lit(None).cast("double").alias("similarity"))
    listed = _ranked(scored.union(fill), k).select("query_id", "rank", "person_id", "similarity").join(who, "person_id")
    plain = F.array(*(F.struct(F.lit(n).alias("rank"), F.lit(p).cast("long").alias("person_id"), F.lit(name).cast("string").alias("name")) for n, p, name in first))
    rest = asked.where("not valid").select("query_id", F.explode(plain.cast("array<struct<rank:int,person_id:long,name:string>>")).alias("p")).select("query_id", "p.rank", "p.person_id", "p.name", F.lit(None).cast("double").alias("similarity"))
    return listed.select("query_id", "rank", "person_id", "name", "similarity").unionByName(rest)


def labels(faces: DataFrame, known: DataFrame, persons: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(face_id, label, assigned, suggestion): the person's name, else the best match at or above the threshold, else '?'."""
    who = persons.select(F.col("id").alias("person_id"), "name")
    open_ = faces.where("person_id is null").select(F.col("id").alias("query_id"), "embedding")
    best = best_matches(open_, known, dim, threshold, 1).join(who.withColumnRenamed("name", "suggested"), "person_id").select(F.col("query_id").alias("id"), "suggested")
    all_ = faces.select("id", "person_id").join(who, "person_id", "left").join(best, "id", "left")
    assigned = F.col("person_id").isNotNull()
    return all_.select(F.col("id").alias("face_id"), F.coalesce("name", "suggested", F.lit("?")).alias("label"), assigned.alias("assigned"), (~assigned & F.col("suggested").isNotNull()).alias("suggestion"))


def tagging_progress(faces: DataFrame) -> DataFrame:
    """(image_id, face_id, position, total) of real faces: the how manieth of how many of its image."""
    real = faces.where(real_face() & F.col("image_id").isNotNull())
    w = Window.partitionBy("image_id")
    return real.select("image_id", F.col("id").alias("face_id"), F.row_number().over(w.orderBy("id")).alias("position"), F.count("*").over(w).alias("total"))


def next_untagged(faces: DataFrame) -> DataFrame:
    """(image_id, face_id): each image's first real face without a person."""
    return faces.where(real_face() & F.col("person_id").isNull() & F.col("image_id").isNotNull()).groupBy("image_id").agg(F.min("id").alias("face_id"))


def next_untagged_index(faces: DataFrame, start: Column) -> DataFrame:
    """(image_id, idx): the first index, counted from 0 by id among all of an image's faces, at or after ``start`` whose face is real and has no person."""
    placed = faces.where("image_id is not null").withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("id")).cast("long") - 1)
    return placed.where((F.col("idx") >= start) & real_face() & F.col("person_id").isNull()).groupBy("image_id").agg(F.min("idx").alias("idx"))
