"""Queries pN_ of this subpackage. SQL goes with those that it can express by brute force; the tests hold the others against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismarium.llm import vectors as V
from prismarium.llm.bpe import encode
from prismarium.llm.canonical import map_values, unmatched
from prismarium.llm.clusters import clusters, describe
from prismarium.llm.history import repeats
from prismarium.llm.mixing import mix
from prismarium.llm.neighbours import nearest, neighbours, offers
from prismarium.llm.reading import reading_levels
from prismarium.llm.variants import variants
from prismarium.session import Scratch


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of usable faces with a similarity of at least 0.80, one among the 5 nearest of the other."""
    faces = _table(spark, d, "face_detections").where(V.usable_face())
    near = neighbours(faces, k=5, least=0.8)
    return near.select(F.least("a", "b").alias("face_id_a"), F.greatest("a", "b").alias("face_id_b")).distinct()


def p1_offers(spark: SparkSession, d: str) -> DataFrame:
    """Persons offered to faces without one, from their nearest neighbours of at least 0.80, as its SQL has it."""
    faces = _table(spark, d, "face_detections").where(V.usable_face())
    return offers(faces, neighbours(faces, k=5, least=0.8))


def p1_offers_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Persons offered to faces without one, from their 5 nearest neighbours however dissimilar these are."""
    faces = _table(spark, d, "face_detections").where(V.usable_face())
    return offers(faces, nearest(faces, k=5, asked=faces.where("person_id is null")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each row of images that repeats a photo, with the accepted row of that photo; the last day comes as a batch to the index of all before."""
    found = repeats(_table(spark, d, "images"), later=1)
    return found.select(F.least("repeat", "accepted").alias("image_id_a"), F.greatest("repeat", "accepted").alias("image_id_b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of rows of persons that name the same person or group."""
    rows = Scratch(spark).save(variants(_table(spark, d, "persons")))
    a, b = (rows.withColumnRenamed("id", f"person_id_{x}") for x in "ab")
    return a.join(b, "entity").where("person_id_a < person_id_b").select("person_id_a", "person_id_b")


def _sure(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "face_detections").where(V.usable_face() & (F.col("confidence") >= 0.5))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups of at least five sure faces joined by similarities of at least 0.75."""
    return clusters(_sure(spark, d)).select("cluster_id", F.col("member").alias("face_id"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group's size and its three most typical faces."""
    faces = _sure(spark, d)
    return describe(faces, clusters(faces)).withColumnRenamed("member", "face_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry of camera_reference that each typed make, model and lens means, 0 where there is none."""
    return map_values(_table(spark, d, "images"), _table(spark, d, "camera_reference"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that name nothing in camera_reference."""
    return unmatched(_table(spark, d, "images"), _table(spark, d, "camera_reference"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode(_table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture with their tokens and copies."""
    return mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each target with the share of the mixture's tokens that its source reached."""
    return mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document of running prose."""
    return reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by source and reading level."""
    documents = _table(spark, d, "documents")
    levels = reading_levels(documents, _table(spark, d, "reading_labels"))
    return documents.select("doc_id", "source", "n_chars").join(levels, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_offers, p1_offers_nearest, p2_found, p3_found, p4_found, p4_groups, p5_found, p5_unmatched, p6_ids, p7_mix, p7_shares, p8_found, p8_profile)
    return {f.__name__: f for f in found}


_PAIRS = """u AS (SELECT id, (list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))))::DOUBLE[96] AS e FROM face_detections
    WHERE confidence >= {0} AND (coalesce(bbox_x1, 0) <> 0 OR coalesce(bbox_y1, 0) <> 0 OR coalesce(bbox_x2, 0) <> 0 OR coalesce(bbox_y2, 0) <> 0) AND len(embedding) = 96
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, array_inner_product(a.e, b.e) AS s FROM u a JOIN u b ON a.id < b.id WHERE array_inner_product(a.e, b.e) >= {1}),
    d AS (SELECT a, b, s FROM s UNION ALL SELECT b, a, s FROM s)""".format
_NEAR = f"{_PAIRS(0, 0.8)}, r AS (SELECT a, b, s FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) <= 5)"
_NEAREST = f"{_PAIRS(0, -2)}, r AS (SELECT a, b, s FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) <= 5)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_NEAR} SELECT DISTINCT least(a, b) AS face_id_a, greatest(a, b) AS face_id_b FROM r",
        "p1_offers": f"""WITH {_NEAR} SELECT r.a AS face_id, y.person_id, count(*) AS votes, round(max(r.s), 6) AS similarity FROM r JOIN face_detections x ON x.id = r.a AND x.person_id IS NULL
            JOIN face_detections y ON y.id = r.b AND y.person_id IS NOT NULL GROUP BY 1, 2""",
        "p1_offers_nearest": f"""WITH {_NEAREST} SELECT r.a AS face_id, y.person_id, count(*) AS votes, round(max(r.s), 6) AS similarity FROM r JOIN face_detections x ON x.id = r.a AND x.person_id IS NULL
            JOIN face_detections y ON y.id = r.b AND y.person_id IS NOT NULL GROUP BY 1, 2""",
        "p4_found": f"""WITH RECURSIVE {_PAIRS(0.5, 0.75)}, reach AS (SELECT DISTINCT a AS id, a AS other FROM d UNION SELECT reach.id, d.b FROM reach JOIN d ON d.a = reach.other),
            g AS (SELECT id AS face_id, min(other) AS cluster_id, count(*) AS n FROM reach GROUP BY id) SELECT cluster_id, face_id FROM g WHERE n >= 5""",
        "p4_groups": f"""WITH RECURSIVE {_PAIRS(0.5, 0.75)}, reach AS (SELECT DISTINCT a AS id, a AS other FROM d UNION SELECT reach.id, d.b FROM reach JOIN d ON d.a = reach.other),
            g AS (SELECT id, min(other) AS cluster_id, count(*) AS size FROM reach GROUP BY id), m AS (SELECT g.cluster_id, g.id, g.size, u.e FROM g JOIN u ON u.id = g.id WHERE g.size >= 5),
            t AS (SELECT cluster_id, i, sum(e[i]) AS s FROM m, (SELECT unnest(range(1, 97)) AS i) GROUP BY 1, 2), c AS (SELECT cluster_id, list(s ORDER BY i)::DOUBLE[96] AS t FROM t GROUP BY 1),
            x AS (SELECT cluster_id, id, size, array_inner_product(e, t) / sqrt(array_inner_product(t, t)) AS s FROM m JOIN c USING (cluster_id))
            SELECT cluster_id, size, row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 9) DESC, id) AS rank, id AS face_id, round(s, 6) AS similarity FROM x QUALIFY rank <= 3""",
    }
