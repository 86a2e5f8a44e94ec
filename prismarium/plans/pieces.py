"""Queries of single functions over odd inputs, and of operators that no other query exercises."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismarium.functions import bloom, dates, geometry, texts
from prismarium.operators import detect, faces, search, tournament
from prismarium.plans.registry import DIM, _VALID, query, t

_PARTS = "id % 3000 AS y, id % 15 AS mo, id % 33 AS da, id % 26 AS h, id % 62 AS mi, id % 61 AS s"
_TEXT = "lpad(y::VARCHAR, 4, '0') || ':' || lpad(mo::VARCHAR, 2, '0') || ':' || lpad(da::VARCHAR, 2, '0') || ' ' || lpad(h::VARCHAR, 2, '0') || ':' || lpad(mi::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0')"
_CIVIL = "365 * yy + (floor(yy / 4) - floor(yy / 100) + floor(yy / 400))::BIGINT + (153 * mm + 2) // 5 + da - 719469"


@query(f"""WITH p AS (SELECT id, path, {_PARTS} FROM images), q AS (SELECT *, {_TEXT} AS text, CASE WHEN mo <= 2 THEN y - 1 ELSE y END AS yy, CASE WHEN mo <= 2 THEN mo + 9 ELSE mo - 3 END AS mm FROM p)
    SELECT id, ({_CIVIL}) * 86400 + h * 3600 + mi * 60 + s AS epoch, NULL::BIGINT AS short, NULL::BIGINT AS letters FROM q""")
def exif_odd_to_epoch(spark, d):
    """Dates that no calendar has (year 0, month 0 and 14, day 32, hour 25), cut texts and ones that hold letters."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    rows = t(spark, d, "images").selectExpr("id", "id % 3000 AS y", "id % 15 AS mo", "id % 33 AS da", "id % 26 AS h", "id % 62 AS mi", "id % 61 AS s")
    text = F.concat(pad("y", 4), F.lit(":"), pad("mo", 2), F.lit(":"), pad("da", 2), F.lit(" "), pad("h", 2), F.lit(":"), pad("mi", 2), F.lit(":"), pad("s", 2))
    return rows.select("id", dates.exif_epoch(text).alias("epoch"), dates.exif_epoch(F.substring(text, 1, 18)).alias("short"), dates.exif_epoch(F.concat(F.lit("x"), F.substring(text, 2, 18))).alias("letters"))


@query("SELECT id, 'year ' || lpad((id % 3000)::VARCHAR, 4, '0') || ' %H' AS folder FROM images")
def folder_patterns(spark, d):
    """A pattern with a token that is not replaced, and characters between the fields that are not looked at."""
    text = F.concat(F.lpad((F.col("id") % 3000).cast("string"), 4, "0"), F.lit("-01/02T03.04_05"))
    return t(spark, d, "images").select("id", dates.folder(dates.exif_fields(text), "year %Y %H").alias("folder"))


@query("SELECT id, CASE WHEN id = 0 THEN 8192 ELSE greatest(8192, 1::BIGINT << (CASE WHEN ceil(id * 9.585)::BIGINT <= 1 THEN 0 ELSE length(bin(ceil(id * 9.585)::BIGINT - 1)) END)::BIGINT) END AS bits, 10 * id > CASE WHEN id = 0 THEN 8192 ELSE greatest(8192, 1::BIGINT << (CASE WHEN ceil(id * 9.585)::BIGINT <= 1 THEN 0 ELSE length(bin(ceil(id * 9.585)::BIGINT - 1)) END)::BIGINT) END AS rebuild FROM images")
def bloom_sizes(spark, d):
    """Bits of a filter for as many entries as each image's id says, and whether one more entry would have it built anew."""
    bits = bloom.bits_column("id")
    return t(spark, d, "images").select("id", bits.alias("bits"), bloom.too_full("id", bits).alias("rebuild"))


@query(f"SELECT id, round(embedding[1]::DOUBLE / CASE WHEN n > 1e-10 THEN n ELSE 1 END, 4) AS first, CASE WHEN n > 1e-10 THEN 1 ELSE 0 END AS length FROM (SELECT id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM face_detections WHERE {_VALID})")
def unit_vectors(spark, d):
    rows = t(spark, d, "face_detections").where((F.size("embedding") == DIM) & faces.finite("embedding"))
    u = faces.l2_normalize("embedding")
    return rows.select("id", F.round(u[0].cast("double"), 4).alias("first"), F.round(faces.norm(u), 4).cast("int").alias("length"))


@query("SELECT id, round(100.0 * bbox_x1 - 3, 6) AS x1, round(50.0 * bbox_y1 - 4, 6) AS y1, round(100.0 * bbox_x1 + 5, 6) AS x2, round(50.0 * bbox_y1 + 6, 6) AS y2 FROM face_detections WHERE bbox_x1 IS NOT NULL AND bbox_y1 IS NOT NULL")
def boxes_of_distances(spark, d):
    """Boxes at fixed distances around anchors."""
    rows = t(spark, d, "face_detections").where("bbox_x1 is not null and bbox_y1 is not null")
    box = detect.box_columns((F.col("bbox_x1") * 100, F.col("bbox_y1") * 50), tuple(F.lit(float(x)) for x in (3, 4, 5, 6)))
    return rows.select("id", *(F.round(c, 6).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), box)))


@query("""SELECT id, coalesce(list_aggregate(list_transform(list_filter(regexp_split_to_array(trim(name, ' '), ' +'), lambda x: x <> ''), lambda x: '"' || replace(x, '"', '""') || '"*'), 'string_agg', ' '), '') AS fts FROM persons WHERE name IS NOT NULL AND NOT regexp_matches(name, '[^ -~]')""")
def fts_texts(spark, d):
    """Full-text forms of the plain names."""
    return t(spark, d, "persons").where("name is not null and not name rlike '[^ -~]'").select("id", search.fts_column("name").alias("fts"))


@query("SELECT id, path, status, raw_path, make, iso, taken_at, coalesce(width, 0) * coalesce(height, 0) AS pixels FROM images")
def library_rows(spark, d):
    rows = search.library_rows(t(spark, d, "images"))
    return rows.select("id", "path", "status", "raw_path", "meta.make", "meta.iso", "meta.taken_at", (F.coalesce("meta.width", F.lit(0)) * F.coalesce("meta.height", F.lit(0))).alias("pixels"))


@query("""WITH m AS (SELECT collection_id, id, row_number() OVER (PARTITION BY collection_id ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY collection_id) AS n FROM collection_images WHERE collection_id IS NOT NULL)
    SELECT id, greatest(least(pos - (least(21, n) - 1) // 2, n - least(21, n)), 0) AS start_, greatest(least(pos - (least(21, n) - 1) // 2, n - least(21, n)), 0) + least(21, n) AS end_ FROM m""")
def buffer_windows(spark, d):
    """The window of pictures held around every member of every collection."""
    rows = t(spark, d, "collection_images").where("collection_id is not null")
    w = Window.partitionBy("collection_id")
    placed = rows.select("id", (F.row_number().over(w.orderBy("id")) - 1).cast("long").alias("at"), F.count("*").over(w).alias("n"))
    win = placed.select("id", geometry.buffer_window(F.col("at"), F.col("n"), F.lit(21)).alias("w"))
    return win.select("id", F.col("w.start").cast("long").alias("start_"), F.col("w.end").cast("long").alias("end_"))


@query("""WITH RECURSIVE u AS (SELECT vec_id, (list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))))::DOUBLE[64] AS e FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE array_inner_product(a.e, b.e) >= 0.3), reach AS (SELECT a AS id, b AS other FROM p UNION SELECT reach.id, p.b FROM reach JOIN p ON p.a = reach.other)
    SELECT id, least(id, min(other)) AS group_id FROM reach GROUP BY id""")
def similar_groups(spark, d):
    """Vectors joined by chains of cosines of at least 0.3."""
    return tournament.cosine_groups(t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), 64, 0.3)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'Copied ' || id || CASE WHEN id = 1 THEN ' image' ELSE ' images' END ELSE 'Copied ' || id || ', ' || id % 3 || ' failed' END AS text FROM images")
def copy_summaries(spark, d):
    return t(spark, d, "images").select("id", texts.copy_summary(F.col("id"), F.col("id") % 3).alias("text"))
