"""Queries of the commands on persons, faces, collections and sessions, and of what an import adds."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismarium.operators import collections, commands, faces
from prismarium.plans.registry import halves, halves_sql, query, t
from prismarium.streaming import workers


@query(f"""WITH {halves_sql('persons', 'created_at')}, log AS (SELECT id AS seq, name FROM persons UNION ALL SELECT id, 'The ' || name FROM n UNION ALL SELECT id + 1, 'The ' || name FROM n),
    l AS (SELECT name, min(seq) AS seq FROM log WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM b WHERE name IS NOT NULL) GROUP BY name)
    SELECT id, name, created_at FROM b UNION ALL SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY seq, name), name, 9 FROM l""")
def persons_upsert(spark, d):
    """Names of all persons and, twice, further forms of the later half's come to the persons of the earlier half."""
    rows = t(spark, d, "persons")
    base, new = halves(rows, "created_at")
    form = F.concat(F.lit("The "), F.col("name"))
    log = rows.select(F.col("id").alias("seq"), "name").union(new.select("id", form)).union(new.select(F.col("id") + 1, form))
    return commands.upsert_persons(base, log, 9)


@query("""SELECT id, image_id, person_id, confidence FROM face_detections WHERE person_id IS NOT NULL
    UNION ALL SELECT (SELECT max(id) FROM face_detections WHERE person_id IS NOT NULL) + row_number() OVER (ORDER BY id), image_id, NULL, confidence FROM face_detections WHERE person_id IS NULL""")
def faces_inserted(spark, d):
    """Faces without a person come to those that have one."""
    rows = t(spark, d, "face_detections")
    new = rows.where("person_id is null").withColumn("seq", F.col("id")).drop("id")
    return commands.insert_faces(rows.where("person_id is not null"), new).select("id", "image_id", "person_id", "confidence")


@query("SELECT id, CASE WHEN confidence < 0.5 THEN NULL ELSE image_id END AS person_id FROM face_detections")
def faces_assigned(spark, d):
    """Every face gets the number of its image as person, and those of low confidence lose it again."""
    rows = t(spark, d, "face_detections")
    log = rows.select(F.lit(1).alias("seq"), "id", F.col("image_id").alias("person_id")).union(rows.where("confidence < 0.5").select(F.lit(2), "id", F.lit(None).cast("long")))
    return commands.assign_faces(rows, log).select("id", "person_id")


_NAMED = """m AS (SELECT f.id, i.make FROM face_detections f JOIN images i ON i.id = f.image_id), l AS (SELECT make, min(id) AS seq FROM m WHERE make IS NOT NULL AND make NOT IN (SELECT name FROM persons WHERE name IS NOT NULL) GROUP BY make),
    p AS (SELECT id, name FROM persons UNION ALL SELECT (SELECT max(id) FROM persons) + row_number() OVER (ORDER BY seq, make), make FROM l)"""


def _named(spark, d):
    rows = t(spark, d, "face_detections")
    log = rows.join(t(spark, d, "images").select(F.col("id").alias("image_id"), F.col("make").alias("name")), "image_id").select(F.col("id").alias("seq"), "id", "name")
    return commands.assign_names(t(spark, d, "persons"), rows, log, 9)


@query(f"WITH {_NAMED} SELECT f.id, CASE WHEN m.id IS NOT NULL THEN (SELECT min(p.id) FROM p WHERE p.name = m.make) ELSE f.person_id END AS person_id FROM face_detections f LEFT JOIN m ON m.id = f.id")
def faces_named(spark, d):
    """Every face is assigned to a person called like its image's camera maker; no maker clears it."""
    return _named(spark, d)[1].select("id", "person_id")


@query(f"WITH {_NAMED} SELECT id, name FROM p")
def persons_of_names(spark, d):
    return _named(spark, d)[0].select("id", "name")


@query("""WITH s AS (SELECT DISTINCT 'From ' || source AS name FROM documents WHERE source IS NOT NULL), g AS (SELECT id, name, color FROM collections UNION ALL SELECT (SELECT max(id) FROM collections) + row_number() OVER (ORDER BY name), name, '#123456' FROM s)
    SELECT id, CASE WHEN color IS NULL THEN 'Plain ' || id ELSE name END AS name, CASE WHEN color = '#123456' THEN '#654321' ELSE color END AS color FROM g""")
def collection_changes(spark, d):
    """A collection for each source of documents is made, then those without a colour are renamed, and the new ones get another colour."""
    new = t(spark, d, "documents").where("source is not null").select(F.concat(F.lit("From "), "source").alias("name")).distinct()
    made = commands.create_collections(t(spark, d, "collections"), new.select(F.col("name").alias("seq"), "name", F.lit("#123456").alias("color")), 9)
    named = commands.rename_collections(made, made.where("color is null").select(F.lit(1).alias("seq"), "id", F.concat(F.lit("Plain "), F.col("id").cast("string")).alias("name")))
    return commands.color_collections(named, named.where("color = '#123456'").select(F.lit(1).alias("seq"), "id", F.lit("#654321").alias("color"))).select("id", "name", "color")


@query("SELECT 2 * id AS seq, path, file_size, raw_path FROM images WHERE raw_path IS NOT NULL AND status IS DISTINCT FROM 'missing'")
def import_commit(spark, d):
    """Rows to insert after images and their raw companions were copied, which failed for missing ones."""
    rows = t(spark, d, "images").where("raw_path is not null")
    shown = rows.select(F.col("id").alias("group_id"), (F.col("id") * 2).alias("seq"), F.col("path").alias("dest"), "hash", "file_size", F.lit(True).alias("is_display"), F.when(F.col("status") == "missing", "gone").alias("error"))
    raw = rows.select(F.col("id").alias("group_id"), (F.col("id") * 2 + 1).alias("seq"), F.col("raw_path").alias("dest"), F.lit(None).cast("binary").alias("hash"), F.lit(0).cast("long").alias("file_size"), F.lit(False).alias("is_display"), F.lit(None).cast("string").alias("error"))
    return commands.import_rows(shown.union(raw)).select("seq", "path", "file_size", "raw_path")


@query("SELECT id, CASE WHEN hash IS NOT NULL AND octet_length(hash) = 32 THEN path ELSE raw_path END AS raw_path FROM images")
def raw_paths_set(spark, d):
    """Images with a hash get their own path as raw path."""
    rows = t(spark, d, "images")
    log = rows.where("length(hash) = 32").select(F.lit(1).alias("seq"), "id", F.col("path").alias("raw_path"))
    return commands.set_raw_path(rows, log).select("id", "raw_path")


_ACTION = "CASE WHEN coalesce(confidence, 0) < 0.3 THEN 'back' WHEN person_id IS NULL THEN 'skip' ELSE 'assign' END"


@query(f"""WITH RECURSIVE l AS (SELECT image_id AS session, id, {_ACTION} AS action, row_number() OVER (PARTITION BY image_id ORDER BY id) AS r FROM face_detections WHERE image_id IS NOT NULL),
    s AS (SELECT session, 0::BIGINT AS r, []::BIGINT[] AS held FROM (SELECT DISTINCT session FROM l) UNION ALL SELECT l.session, l.r, CASE WHEN l.action = 'back' THEN s.held[:-2] ELSE list_append(s.held, l.id) END FROM s JOIN l ON l.session = s.session AND l.r = s.r + 1),
    e AS (SELECT session, arg_max(held, r) AS held FROM s GROUP BY session) SELECT e.session, f.id AS face_id, {_ACTION} AS action, f.person_id FROM (SELECT session, unnest(held) AS id FROM e) e JOIN face_detections f ON f.id = e.id""")
def tagging_sessions(spark, d):
    """Someone tags the faces of every image: those with a person are assigned, others skipped, and unsure ones make them go back a step."""
    rows = t(spark, d, "face_detections").where("image_id is not null")
    log = rows.select(F.col("image_id").alias("session"), F.col("id").alias("seq"), F.expr(_ACTION).alias("action"), F.col("id").alias("face_id"), "person_id")
    return workers.sessions(log).select("session", "face_id", "action", "person_id")


@query("SELECT c.id, c.name, coalesce(c.color, '#3584e4') AS color, c.created_at, (SELECT count(*) FROM collection_images m WHERE m.collection_id = c.id) AS image_count FROM collections c WHERE c.id = 2")
def collection_by_id(spark, d):
    return collections.by_id(t(spark, d, "collections"), t(spark, d, "collection_images"), 2)


@query("""WITH f AS (SELECT image_id, id, person_id, confidence, bbox_x1, bbox_y1, bbox_x2, bbox_y2, row_number() OVER (PARTITION BY image_id ORDER BY id) - 1 AS idx FROM face_detections WHERE image_id IS NOT NULL)
    SELECT image_id, min(idx) AS idx FROM f WHERE idx >= 1 AND person_id IS NULL AND confidence >= 0 AND NOT (bbox_x1 = 0 AND bbox_y1 = 0 AND bbox_x2 = 0 AND bbox_y2 = 0) GROUP BY image_id""")
def next_untagged_from(spark, d):
    """In every image the first untagged face at or after its second."""
    return faces.next_untagged_index(t(spark, d, "face_detections"), F.lit(1))
