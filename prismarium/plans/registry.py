"""All queries of the core, with DuckDB SQL for those that SQL can express. Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismarium.functions import bloom, dates, geometry, paths, texts
from prismarium.operators import browse, collections, commands, detect, faces, files, queues, seen, tournament
from prismarium.operators.search import SearchQuery, search, search_by_join, search_persons, where_camera

DIM, THRESHOLD, TOP = 96, 0.4, 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from prismarium.plans import changes, pieces  # noqa: F401 - they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _searched(spark: SparkSession, d: str, q: SearchQuery, how=search) -> DataFrame:
    found = how(*(t(spark, d, n) for n in ("images", "ai_descriptions", "face_detections", "persons", "collection_images")), q)
    return found.select("id", "path", "added_at", "status", "filename", "make", "model", "lens", "iso")


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_SHOWN = "i.id, i.path, i.added_at, i.status, i.filename, i.make, i.model, i.lens, i.iso"
_CAMERA = _LOW("coalesce(i.filename,'')||' '||coalesce(i.make,'')||' '||coalesce(i.model,'')||' '||coalesce(i.lens,'')")


def _search_sql(text: str | None, limit: int = 500, offset: int = 0, collection: int | None = None) -> str:
    member = f" AND i.id IN (SELECT image_id FROM collection_images WHERE collection_id = {collection})" if collection else ""
    if text is None:
        return f"SELECT {_SHOWN} FROM images i WHERE i.status = 'present'{member} ORDER BY i.added_at DESC, i.id LIMIT {limit} OFFSET {offset}"
    tokens = "".join(
        " AND (" + " OR ".join(f"contains({x}, '{w}')" for x in (_CAMERA, _LOW("coalesce(ad.description,'')"), _LOW("coalesce(p.name,'')"))) + ")" for w in text.lower().split()
    )
    return f"""SELECT DISTINCT {_SHOWN} FROM images i LEFT JOIN ai_descriptions ad ON ad.image_id = i.id LEFT JOIN face_detections fd ON fd.image_id = i.id
        LEFT JOIN persons p ON p.id = fd.person_id WHERE i.status = 'present'{tokens}{member} ORDER BY i.added_at DESC, i.id LIMIT {limit} OFFSET {offset}"""


# --- search ---------------------------------------------------------------------------------------------------------


@query(_search_sql(None))
def search_all(spark, d):
    return _searched(spark, d, SearchQuery())


@query(_search_sql("dscf"))
def search_text_one_token(spark, d):
    return _searched(spark, d, SearchQuery().with_text("  DSCF "))


@query(_search_sql("norvik someone"))
def search_text_two_tokens(spark, d):
    return _searched(spark, d, SearchQuery().with_text("Norvik someone"))


@query(_search_sql("jpg photo someone"))
def search_text_three_tokens(spark, d):
    return _searched(spark, d, SearchQuery().with_text("jpg photo someone"))


@query(_search_sql("norvik someone"))
def search_text_by_join(spark, d):
    return _searched(spark, d, SearchQuery().with_text("Norvik someone"), search_by_join)


@query(_search_sql("g_0"))
def search_text_wildcard_escaped(spark, d):
    return _searched(spark, d, SearchQuery().with_text("G_0"))


@query(_search_sql("é"))
def search_text_accent(spark, d):
    return _searched(spark, d, SearchQuery().with_text("É"))


@query(_search_sql(None, collection=2))
def search_collection(spark, d):
    return _searched(spark, d, SearchQuery().with_collection(2))


@query(_search_sql("norvik", collection=2))
def search_text_in_collection(spark, d):
    return _searched(spark, d, SearchQuery().with_text("norvik").with_collection(2))


@query(_search_sql(None, 50, 120))
def search_page(spark, d):
    return _searched(spark, d, SearchQuery().with_limit(50).with_offset(120))


@query(f"SELECT id, name FROM persons WHERE {_LOW('name')} LIKE '%a_n%' ORDER BY name, id")
def persons_search(spark, d):
    return search_persons(t(spark, d, "persons"), "A_n")


@query("SELECT id, path, taken_at, iso, make FROM images WHERE taken_at >= 1400000000 AND taken_at <= 1600000000 AND iso >= 200 AND translate(make, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'norvik'")
def search_camera(spark, d):
    return where_camera(t(spark, d, "images"), 1_400_000_000, 1_600_000_000, 200, None, "Norvik").select("id", "path", "taken_at", "iso", "make")


# --- queues, scans and lookups ----------------------------------------------------------------------------------------


@query("SELECT i.id, i.path FROM images i WHERE i.status = 'present' AND NOT EXISTS (SELECT 1 FROM ai_descriptions a WHERE a.image_id = i.id AND a.model_id = (SELECT min(model_id) FROM ai_descriptions))")
def queue_ai(spark, d):
    said = t(spark, d, "ai_descriptions")
    model = said.agg(F.min("model_id")).first()[0]
    return queues.needing_description(t(spark, d, "images"), said, model)


@query("SELECT i.id, i.path FROM images i WHERE i.status = 'present' AND NOT EXISTS (SELECT 1 FROM face_detections f WHERE f.image_id = i.id)")
def queue_faces(spark, d):
    return queues.needing_faces(t(spark, d, "images"), t(spark, d, "face_detections"))


@query("SELECT id, path FROM images WHERE filename IS NULL")
def queue_metadata(spark, d):
    return queues.needing_metadata(t(spark, d, "images"))


@query("SELECT id, path FROM images WHERE coalesce(taken_at::VARCHAR, make, model, lens, focal_length::VARCHAR, aperture::VARCHAR, iso::VARCHAR, width::VARCHAR, height::VARCHAR, orientation::VARCHAR) IS NULL")
def queue_never_extracted(spark, d):
    return queues.never_extracted(t(spark, d, "images"))


_REAL = "confidence >= 0 AND NOT (bbox_x1 = 0 AND bbox_y1 = 0 AND bbox_x2 = 0 AND bbox_y2 = 0)"


@query(f"SELECT DISTINCT f.image_id FROM face_detections f JOIN images i ON i.id = f.image_id WHERE f.person_id IS NULL AND {_REAL} AND i.status = 'present'")
def untagged_images(spark, d):
    return queues.with_untagged_faces(t(spark, d, "images"), t(spark, d, "face_detections"))


@query("SELECT DISTINCT image_id FROM face_detections WHERE person_id IN (1, 3, 7)")
def images_for_persons(spark, d):
    return queues.of_persons(t(spark, d, "face_detections"), [1, 3, 7])


@query("SELECT f.id AS face_id, f.person_id, p.name, len(f.embedding) AS dims FROM face_detections f JOIN persons p ON p.id = f.person_id")
def assigned_faces(spark, d):
    found = queues.assigned_embeddings(t(spark, d, "face_detections"), t(spark, d, "persons"))
    return found.select("face_id", "person_id", "name", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dims"))


@query("SELECT count(*) AS images, count(*) FILTER (WHERE status = 'missing') AS missing, count(DISTINCT path) AS paths FROM images")
def image_counts(spark, d):
    return t(spark, d, "images").agg(F.count("*").alias("images"), F.count_if(F.col("status") == "missing").alias("missing"), F.countDistinct("path").alias("paths"))


@query("SELECT path, CASE WHEN status = 'missing' THEN 'missing' ELSE 'present' END AS status FROM images")
def all_paths(spark, d):
    return t(spark, d, "images").select("path", texts.status("status").alias("status"))


@query("SELECT id, path, file_size, added_at FROM images WHERE octet_length(hash) = 32")
def all_images(spark, d):
    return queues.newest_first(t(spark, d, "images")).select("id", "path", "file_size", "added_at")


@query("SELECT id, path, make FROM images WHERE id = 7")
def image_by_id(spark, d):
    return queues.by_id(t(spark, d, "images"), 7).select("id", "path", "make")


@query("SELECT model_id, description FROM ai_descriptions WHERE image_id = (SELECT min(image_id) FROM ai_descriptions)")
def descriptions_for_image(spark, d):
    said = t(spark, d, "ai_descriptions")
    return queues.descriptions_of(said, said.agg(F.min("image_id")).first()[0])


@query("SELECT id, person_id, confidence FROM face_detections WHERE image_id = (SELECT min(image_id) FROM face_detections)")
def faces_for_image(spark, d):
    rows = t(spark, d, "face_detections")
    return queues.faces_of(rows, rows.agg(F.min("image_id")).first()[0]).select("id", "person_id", "confidence")


# --- collections ------------------------------------------------------------------------------------------------------


@query("SELECT c.id, c.name, coalesce(c.color, '#3584e4') AS color, c.created_at, (SELECT count(*) FROM collection_images m WHERE m.collection_id = c.id) AS image_count FROM collections c")
def collections_with_counts(spark, d):
    return collections.with_counts(t(spark, d, "collections"), t(spark, d, "collection_images"))


@query("SELECT DISTINCT m.image_id, c.id, c.name, (SELECT count(*) FROM collection_images x WHERE x.collection_id = c.id) AS image_count FROM collections c JOIN collection_images m ON m.collection_id = c.id WHERE m.image_id IS NOT NULL")
def collections_for_image(spark, d):
    return collections.of_images(t(spark, d, "collections"), t(spark, d, "collection_images"))


@query("SELECT c.id, c.name, EXISTS (SELECT 1 FROM collection_images m WHERE m.collection_id = c.id AND m.image_id = (SELECT min(image_id) FROM collection_images)) AS is_member FROM collections c")
def collection_picker(spark, d):
    members = t(spark, d, "collection_images")
    return collections.picker(t(spark, d, "collections"), members, members.agg(F.min("image_id")).first()[0])


@query("SELECT id, CASE WHEN n = 1 THEN '1 image' ELSE n || ' images' END AS subtitle FROM (SELECT c.id, count(m.id) AS n FROM collections c LEFT JOIN collection_images m ON m.collection_id = c.id GROUP BY c.id)")
def collection_subtitles(spark, d):
    counted = collections.with_counts(t(spark, d, "collections"), t(spark, d, "collection_images"))
    return counted.select("id", texts.count_of_images("image_count").alias("subtitle"))


# --- faces: every row whose id is divisible by 20 asks, all rows with a person answer --------------------------------------

_VALID = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SIMS = f"""WITH q AS (SELECT id AS query_id, embedding::DOUBLE[] AS e FROM face_detections WHERE id % 20 = 0 AND {_VALID}),
    k AS (SELECT person_id, embedding::DOUBLE[] AS e FROM face_detections WHERE person_id IS NOT NULL AND {_VALID} AND person_id IN (SELECT id FROM persons)),
    s AS (SELECT query_id, person_id, max(list_dot_product(q.e, k.e)) AS similarity FROM q, k GROUP BY 1, 2)"""


def _asked(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, persons = t(spark, d, "face_detections"), t(spark, d, "persons")
    known = rows.where("person_id is not null").select("person_id", "embedding").join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), known, persons


@query(_SIMS + f" SELECT query_id, person_id, round(similarity, 6) AS similarity FROM s WHERE round(similarity, 9) >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, person_id) = 1")
def face_best_match(spark, d):
    asked, known, _ = _asked(spark, d)
    return faces.best_matches(asked, known, DIM, THRESHOLD, 1).select("query_id", "person_id", F.round("similarity", 6).alias("similarity"))


@query(_SIMS + f" SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, person_id) AS rank, person_id, round(similarity, 6) AS similarity FROM s WHERE round(similarity, 9) >= {THRESHOLD} QUALIFY rank <= {TOP}")
def face_topk(spark, d):
    asked, known, _ = _asked(spark, d)
    return faces.best_matches(asked, known, DIM, THRESHOLD, TOP).select("query_id", "rank", "person_id", F.round("similarity", 6).alias("similarity"))


@query(
    _SIMS
    + f""", none AS (SELECT id AS person_id FROM persons WHERE id NOT IN (SELECT person_id FROM k)), u AS (SELECT query_id, person_id, similarity FROM s UNION ALL SELECT q.query_id, none.person_id, NULL FROM q, none)
    SELECT query_id, rank, u.person_id, name, similarity FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC NULLS LAST, person_id) AS rank, person_id, round(similarity, 6) AS similarity FROM u QUALIFY rank <= {TOP}) u JOIN persons p ON p.id = u.person_id
    UNION ALL SELECT f.id, n.rank, n.id, n.name, NULL FROM face_detections f, (SELECT id, name, row_number() OVER (ORDER BY name, id) AS rank FROM persons QUALIFY rank <= {TOP}) n WHERE f.id % 20 = 0 AND NOT coalesce({_VALID}, false)"""
)
def face_topk_with_unscored(spark, d):
    asked, known, persons = _asked(spark, d)
    return faces.top_k(asked, known, persons, DIM, TOP).withColumn("similarity", F.round("similarity", 6))


@query(
    _SIMS
    + f""", best AS (SELECT query_id, person_id FROM s WHERE round(similarity, 9) >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, person_id) = 1)
    SELECT f.id AS face_id, CASE WHEN f.person_id IS NOT NULL THEN coalesce(p.name, '?') ELSE coalesce(b.name, '?') END AS label, f.person_id IS NOT NULL AS assigned, f.person_id IS NULL AND b.name IS NOT NULL AS suggestion
    FROM face_detections f LEFT JOIN persons p ON p.id = f.person_id LEFT JOIN best ON best.query_id = f.id AND f.person_id IS NULL LEFT JOIN persons b ON b.id = best.person_id WHERE f.id % 20 = 0"""
)
def face_labels(spark, d):
    _, known, persons = _asked(spark, d)
    return faces.labels(t(spark, d, "face_detections").where("id % 20 = 0"), known, persons, DIM, THRESHOLD)


@query(f"SELECT id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM face_detections WHERE {_VALID}")
def embedding_norms(spark, d):
    rows = t(spark, d, "face_detections").where((F.size("embedding") == DIM) & faces.finite("embedding"))
    return rows.select("id", F.round(faces.norm("embedding"), 5).alias("norm"))


@query(f"SELECT id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS self, octet_length(''::BLOB) + 4 * len(embedding) AS bytes FROM face_detections WHERE {_VALID}")
def embedding_round_trip(spark, d):
    rows = t(spark, d, "face_detections").where((F.size("embedding") == DIM) & faces.finite("embedding"))
    back = rows.select("id", faces.to_blob("embedding").alias("blob")).withColumn("v", faces.from_blob("blob"))
    return back.select("id", F.round(faces.dot("v", "v"), 4).alias("self"), F.length("blob").cast("long").alias("bytes"))


@query(f"SELECT image_id, id AS face_id, row_number() OVER (PARTITION BY image_id ORDER BY id) AS position, count(*) OVER (PARTITION BY image_id) AS total FROM face_detections WHERE {_REAL} AND image_id IS NOT NULL")
def tagging_progress(spark, d):
    return faces.tagging_progress(t(spark, d, "face_detections"))


@query(f"SELECT image_id, min(id) AS face_id FROM face_detections WHERE {_REAL} AND person_id IS NULL AND image_id IS NOT NULL GROUP BY image_id")
def next_untagged(spark, d):
    return faces.next_untagged(t(spark, d, "face_detections"))


@query(f"""WITH r AS (SELECT f.id, i.width::DOUBLE AS iw, i.height::DOUBLE AS ih, bbox_x1, bbox_y1, bbox_x2, bbox_y2 FROM face_detections f JOIN images i ON i.id = f.image_id WHERE {_REAL}),
    z AS (SELECT *, least(1280.0 / iw, 720.0 / ih) AS fit FROM r WHERE iw <> 0 AND ih <> 0)
    SELECT id, round((1280 - iw * fit) / 2 + bbox_x1 * iw * fit, 3) AS x, round((720 - ih * fit) / 2 + bbox_y1 * ih * fit, 3) AS y, round((bbox_x2 - bbox_x1) * iw * fit, 3) AS w, round(bbox_x1 * iw * fit * 2.5 - 40, 3) AS zoomed_x,
    640 BETWEEN (1280 - iw * fit) / 2 + bbox_x1 * iw * fit AND (1280 - iw * fit) / 2 + bbox_x2 * iw * fit AND 360 BETWEEN (720 - ih * fit) / 2 + bbox_y1 * ih * fit AND (720 - ih * fit) / 2 + bbox_y2 * ih * fit AS hit FROM z""")
def screen_rects(spark, d):
    rows = t(spark, d, "face_detections").where(geometry.real_face()).alias("f").join(t(spark, d, "images").select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    box = tuple(F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2"))
    size, view = (F.col("width").cast("double"), F.col("height").cast("double")), (F.lit(1280.0), F.lit(720.0))
    plain = geometry.screen_rect(box, size, view, F.lit(1.0), (F.lit(0.0), F.lit(0.0)))
    zoomed = geometry.screen_rect(box, size, view, F.lit(2.5), (F.lit(40.0), F.lit(0.0)))
    rects = rows.select("id", plain.alias("r"), zoomed.alias("z")).where("r is not null")
    return rects.select("id", F.round("r.x", 3).alias("x"), F.round("r.y", 3).alias("y"), F.round("r.w", 3).alias("w"), F.round("z.x", 3).alias("zoomed_x"), geometry.hit(F.col("r"), F.lit(640.0), F.lit(360.0)).alias("hit"))


@query("SELECT id, greatest(least(bbox_x1 * 2 - 0.5, 1), 0) AS x1, greatest(least(bbox_y2 * 2 - 0.5, 1), 0) AS y2 FROM face_detections WHERE bbox_x1 IS NOT NULL AND bbox_y2 IS NOT NULL")
def clamped_boxes(spark, d):
    rows = t(spark, d, "face_detections").where("bbox_x1 is not null and bbox_y2 is not null")
    return rows.select("id", geometry.clamp01(F.col("bbox_x1") * 2 - 0.5).alias("x1"), geometry.clamp01(F.col("bbox_y2") * 2 - 0.5).alias("y2"))


_BOXES = ", ".join(f"bbox_{c} * 1000 AS {c}" for c in ("x1", "y1", "x2", "y2"))
_SHARED = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0)"
_AREA = "({0}.x2 - {0}.x1 + 1) * ({0}.y2 - {0}.y1 + 1)".format


@query(f"""WITH RECURSIVE f AS (SELECT image_id, id, {_BOXES}, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, id) AS r FROM face_detections
        WHERE {_REAL} AND image_id IS NOT NULL AND bbox_x1 IS NOT NULL AND bbox_y1 IS NOT NULL AND bbox_x2 IS NOT NULL AND bbox_y2 IS NOT NULL),
    o AS (SELECT a.image_id, b.r, list(a.r) AS over FROM f a JOIN f b ON a.image_id = b.image_id AND a.r < b.r WHERE {_SHARED} / ({_AREA('a')} + {_AREA('b')} - {_SHARED}) > 0.5 GROUP BY 1, 2),
    s AS (SELECT image_id, r, [r] AS kept FROM f WHERE r = 1 UNION ALL SELECT f.image_id, f.r, CASE WHEN len(list_intersect(s.kept, coalesce(o.over, []))) > 0 THEN s.kept ELSE list_append(s.kept, f.r) END
        FROM s JOIN f ON f.image_id = s.image_id AND f.r = s.r + 1 LEFT JOIN o ON o.image_id = f.image_id AND o.r = f.r)
    SELECT f.image_id, f.id FROM f JOIN s ON s.image_id = f.image_id AND s.r = f.r WHERE list_contains(s.kept, f.r)""")
def suppressed_faces(spark, d):
    """Non-maximum suppression within every image, boxes in thousandths of the picture."""
    rows = t(spark, d, "face_detections").where(geometry.real_face())
    scaled = rows.select("image_id", "id", "confidence", *((F.col(f"bbox_{c}") * 1000).alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")))
    return detect.suppress_faces(scaled).select("image_id", "id")


@query("SELECT n.i AS n, ((n.i // 2) % 80) * 8 AS x, ((n.i // 2) // 80) * 8 AS y FROM (SELECT unnest(range(80 * 80 * 2)) AS i) n")
def anchor_grid(spark, d):
    return detect.anchors_table(spark, 80, 80, 8)


# --- seen content -------------------------------------------------------------------------------------------------------


@query("SELECT hex(hash) AS hash, count(*) AS copies, min(id) AS first_id FROM images WHERE octet_length(hash) = 32 GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, d):
    return seen.duplicates(t(spark, d, "images")).select(F.hex("hash").alias("hash"), "copies", "first_id")


def _flagged(spark, d) -> DataFrame:
    """Images with whether their content is in the library as present (imported) or as missing (rejected)."""
    rows = t(spark, d, "images")
    return seen.flags(rows.select("id", "path", "hash"), rows.where("status = 'present' and raw_path is not null").select("hash"), rows.where("status = 'missing'").select("hash"))


_FLAGS = "WITH f AS (SELECT id, path, coalesce(hash IN (SELECT hash FROM images WHERE status = 'present' AND raw_path IS NOT NULL AND hash IS NOT NULL), false) AS imported, coalesce(hash IN (SELECT hash FROM images WHERE status = 'missing' AND hash IS NOT NULL), false) AS rejected FROM images)"


@query(_FLAGS + " SELECT id, imported, rejected FROM f")
def seen_flags(spark, d):
    return _flagged(spark, d).select("id", "imported", "rejected")


@query(_FLAGS + " SELECT id FROM f WHERE NOT imported AND NOT rejected")
def unseen_only(spark, d):
    return seen.visible(_flagged(spark, d)).select("id")


@query(_FLAGS + " SELECT CASE WHEN i + r > 0 THEN n || ' images (' || i || ' imported, ' || r || ' skipped)' ELSE n || ' images' END AS summary FROM (SELECT count(*) AS n, count(*) FILTER (WHERE imported) AS i, count(*) FILTER (WHERE rejected) AS r FROM f)")
def scan_summary(spark, d):
    counts = _flagged(spark, d).agg(F.count("*").alias("n"), F.count_if("imported").alias("i"), F.count_if("rejected").alias("r"))
    return counts.select(texts.scan_summary(F.col("n"), F.col("i"), F.col("r")).alias("summary"))


_FOLDER = r"regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', '')"


@query(
    _FLAGS
    + f""", g AS (SELECT {_FOLDER} AS folder, id AS idx, imported OR rejected AS hidden FROM f)
    SELECT folder, idx, max(CASE WHEN NOT hidden THEN idx END) OVER (PARTITION BY folder ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_visible,
    min(CASE WHEN NOT hidden THEN idx END) OVER (PARTITION BY folder ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_visible FROM g"""
)
def next_visible(spark, d):
    return seen.neighbours_visible(_flagged(spark, d).select(paths.parent("path").alias("folder"), F.col("id").alias("idx"), "imported", "rejected"))


def _le(first: int) -> str:
    return "('0x' || " + " || ".join(f"substr(h, {2 * (first + k) - 1}, 2)" for k in range(7, -1, -1)) + ")::UBIGINT"


@query(f"WITH x AS (SELECT id, hex(hash) AS h FROM images WHERE octet_length(hash) = 32), y AS (SELECT id, {_le(1)} AS a, ({_le(9)} | 1::UBIGINT) AS b FROM x), n AS (SELECT unnest(range(7)) AS i) SELECT id, i::INT AS probe, ((a::HUGEINT + i::HUGEINT * b::HUGEINT) % 65536)::BIGINT AS position FROM y, n")
def bloom_positions(spark, d):
    rows = t(spark, d, "images").where("length(hash) = 32").select("id", F.posexplode(bloom.position_column("hash", 65536)))
    return rows.select("id", F.col("pos").alias("probe"), F.col("col").alias("position"))


@query(f"""WITH c AS (SELECT greatest(8192, 1::BIGINT << length(bin(ceil(count(*) * 9.585)::BIGINT - 1))::BIGINT) AS bits FROM images WHERE status = 'missing'),
    x AS (SELECT id, coalesce(status = 'missing', false) AS gone, hex(hash) AS h FROM images WHERE octet_length(hash) = 32), y AS (SELECT id, gone, {_le(1)} AS a, ({_le(9)} | 1::UBIGINT) AS b FROM x),
    p AS (SELECT id, gone, (a::HUGEINT + i::HUGEINT * b::HUGEINT) % bits AS place FROM y, c, (SELECT unnest(range(7)) AS i))
    SELECT id FROM p WHERE place IN (SELECT place FROM p WHERE gone) GROUP BY id HAVING count(*) = 7""")
def bloom_seen(spark, d):
    """Images of any status whose content the bloom filter of missing ones may hold."""
    rows = t(spark, d, "images")
    table, bits = seen.bloom_table(rows.where("status = 'missing'").select("hash"))
    return seen.probably_seen(rows.select("id", "hash"), table, bits).select("id")


@query(
    _FLAGS
    + f""", g AS (SELECT {_FOLDER} AS session, id AS idx, imported, rejected FROM f), n AS (SELECT *, count(*) OVER (PARTITION BY session) AS many FROM g)
    SELECT session, idx, many > 1 AND rejected AS selected, CASE WHEN many > 1 AND rejected THEN false ELSE rejected OR NOT imported END AS rejected FROM n"""
)
def browse_decisions(spark, d):
    """Someone goes through every folder and, in those with several images, selects what was rejected before; leaving an image comes last."""
    seen_ = _flagged(spark, d).select(paths.parent("path").alias("session"), F.col("id").alias("idx"), "imported", "rejected")
    many = F.count("*").over(Window.partitionBy("session")) > 1
    leave = seen_.select("session", F.lit(2).alias("seq"), "idx", F.lit("leave").alias("action"))
    toggle = seen_.withColumn("many", many).where("many and rejected").select("session", F.lit(1).alias("seq"), "idx", F.lit("toggle").alias("action"))
    return browse.decisions(leave.union(toggle), seen_)


# --- files --------------------------------------------------------------------------------------------------------------

_BASE = r"regexp_replace(path, '^.*/', '')"
_STEM = rf"CASE WHEN {_BASE} LIKE '_%.%' THEN regexp_replace({_BASE}, '^(.+)\.[^.]*$', '\1') ELSE {_BASE} END"
_EXT = rf"regexp_extract({_BASE}, '^.+\.([^.]*)$', 1)"


@query(f"SELECT DISTINCT path, {_BASE} AS name, {_FOLDER} AS folder, {_STEM} AS stem, {_LOW(_EXT)} AS extension, {_LOW(_EXT)} = 'raf' AS is_raw, {_LOW(_EXT)} IN ('jpg','jpeg','png','raf') AND {_BASE} NOT LIKE '.%' AS is_image, CASE {_LOW(_EXT)} WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' ELSE 'image/jpeg' END AS mime FROM images WHERE path IS NOT NULL")
def path_parts(spark, d):
    p = t(spark, d, "images").where("path is not null").select("path").distinct()
    return p.select("path", paths.basename("path").alias("name"), paths.parent("path").alias("folder"), paths.stem("path").alias("stem"), paths.lower_extension("path").alias("extension"), paths.is_raw("path").alias("is_raw"), paths.is_image("path").alias("is_image"), paths.mime_type("path").alias("mime"))


_FILES = """own AS (SELECT path, max(file_size) AS size FROM images WHERE path IS NOT NULL GROUP BY path),
    files AS (SELECT path, size FROM own UNION ALL SELECT DISTINCT raw_path, 0 FROM images WHERE raw_path IS NOT NULL AND raw_path NOT IN (SELECT path FROM own))"""
_GROUPED = f"""{_FILES}, keyed AS (SELECT *, {_FOLDER} AS dir, {_LOW(_STEM)} AS stem, {_LOW(_EXT)} = 'raf' AS raw FROM files),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY raw, string_split(path, '/')) AS r, count(*) OVER (PARTITION BY dir, stem) AS n FROM keyed),
    rest AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY string_split(path, '/')) AS c FROM ranked WHERE r > 1),
    g AS (SELECT k.dir, k.stem, k.path AS display_path, k.size AS display_size, k.n - 1 AS companions, (SELECT x.path FROM rest x WHERE x.dir = k.dir AND x.stem = k.stem AND x.c = 1) AS first_companion FROM ranked k WHERE r = 1)"""


def _groups(spark, d) -> DataFrame:
    return files.group_files(files.listing(t(spark, d, "images")))


@query(f"WITH {_GROUPED} SELECT dir, stem, display_path, display_size, companions, first_companion FROM g")
def file_groups(spark, d):
    return _groups(spark, d).select("dir", "stem", F.col("display.path").alias("display_path"), F.col("display.size").alias("display_size"), F.size("companions").cast("long").alias("companions"), F.try_element_at("companions", F.lit(1))["path"].alias("first_companion"))


@query(f"WITH {_GROUPED} SELECT count(*) AS groups, count(*) FILTER (WHERE companions > 0) AS with_companions FROM g")
def companion_counts(spark, d):
    return files.companions_count(_groups(spark, d))


@query(f"WITH {_GROUPED} SELECT g.display_path, r.path FROM g JOIN ranked r USING (dir, stem) WHERE CASE WHEN EXISTS (SELECT 1 FROM rest x WHERE x.dir = g.dir AND x.stem = g.stem AND x.raw) THEN r.r > 1 AND r.raw ELSE r.r = 1 END")
def copy_raw_only(spark, d):
    return files.paths_for_copy(_groups(spark, d), "raw_only").select("display_path", "path")


@query(f"WITH {_GROUPED} SELECT g.display_path, r.path FROM g JOIN ranked r USING (dir, stem)")
def copy_all(spark, d):
    return files.paths_for_copy(_groups(spark, d), "all").select("display_path", "path")


@query("SELECT id, CASE WHEN taken_at IS NULL THEN '/out' ELSE '/out/' || strftime(make_timestamp(taken_at * 1000000), '%Y/%m') END AS dir FROM images WHERE taken_at IS NULL OR taken_at >= 0")
def exif_folder(spark, d):
    rows = t(spark, d, "images").where("taken_at is null or taken_at >= 0").withColumn("taken", dates.exif_text("taken_at"))
    return rows.select("id", files.target_dir("/out", "%Y/%m", "taken").alias("dir"))


_DATED = "CASE WHEN taken_at IS NULL THEN '/out' ELSE '/out/' || strftime(make_timestamp(taken_at * 1000000), '%Y/%m') END"
_SUFFIX = rf"CASE WHEN {_BASE} LIKE '_%.%' THEN '.' || regexp_extract({_BASE}, '^.+\.([^.]*)$', 1) ELSE '' END"


@query(rf"""WITH RECURSIVE w AS (SELECT id, path, {_DATED} AS dir, {_BASE} AS name, {_STEM} AS stem, {_SUFFIX} AS ext FROM images WHERE path IS NOT NULL),
    old AS (SELECT DISTINCT {_DATED} AS dir, regexp_replace(raw_path, '^.*/', '') AS name FROM images WHERE path IS NOT NULL AND raw_path IS NOT NULL),
    k AS (SELECT *, regexp_replace({_LOW('stem')}, '(_\d+)+$', '') AS meet FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY dir, meet ORDER BY id, path) AS r FROM k),
    there AS (SELECT dir, regexp_replace({_LOW(_STEM.replace('path', 'name'))}, '(_\d+)+$', '') AS meet, list(name) AS names FROM old GROUP BY 1, 2),
    s AS (SELECT dir, meet, 0::BIGINT AS r, coalesce(names, []) AS used, NULL::VARCHAR AS source FROM (SELECT DISTINCT dir, meet FROM k) LEFT JOIN there USING (dir, meet)
        UNION ALL SELECT r.dir, r.meet, r.r, list_append(s.used, list_filter(list_prepend(r.name, list_transform(range(1, len(s.used) + 2), lambda i: r.stem || '_' || i || r.ext)), lambda x: NOT list_contains(s.used, x))[1]), r.path
        FROM s JOIN r ON r.dir = s.dir AND r.meet = s.meet AND r.r = s.r + 1)
    SELECT source, dir || '/' || used[-1] AS target FROM s WHERE source IS NOT NULL""")
def copy_plan(spark, d):
    """Targets of all image files below dated folders, beside the raw files that are there."""
    rows = t(spark, d, "images").where("path is not null").withColumn("taken", dates.exif_text("taken_at"))
    plan = rows.select(files.target_dir("/out", "%Y/%m", "taken").alias("dir"), F.col("path").alias("source"), F.col("id").alias("seq"))
    there = rows.where("raw_path is not null").select(F.concat(files.target_dir("/out", "%Y/%m", "taken"), F.lit("/"), paths.basename("raw_path")).alias("path")).distinct()
    return files.name_copies(plan, there)


_KEYED = f"keyed AS (SELECT id, path, {_FOLDER} AS dir, {_LOW(_STEM)} AS stem, {_LOW(_EXT)} = 'raf' AS raw FROM images WHERE path IS NOT NULL), pairs AS (SELECT min(CASE WHEN NOT raw THEN id END) AS keep, min(CASE WHEN raw THEN id END) AS gone, arg_min(path, id) FILTER (WHERE raw) AS merged FROM keyed GROUP BY dir, stem HAVING keep IS NOT NULL AND gone IS NOT NULL)"


@query(f"WITH {_KEYED} SELECT i.id, i.path, coalesce(p.merged, i.raw_path) AS raw_path FROM images i LEFT JOIN pairs p ON p.keep = i.id WHERE i.id NOT IN (SELECT gone FROM pairs)")
def raf_pairs_merged(spark, d):
    return files.merge_raw_rows(t(spark, d, "images"))[0].select("id", "path", "raw_path")


@query(f"""WITH {_GROUPED}, known AS (SELECT DISTINCT path, CASE WHEN status = 'missing' THEN 'missing' ELSE 'present' END AS status FROM images WHERE path IS NOT NULL),
    b AS (SELECT coalesce(k.path, g.display_path) AS path, k.status, g.display_path IS NOT NULL AS on_disk, g.display_size, g.first_companion FROM known k FULL OUTER JOIN g ON g.display_path = k.path),
    a AS (SELECT path, CASE WHEN status IS NULL THEN 'insert' WHEN NOT on_disk AND status = 'present' THEN 'mark_missing' WHEN on_disk AND status = 'missing' THEN 'mark_present' END AS action, display_size, first_companion FROM b)
    SELECT path, action, CASE WHEN action = 'insert' THEN display_size END AS size, CASE WHEN action = 'insert' THEN first_companion END AS raw_path FROM a WHERE action IS NOT NULL""")
def reconcile_actions(spark, d):
    return files.reconcile(t(spark, d, "images").select("path", "status"), _groups(spark, d))


# --- dates and texts ------------------------------------------------------------------------------------------------------


@query("SELECT id, taken_at AS epoch FROM images WHERE taken_at BETWEEN -62135596800 AND 253402300799")
def exif_to_epoch(spark, d):
    rows = t(spark, d, "images").where("taken_at between -62135596800 and 253402300799")
    return rows.select("id", dates.exif_epoch(dates.exif_text("taken_at")).alias("epoch"))


@query("SELECT id, strftime(make_timestamp(added_at * 1000000), '%Y-%m-%d  %H:%M:%S') AS added FROM images WHERE added_at IS NOT NULL")
def timestamps(spark, d):
    return t(spark, d, "images").where("added_at is not null").select("id", dates.timestamp_text("added_at").alias("added"))


@query("SELECT id, concat_ws(' · ', CASE WHEN make IS NOT NULL THEN concat_ws(' ', make, model) END, lens, printf('%.0f', focal_length) || ' mm  f/' || printf('%.1f', aperture), 'ISO ' || iso, width || ' × ' || height) AS line FROM images")
def info_line(spark, d):
    return t(spark, d, "images").select("id", texts.info_line().alias("line"))


@query("SELECT id, CASE orientation WHEN 1 THEN 'Normal' WHEN 2 THEN 'Mirrored horizontally' WHEN 3 THEN 'Rotated 180°' WHEN 4 THEN 'Mirrored vertically' WHEN 5 THEN 'Mirrored + rotated 90° CW' WHEN 6 THEN 'Rotated 90° CW' WHEN 7 THEN 'Mirrored + rotated 90° CCW' WHEN 8 THEN 'Rotated 90° CCW' ELSE CASE WHEN orientation IS NOT NULL THEN 'Unknown' END END AS label FROM images")
def orientation_labels(spark, d):
    return t(spark, d, "images").select("id", texts.orientation("orientation").alias("label"))


@query("SELECT id, CASE WHEN isfinite(confidence) THEN printf('%.1f', confidence * 100) || '%' END AS pct, CASE WHEN isfinite(confidence) THEN CASE WHEN confidence * 100 >= 80 THEN 'success' WHEN confidence * 100 >= 50 THEN 'warning' ELSE 'dim-label' END END AS class FROM face_detections")
def similarity_texts(spark, d):
    return t(spark, d, "face_detections").select("id", texts.similarity_text("confidence").alias("pct"), texts.similarity_class("confidence").alias("class"))



@query("SELECT id, least(greatest(orientation - (least(21, 8) - 1) // 2, 0), 8 - least(21, 8)) AS start_, 8 AS end_ FROM images WHERE orientation BETWEEN 1 AND 8")
def buffer_window(spark, d):
    w = geometry.buffer_window(F.col("orientation"), F.lit(8), F.lit(21))
    return t(spark, d, "images").where("orientation between 1 and 8").select("id", w.alias("w")).select("id", F.col("w.start").alias("start_"), F.col("w.end").cast("int").alias("end_"))


@query("WITH s AS (SELECT id, width, height, least(1400.0 / nullif(width, 0), 778.0 / nullif(height, 0)) AS k FROM images WHERE width > 0 AND height > 0) SELECT id, greatest(round(width * k)::INT, 400) AS w, greatest(round(height * k)::INT + 82, 300) AS h FROM s")
def window_sizes(spark, d):
    rows = t(spark, d, "images").where("width > 0 and height > 0")
    return rows.select("id", geometry.window_size(F.col("width"), F.col("height")).alias("s")).select("id", "s.w", "s.h")


# --- changes as commands -----------------------------------------------------------------------------------------------------


def halves(df: DataFrame, time: str) -> tuple[DataFrame, DataFrame]:
    """What was there before the table's mean time, and all other rows, which come to it."""
    mean = df.agg(F.avg(time)).first()[0]
    old = F.coalesce(F.col(time) < F.lit(mean), F.lit(False))
    return df.where(old), df.where(~old)


def halves_sql(table: str, time: str) -> str:
    return f"b AS (SELECT * FROM {table} WHERE {time} < (SELECT avg({time}) FROM {table})), n AS (SELECT * FROM {table} WHERE NOT coalesce({time} < (SELECT avg({time}) FROM {table}), false))"


@query(f"""WITH {halves_sql('ai_descriptions', 'created_at')}, l AS (SELECT * FROM n WHERE image_id IS NOT NULL AND model_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id, model_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT b.id, b.image_id, b.model_id, CASE WHEN l.id IS NULL THEN b.description ELSE l.description END AS description, CASE WHEN l.id IS NULL THEN b.created_at ELSE l.created_at END AS created_at FROM b LEFT JOIN l ON l.image_id = b.image_id AND l.model_id = b.model_id
    UNION ALL SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY created_at, id), image_id, model_id, description, created_at FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = l.image_id AND b.model_id = l.model_id)""")
def description_upsert(spark, d):
    """Descriptions of the later half come to those of the earlier."""
    base, new = halves(t(spark, d, "ai_descriptions"), "created_at")
    return commands.upsert_descriptions(base, new.select(F.struct("created_at", "id").alias("seq"), "image_id", "model_id", "description", "created_at"))


@query(f"""WITH {halves_sql('images', 'added_at')}, l AS (SELECT * FROM n WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM b WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY added_at, id) = 1)
    SELECT id, path, file_size, added_at, filename, status, raw_path FROM b UNION ALL SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY added_at, id), path, file_size, 5, regexp_replace(path, '^.*/', ''), 'present', raw_path FROM l""")
def insert_ignore(spark, d):
    """Images of the later half come to those of the earlier: known paths are ignored, the first of a new path wins."""
    base, new = halves(t(spark, d, "images"), "added_at")
    log = new.select(F.struct("added_at", "id").alias("seq"), "path", "hash", "file_size", "raw_path")
    return commands.insert_images(base, log, 5).select("id", "path", "file_size", "added_at", "filename", "status", "raw_path")


@query("WITH c AS (SELECT path, arg_max(CASE WHEN status = 'missing' THEN 'missing' ELSE 'present' END, (added_at, id)) AS now FROM images WHERE path IS NOT NULL GROUP BY path) SELECT i.id, coalesce(c.now, i.status) AS status FROM images i LEFT JOIN c ON c.path = i.path")
def status_replay(spark, d):
    rows = t(spark, d, "images")
    return commands.mark(rows, rows.select(F.struct("added_at", "id").alias("seq"), "path", texts.status("status").alias("status"))).select("id", "status")


@query("WITH c AS (SELECT image_id AS id, arg_max(model_id, (created_at, id)) AS make FROM ai_descriptions GROUP BY 1) SELECT i.id, CASE WHEN c.id IS NOT NULL THEN c.make ELSE i.make END AS make, CASE WHEN c.id IS NULL THEN i.iso END AS iso FROM images i LEFT JOIN c ON c.id = i.id")
def metadata_update(spark, d):
    """Every described image gets its last describer as make, and null for all other camera fields."""
    said = t(spark, d, "ai_descriptions")
    fields = ("filename", "taken_at", "model", "lens", "focal_length", "aperture", "iso", "width", "height", "orientation")
    rows = t(spark, d, "images")
    kinds = dict(rows.dtypes)
    log = said.select(F.struct("created_at", "id").alias("seq"), F.col("image_id").alias("id"), F.col("model_id").alias("make"), *(F.lit(None).cast(kinds[f]).alias(f) for f in fields))
    return commands.update_metadata(rows, log).select("id", "make", "iso")


@query("SELECT f.id, CASE WHEN f.person_id IN (SELECT id FROM persons WHERE created_at > (SELECT min(created_at) FROM persons)) THEN NULL ELSE f.person_id END AS person_id FROM face_detections f")
def person_delete(spark, d):
    """Faces after all persons but the earliest are deleted: they stay and lose their person."""
    persons = t(spark, d, "persons")
    first = persons.agg(F.min("created_at")).first()[0]
    left = commands.delete({"persons": persons, "face_detections": t(spark, d, "face_detections")}, "persons", persons.where(F.col("created_at") > F.lit(first)))
    return left["face_detections"].select("id", "person_id")


@query("SELECT m.id, m.collection_id FROM collection_images m WHERE m.collection_id IS NULL OR m.collection_id NOT IN (SELECT id FROM collections WHERE color IS NULL)")
def cascade_delete(spark, d):
    """Memberships after all collections without a colour are deleted."""
    rows = t(spark, d, "collections")
    return commands.delete({"collections": rows, "collection_images": t(spark, d, "collection_images")}, "collections", rows.where("color is null"))["collection_images"].select("id", "collection_id")


@query(f"""WITH {halves_sql('collection_images', 'added_at')}, l AS (SELECT collection_id, image_id, min(id) AS seq FROM n WHERE collection_id IS NOT NULL AND image_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.collection_id = n.collection_id AND b.image_id = n.image_id) GROUP BY 1, 2)
    SELECT id, collection_id, image_id, added_at FROM b UNION ALL SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY seq), collection_id, image_id, 5 FROM l""")
def members_added(spark, d):
    """Memberships of the later half come to those of the earlier."""
    base, new = halves(t(spark, d, "collection_images"), "added_at")
    return commands.add_members(base, new.select(F.col("id").alias("seq"), "collection_id", "image_id"), 5)


@query("SELECT m.id FROM collection_images m WHERE (m.collection_id, m.image_id) NOT IN (SELECT collection_id, image_id FROM collection_images GROUP BY 1, 2 HAVING count(*) > 1)")
def members_removed(spark, d):
    rows = t(spark, d, "collection_images")
    return commands.remove_members(rows, rows.groupBy("collection_id", "image_id").count().where("count > 1")).select("id")


@query("WITH c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT user_id, last FROM c")
def log_latest(spark, d):
    """The last command of every key of an event log."""
    log = t(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), "event_type")
    return commands.latest(log, "user_id").select("user_id", F.col("event_type").alias("last"))


@query("SELECT hex(hash) AS hash, arg_max(CASE WHEN status = 'missing' THEN 'rejected' ELSE 'imported' END, (added_at, id)) AS decision FROM images WHERE hash IS NOT NULL GROUP BY 1")
def seen_decisions(spark, d):
    log = t(spark, d, "images").select(F.struct("added_at", "id").alias("seq"), "hash", F.when(F.col("status") == "missing", "rejected").otherwise("imported").alias("decision"))
    return commands.seen_decisions(log).select(F.hex("hash").alias("hash"), "decision")


@query("WITH r AS (SELECT collection_id, image_id, row_number() OVER (PARTITION BY collection_id ORDER BY image_id) AS r, count(*) OVER (PARTITION BY collection_id) AS n FROM (SELECT DISTINCT collection_id, image_id FROM collection_images WHERE collection_id IS NOT NULL AND image_id IS NOT NULL)), m AS (SELECT *, CASE WHEN n % 2 = 1 AND r = 1 THEN 0 ELSE least(r - n % 2, n - r + 1) END AS match FROM r) SELECT collection_id AS group_id, match, arg_min(image_id, r) AS a, CASE WHEN count(*) > 1 THEN arg_max(image_id, r) END AS b FROM m GROUP BY 1, 2")
def tournament_round(spark, d):
    pairs = t(spark, d, "collection_images").dropna(subset=["collection_id", "image_id"]).select(F.col("collection_id").alias("group_id"), F.col("image_id").alias("id")).distinct()
    return tournament.first_round(pairs.withColumn("seed", F.col("id")))


@query("WITH RECURSIVE e AS (SELECT DISTINCT id AS a, min(id) OVER (PARTITION BY hash) AS b FROM images WHERE octet_length(hash) = 32) SELECT a AS id, b AS group_id FROM e WHERE b IN (SELECT b FROM e GROUP BY b HAVING count(*) > 1)")
def threshold_groups(spark, d):
    """Groups by a similarity threshold; here images of one hash have similarity 1."""
    rows = t(spark, d, "images").where("length(hash) = 32")
    w = Window.partitionBy("hash").orderBy("id")
    pairs = rows.select(F.col("id").alias("a"), F.lag("id").over(w).alias("b"), F.lit(1.0).alias("similarity")).where("b is not null")
    return tournament.threshold_groups(pairs)
