"""Changes of tables as commands folded into a new snapshot. Nothing is changed in place.

Commands carry ``seq``; ties are settled by the other columns' order. A null key never matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismarium.functions.paths import basename
from prismarium.schemas import CASCADES, DDL, SET_NULL, conform
from prismarium.session import Scratch


def latest(commands: DataFrame, *key: str) -> DataFrame:
    """The last command of each key, with partial aggregation before the shuffle."""
    rest = [c for c in commands.columns if c not in (*key, "seq")]
    last = commands.groupBy(*key).agg(F.max(F.struct("seq", *rest)).alias("c"))
    return last.select(*key, "c.seq", *(f"c.{c}" for c in rest))


def earliest(commands: DataFrame, *key: str) -> DataFrame:
    rest = [c for c in commands.columns if c not in (*key, "seq")]
    first = commands.groupBy(*key).agg(F.min(F.struct("seq", *rest)).alias("c"))
    return first.select(*key, "c.seq", *(f"c.{c}" for c in rest))


def with_ids(rows: DataFrame, base: DataFrame, order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ids after the largest of ``base``, in an order that need not fit in one task.

    The rows are ranged, sorted and stored once with their place in their partition; a place is then shifted by what the
    partitions before it hold. Counting and numbering read the same stored rows, so that ids neither repeat nor leave gaps.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.save(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # one row per task
    before, total = [], top + 1
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    shift = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))
    return placed.join(shift, "_part").withColumn("id", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def insert_images(base: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``new`` (seq, path, hash, file_size, raw_path): paths that are new get a row, the first of a path wins, known paths are ignored."""
    fresh = earliest(new.where("path is not null"), "path").join(base.select("path"), "path", "left_anti")
    rows = fresh.select("seq", "path", "hash", "file_size", "raw_path", F.lit(now).cast("long").alias("added_at"), F.lit("present").alias("status"), basename("path").alias("filename"))
    return base.unionByName(conform(with_ids(rows, base, ["seq", "path"]), "images"))


def update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of the last change (seq, key, columns...) of each key replace those of the row, nulls included."""
    columns = [c for c in changes.columns if c not in (key, "seq")]
    last = latest(changes.where(F.col(key).isNotNull()), key).select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_matched"))
    joined = base.join(last, key, "left")
    return joined.select(*(F.when(F.col("_matched"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def set_raw_path(images: DataFrame, changes: DataFrame) -> DataFrame:
    return update(images, changes.select("seq", "id", "raw_path"), "id")


def update_metadata(images: DataFrame, changes: DataFrame) -> DataFrame:
    fields = [f.split()[0] for f in DDL["images"].split(", ")[6:-1]]
    return update(images, changes.select("seq", "id", *fields), "id")


def mark(images: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (seq, path, status): missing or present, by path."""
    return update(images, changes.select("seq", "path", "status"), "path")


def upsert_descriptions(base: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (seq, image_id, model_id, description, created_at): one row per image and model, the last text wins and a known row keeps its id."""
    last = latest(new.where("image_id is not null and model_id is not null"), "image_id", "model_id").select("image_id", "model_id", "seq", F.col("description").alias("_d"), F.col("created_at").alias("_c"))
    both = base.join(last, ["image_id", "model_id"], "left")
    kept = both.select("id", "image_id", "model_id", *(F.when(F.col("seq").isNotNull(), F.col(n)).otherwise(F.col(o)).alias(o) for o, n in (("description", "_d"), ("created_at", "_c"))))
    fresh = last.join(base.select("image_id", "model_id"), ["image_id", "model_id"], "left_anti")
    added = with_ids(fresh.select("seq", "image_id", "model_id", F.col("_d").alias("description"), F.col("_c").alias("created_at")), base, ["seq", "image_id", "model_id"])
    return kept.unionByName(conform(added, "ai_descriptions"))


def upsert_persons(base: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``new`` (seq, name): names that are new get a row, the first wins."""
    fresh = earliest(new.where("name is not null"), "name").join(base.select("name"), "name", "left_anti")
    return base.unionByName(conform(with_ids(fresh, base, ["seq", "name"]).withColumn("created_at", F.lit(now)), "persons"))


def insert_faces(base: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` has seq and the columns of a face; every row is added."""
    return base.unionByName(conform(with_ids(new, base, ["seq", "image_id"]), "face_detections"))


def assign_faces(faces: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (seq, id, person_id): sets the person, or clears it for a null."""
    return update(faces, changes.select("seq", "id", "person_id"), "id")


def assign_names(persons: DataFrame, faces: DataFrame, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """``changes`` (seq, id, name): persons are added where needed, faces get theirs; a null name clears it."""
    grown = upsert_persons(persons, changes.select("seq", "name"), now)
    ids = grown.groupBy("name").agg(F.min("id").alias("person_id"))
    return grown, assign_faces(faces, changes.join(ids, "name", "left").select("seq", F.col("id"), "person_id"))


def create_collections(base: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``new`` (seq, name, color). A name that is there or comes twice is an error."""
    clash = new.join(base.select("name"), "name", "left_semi").select("name").union(new.groupBy("name").count().where("count > 1").select("name"))
    _refuse(clash)
    return base.unionByName(conform(with_ids(new, base, ["seq", "name"]).withColumn("created_at", F.lit(now)), "collections"))


def rename_collections(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (seq, id, name). Two collections of one name are an error."""
    out = update(base, changes.select("seq", "id", "name"), "id")
    _refuse(out.groupBy("name").count().where("count > 1").select("name"))
    return out


def color_collections(base: DataFrame, changes: DataFrame) -> DataFrame:
    return update(base, changes.select("seq", "id", "color"), "id")


def _refuse(clash: DataFrame) -> None:
    first = clash.first()
    if first is not None:
        raise ValueError(f"the name {first.name!r} is taken")


def add_members(base: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``new`` (seq, collection_id, image_id): pairs that are new; adding twice changes nothing."""
    key = ["collection_id", "image_id"]
    fresh = earliest(new.dropna(subset=key), *key).join(base.select(*key), key, "left_anti")
    return base.unionByName(conform(with_ids(fresh, base, ["seq", *key]).withColumn("added_at", F.lit(now)), "collection_images"))


def remove_members(base: DataFrame, gone: DataFrame) -> DataFrame:
    return base.join(gone.select("collection_id", "image_id"), ["collection_id", "image_id"], "left_anti").select(*base.columns)


def delete(tables: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of ``table`` whose ids are in ``gone``: children go too, or lose the name of their parent."""
    ids = gone.select("id").where("id is not null").distinct()
    out = dict(tables)
    out[table] = tables[table].join(ids, "id", "left_anti").select(*tables[table].columns)
    for child, key in CASCADES.get(table, []):
        if child in out:
            out[child] = out[child].join(ids.withColumnRenamed("id", key), key, "left_anti").select(*tables[child].columns)
    for child, key in SET_NULL.get(table, []):
        if child in out:
            hit = ids.select(F.col("id").alias(key), F.lit(True).alias("_gone"))
            out[child] = out[child].join(hit, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*tables[child].columns)
    return out


def import_rows(results: DataFrame) -> DataFrame:
    """Rows to insert after a copy: ``results`` (group_id, seq, dest, hash, file_size, is_display, error).

    Only what was copied counts; a display file takes its group's last raw companion as raw_path, and companions get no row.
    """
    good = results.where("error is null")
    raw = good.where("not is_display").groupBy("group_id").agg(F.max_by("dest", "seq").alias("raw_path"))
    return good.where("is_display").join(raw, "group_id", "left").select("seq", F.col("dest").alias("path"), "hash", "file_size", "raw_path")


def seen_decisions(log: DataFrame) -> DataFrame:
    """(hash, decision): the last decision, imported or rejected, of every hash in a log (seq, hash, decision)."""
    return latest(log.where("hash is not null"), "hash").select("hash", "decision")
