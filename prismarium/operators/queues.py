"""Work queues (what still lacks something) and lookups. An empty table gives an empty queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismarium.functions.geometry import real_face


def present(images: DataFrame) -> DataFrame:
    return images.where(F.col("status") == "present")


def needing_description(images: DataFrame, descriptions: DataFrame, model_id: str) -> DataFrame:
    """(id, path) of present images without a description by the model."""
    done = descriptions.where(F.col("model_id") == model_id).select(F.col("image_id").alias("id"))
    return present(images).select("id", "path").join(done, "id", "left_anti")


def needing_faces(images: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, path) of present images without any face row; the mark 'no face' counts as done."""
    return present(images).select("id", "path").join(faces.select(F.col("image_id").alias("id")), "id", "left_anti")


def with_untagged_faces(images: DataFrame, faces: DataFrame) -> DataFrame:
    """(image_id) of present images with a real face that has no person."""
    open_ = faces.where(real_face() & F.col("person_id").isNull()).select(F.col("image_id").alias("id"))
    return present(images).select("id").join(open_, "id", "left_semi").select(F.col("id").alias("image_id")).orderBy("image_id")


def of_persons(faces: DataFrame, person_ids: list[int]) -> DataFrame:
    """(image_id) of images that show any of the persons; none for no persons."""
    return faces.where(F.col("person_id").isin(*person_ids) if person_ids else F.lit(False)).select("image_id").distinct()


def needing_metadata(images: DataFrame) -> DataFrame:
    """(id, path) of images whose file name was never filled in."""
    return images.where("filename is null").select("id", "path")


def never_extracted(images: DataFrame) -> DataFrame:
    """(id, path) of images without any camera field: what the queue above misses, as inserts fill in file names."""
    fields = ("taken_at", "make", "model", "lens", "focal_length", "aperture", "iso", "width", "height", "orientation")
    return images.where(F.coalesce(*(F.col(c).cast("string") for c in fields)).isNull()).select("id", "path")


def assigned_embeddings(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(face_id, person_id, name, embedding) of faces with a known person."""
    who = persons.select(F.col("id").alias("person_id"), "name")
    return faces.where("person_id is not null").select(F.col("id").alias("face_id"), "person_id", "embedding").join(who, "person_id")


def by_id(table: DataFrame, key: int) -> DataFrame:
    """The row with an id, if any."""
    return table.where(F.col("id") == key).limit(1)


def descriptions_of(descriptions: DataFrame, image_id: int) -> DataFrame:
    return descriptions.where(F.col("image_id") == image_id).select("model_id", "description", "created_at", "id").orderBy("created_at", "id").select("model_id", "description")


def faces_of(faces: DataFrame, image_id: int) -> DataFrame:
    return faces.where(F.col("image_id") == image_id).orderBy("id")


def newest_first(images: DataFrame) -> DataFrame:
    """All images with a hash of 32 bytes, newest first."""
    return images.where(F.length("hash") == 32).orderBy(F.desc("added_at"), "id")
