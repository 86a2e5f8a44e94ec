"""Collections of images. Sizes are aggregated before they are joined; membership counts rows of existing images only once per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_COLOR = "#3584e4"


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg(F.count("*").alias("image_count"))


def with_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """All collections by name with the number of their memberships, 0 for unused ones; a null colour gets the default."""
    counted = collections.join(sizes(members), collections.id == F.col("collection_id"), "left")
    return counted.select("id", "name", F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color"), "created_at", F.coalesce("image_count", F.lit(0)).alias("image_count")).orderBy("name", "id")


def by_id(collections: DataFrame, members: DataFrame, collection_id: int) -> DataFrame:
    """The row of `with_counts` for one collection, if there is one."""
    return with_counts(collections.where(F.col("id") == collection_id), members.where(F.col("collection_id") == collection_id))


def of_images(collections: DataFrame, members: DataFrame) -> DataFrame:
    """(image_id, id, name, image_count): for every image the collections that hold it."""
    pairs = members.select("image_id", F.col("collection_id").alias("id")).where("image_id is not null").distinct()
    return pairs.join(with_counts(collections, members).select("id", "name", "image_count"), "id").select("image_id", "id", "name", "image_count")


def picker(collections: DataFrame, members: DataFrame, image_id: int) -> DataFrame:
    """All collections with whether the image is in them."""
    own = members.where(F.col("image_id") == image_id).select(F.col("collection_id").alias("id"), F.lit(True).alias("is_member")).distinct()
    return collections.select("id", "name").join(own, "id", "left").select("id", "name", F.coalesce("is_member", F.lit(False)).alias("is_member")).orderBy("name", "id")
