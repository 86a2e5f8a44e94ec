"""Schemas of the library's tables, by version, and filling in columns that older snapshots lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CAMERA = "filename string, taken_at long, make string, model string, lens string, focal_length double, aperture double, iso long, width long, height long, orientation long"
DDL = {
    "images": f"id long, path string, hash binary, file_size long, added_at long, status string, {_CAMERA}, raw_path string",
    "ai_descriptions": "id long, image_id long, model_id string, description string, created_at long",
    "persons": "id long, name string, created_at long",
    "face_detections": "id long, image_id long, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, embedding array<float>, person_id long, confidence double",
    "collections": "id long, name string, color string, created_at long",
    "collection_images": "id long, collection_id long, image_id long, added_at long",
}
#: Children of a table by the column that names it: rows go with their parent, or lose the name.
CASCADES = {"images": [("ai_descriptions", "image_id"), ("face_detections", "image_id"), ("collection_images", "image_id")], "collections": [("collection_images", "collection_id")]}
SET_NULL = {"persons": [("face_detections", "person_id")]}
#: Tables and columns that came with each version of the schema.
VERSIONS = {1: ["images"], 2: ["images." + c.split()[0] for c in _CAMERA.split(", ")], 3: ["ai_descriptions"], 4: ["persons", "face_detections"], 5: ["images.raw_path"], 6: ["collections", "collection_images"]}
VERSION = max(VERSIONS)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the current schema in order: missing ones are null, others are dropped, values that don't convert become null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(table)))
