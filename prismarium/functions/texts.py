"""Texts shown to people. Numbers round half to even on their exact binary value, as printf does, which needs an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismarium.functions import col

#: Names of the eight orientations.
ORIENTATIONS = {1: "Normal", 2: "Mirrored horizontally", 3: "Rotated 180°", 4: "Mirrored vertically", 5: "Mirrored + rotated 90° CW", 6: "Rotated 90° CW", 7: "Mirrored + rotated 90° CCW", 8: "Rotated 90° CCW"}
STATUSES = ("present", "missing")


@F.pandas_udf(T.StringType())
def _zero(values: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.0f}" for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def _one(values: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.1f}" for v in values], dtype=object)


def whole(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), _zero(col(c)))


def tenth(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), _one(col(c)))


def camera(make: Column | str, model: Column | str) -> Column:
    """'make model', or the make alone; null without a make."""
    return F.when(col(make).isNotNull(), F.concat_ws(" ", col(make), col(model)))


def dimensions(width: Column | str, height: Column | str) -> Column:
    return F.concat(col(width).cast("string"), F.lit(" × "), col(height).cast("string"))


def info_line() -> Column:
    """Camera, lens, exposure, ISO and size of an image row, joined by ' · '; what is null is left out."""
    exposure = F.concat(whole("focal_length"), F.lit(" mm  f/"), tenth("aperture"))
    iso = F.concat(F.lit("ISO "), F.col("iso").cast("string"))
    return F.concat_ws(" · ", camera("make", "model"), F.col("lens"), exposure, iso, dimensions("width", "height"))


def orientation(c: Column | str) -> Column:
    out = F.when(col(c).isNull(), F.lit(None).cast("string"))
    for number, name in ORIENTATIONS.items():
        out = out.when(col(c) == number, name)
    return out.otherwise("Unknown")


def status(c: Column | str) -> Column:
    """Any text but 'missing' reads as present."""
    return F.when(col(c) == "missing", "missing").otherwise("present")


def similarity_text(c: Column | str) -> Column:
    """'87.5%', null where the similarity is not finite."""
    finite = col(c).isNotNull() & ~F.isnan(col(c)) & (F.abs(col(c)) != float("inf"))
    return F.when(finite, F.concat(tenth(col(c) * 100), F.lit("%")))


def similarity_class(c: Column | str) -> Column:
    pct = col(c) * 100
    finite = col(c).isNotNull() & ~F.isnan(col(c)) & (F.abs(col(c)) != float("inf"))
    return F.when(finite, F.when(pct >= 80, "success").when(pct >= 50, "warning").otherwise("dim-label"))


def count_of_images(c: Column | str) -> Column:
    return F.when(col(c) == 1, "1 image").otherwise(F.concat(col(c).cast("string"), F.lit(" images")))


def scan_summary(generated: Column, imported: Column, rejected: Column) -> Column:
    images = F.concat(generated.cast("string"), F.lit(" images"))
    seen = F.concat(images, F.lit(" ("), imported.cast("string"), F.lit(" imported, "), rejected.cast("string"), F.lit(" skipped)"))
    return F.when(imported + rejected > 0, seen).otherwise(images)


def copy_summary(copied: Column, failed: Column) -> Column:
    ok = F.concat(F.lit("Copied "), copied.cast("string"), F.when(copied == 1, " image").otherwise(" images"))
    return F.when(failed == 0, ok).otherwise(F.concat(F.lit("Copied "), copied.cast("string"), F.lit(", "), failed.cast("string"), F.lit(" failed")))
