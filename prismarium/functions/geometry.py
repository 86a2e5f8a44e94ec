"""Boxes of faces: on the screen, under the pointer, clamped; windows around an index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismarium.functions import col

#: The largest window, the height of its frame, the smallest window, and its size for unknown pictures.
MAX_WINDOW, FRAME, MIN_WINDOW, UNKNOWN_WINDOW = (1400.0, 860.0), 82, (400, 300), (960, 720)


def real_face() -> Column:
    """Rows that are a detection rather than the mark 'no face': confidence >= 0 and a box that is not all zero."""
    zero = (F.col("bbox_x1") == 0) & (F.col("bbox_y1") == 0) & (F.col("bbox_x2") == 0) & (F.col("bbox_y2") == 0)
    return (F.col("confidence") >= 0) & ~zero


def screen_rect(box: tuple[Column, ...], image: tuple[Column, Column], view: tuple[Column, Column], zoom: Column, scroll: tuple[Column, Column]) -> Column:
    """struct(x, y, w, h) of a box given in fractions of its picture; null if the picture's or the view's size is unknown.

    Up to zoom 1 the picture is fitted and centred; beyond, it fills a scrolled area.
    """
    (x1, y1, x2, y2), (iw, ih), (vw, vh) = box, image, view
    known = (iw != 0) & (ih != 0) & (vw != 0) & (vh != 0)
    scale = F.least(vw / F.nullif(iw, F.lit(0)), vh / F.nullif(ih, F.lit(0))) * F.greatest(zoom, F.lit(1.0))
    w, h = iw * scale, ih * scale
    fitted = zoom <= 1
    left = F.when(fitted, (vw - w) / 2).otherwise(-scroll[0])
    top = F.when(fitted, (vh - h) / 2).otherwise(-scroll[1])
    return F.when(known, F.struct((left + x1 * w).alias("x"), (top + y1 * h).alias("y"), ((x2 - x1) * w).alias("w"), ((y2 - y1) * h).alias("h")))


def hit(rect: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a rectangle, its border included."""
    return x.between(rect["x"], rect["x"] + rect["w"]) & y.between(rect["y"], rect["y"] + rect["h"])


def clamp01(c: Column | str) -> Column:
    return F.greatest(F.least(col(c), F.lit(1.0)), F.lit(0.0))


def buffer_window(current: Column, total: Column, size: Column) -> Column:
    """struct(start, end): up to ``size`` indices around ``current``, shifted to stay within 0..total."""
    n = F.least(size, total)
    half = F.floor((n - 1) / 2)
    start = F.greatest(F.lit(0), F.least(current - half, total - n))
    empty = (total == 0) | (size == 0)
    zero = F.lit(0).cast("long")
    return F.struct(F.when(empty, zero).otherwise(start.cast("long")).alias("start"), F.when(empty, zero).otherwise((start + n).cast("long")).alias("end"))


def window_size(width: Column, height: Column) -> Column:
    """struct(w, h) of a window that shows a picture."""
    scale = F.least(MAX_WINDOW[0] / F.nullif(width, F.lit(0)), (MAX_WINDOW[1] - FRAME) / F.nullif(height, F.lit(0)))
    w = F.greatest(F.round(width * scale).cast("int"), F.lit(MIN_WINDOW[0]))
    h = F.greatest((F.round(height * scale) + FRAME).cast("int"), F.lit(MIN_WINDOW[1]))
    known = (width > 0) & (height > 0)
    return F.struct(F.when(known, w).otherwise(UNKNOWN_WINDOW[0]).alias("w"), F.when(known, h).otherwise(UNKNOWN_WINDOW[1]).alias("h"))
