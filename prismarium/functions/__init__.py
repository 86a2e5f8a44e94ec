"""Column functions: paths, camera dates, texts shown to people, geometry, vectors and bloom positions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A to Z only, as the search compares texts."""
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)
