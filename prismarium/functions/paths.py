"""Functions of file paths with '/' as separator. A null path gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismarium.functions import ascii_lower, col

#: Extensions of pictures, of camera raw files, and the types of files by extension.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "raf")
RAW_EXTENSIONS = ("raf",)
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "tiff": "image/tiff", "tif": "image/tiff", "raf": "image/jpeg"}


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    """All before the last '/'; empty without one."""
    return F.regexp_replace(F.regexp_replace(col(path), "[^/]*$", ""), "/$", "")


def extension(path: Column | str) -> Column:
    """Behind the last dot of the name; empty without one and for a name that only begins with a dot."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column | str) -> Column:
    """The name without its extension; a name that only begins with a dot is all stem."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def is_raw(path: Column | str) -> Column:
    return ascii_lower(extension(path)).isin(*RAW_EXTENSIONS)


def is_image(path: Column | str) -> Column:
    """A known extension in any case, and a name that does not begin with a dot."""
    return ascii_lower(extension(path)).isin(*IMAGE_EXTENSIONS) & ~basename(path).startswith(".")


def mime_type(path: Column | str) -> Column:
    types = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(types, ascii_lower(extension(path))), F.lit("image/jpeg"))


def mime_of(path: str) -> str:
    """As `mime_type`, of a string."""
    name = path.rpartition("/")[2]
    base, _, ending = name.rpartition(".")
    return MIME_TYPES.get(ending.lower(), "image/jpeg") if base else "image/jpeg"


def order_key(path: Column | str) -> Column:
    """Sorts paths part by part instead of character by character."""
    return F.split(col(path), "/")


def lower_extension(path: Column | str) -> Column:
    """The extension in lower case."""
    return ascii_lower(extension(path))
