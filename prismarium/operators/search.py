"""Search of the library: tokens over camera texts, descriptions and names."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismarium.functions import ascii_lower, col

DEFAULT_LIMIT = 500
#: Token masks are bits of a long.
MOST_TOKENS = 62
COLUMNS = ("id", "path", "added_at", "status", "filename", "taken_at", "make", "model", "lens", "focal_length", "aperture", "iso", "width", "height", "orientation", "raw_path")


@dataclass(frozen=True)
class SearchQuery:
    """What to look for; everything is optional, a blank text counts as none."""

    text: str | None = None
    limit: int | None = None
    offset: int | None = None
    collection_id: int | None = None

    def with_text(self, text: str) -> SearchQuery:
        return replace(self, text=text.strip() or None)

    def with_limit(self, limit: int) -> SearchQuery:
        return replace(self, limit=limit)

    def with_offset(self, offset: int) -> SearchQuery:
        return replace(self, offset=offset)

    def with_collection(self, collection_id: int) -> SearchQuery:
        return replace(self, collection_id=collection_id)

    def is_empty(self) -> bool:
        return self.text is None

    def tokens(self) -> list[str]:
        return self.text.lower().split() if self.text else []


def fts_query(text: str) -> str:
    """Each token in quotes with a star, for engines with full-text syntax."""
    return " ".join('"' + t.replace('"', '""') + '"*' for t in text.split())


def fts_column(text: Column | str) -> Column:
    """As `fts_query`, of a column."""
    words = F.filter(F.split(F.trim(col(text)), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"*'))), " ")


def escape_like(token: str, escape: str = "\\") -> str:
    """Lower case, with wildcards and the escape character escaped."""
    for c in (escape, "%", "_"):
        token = token.replace(c, escape + c)
    return token.lower()


def camera_text() -> Column:
    return F.concat_ws(" ", *(F.coalesce(col(c), F.lit("")) for c in ("filename", "make", "model", "lens")))


def _mask(text: Column, tokens: list[str]) -> Column:
    """Bit k is set if the text holds token k."""
    out = F.lit(0).cast("long")
    for k, token in enumerate(tokens):
        out = out.bitwiseOR(F.when(F.contains(text, F.lit(token)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return out


def _page(found: DataFrame, query: SearchQuery) -> DataFrame:
    """Newest first, the smaller id first among equals."""
    ordered = found.orderBy(F.desc("added_at"), "id")
    return ordered.offset(query.offset or 0).limit(DEFAULT_LIMIT if query.limit is None else query.limit)


def _candidates(images: DataFrame, members: DataFrame | None, query: SearchQuery) -> DataFrame:
    present = images.where(F.col("status") == "present").select(*COLUMNS)
    if query.collection_id is None:
        return present
    chosen = members.where(F.col("collection_id") == query.collection_id).select(F.col("image_id").alias("id"))
    return present.join(chosen, "id", "left_semi")


def search(images: DataFrame, descriptions: DataFrame, faces: DataFrame, persons: DataFrame, members: DataFrame | None, query: SearchQuery) -> DataFrame:
    """Present images, newest first, of which one description and one face's person together with the camera text hold every token.

    Per image only the distinct token masks of its descriptions and of its faces' persons are kept, after
    partial aggregation, so an image with many of both is never multiplied out. Equal to `search_by_join`.
    """
    base = _candidates(images, members, query)
    if query.text is None:
        return _page(base, query)
    tokens = query.tokens()
    if not tokens:
        return base.limit(0)
    if len(tokens) > MOST_TOKENS:
        return search_by_join(images, descriptions, faces, persons, members, query)
    every = (1 << len(tokens)) - 1
    said = descriptions.select("image_id", _mask(ascii_lower(F.coalesce("description", F.lit(""))), tokens).alias("m")).where("m <> 0").groupBy("image_id").agg(F.collect_set("m").alias("said"))
    named = persons.select(F.col("id").alias("person_id"), _mask(ascii_lower(F.coalesce("name", F.lit(""))), tokens).alias("m")).where("m <> 0")
    shown = faces.where("person_id is not null").select("image_id", "person_id").join(named, "person_id").groupBy("image_id").agg(F.collect_set("m").alias("shown"))
    zero = F.array(F.lit(0).cast("long"))
    masked = (
        base.withColumn("e", _mask(ascii_lower(camera_text()), tokens))
        .join(said.withColumnRenamed("image_id", "id"), "id", "left")
        .join(shown.withColumnRenamed("image_id", "id"), "id", "left")
        .withColumn("said", F.concat(zero, F.coalesce("said", zero)))
        .withColumn("shown", F.concat(zero, F.coalesce("shown", zero)))
    )
    all_held = F.exists("said", lambda a: F.exists("shown", lambda p: F.col("e").bitwiseOR(a).bitwiseOR(p) == every))
    return _page(masked.where(all_held).select(*COLUMNS), query)


def search_by_join(images: DataFrame, descriptions: DataFrame, faces: DataFrame, persons: DataFrame, members: DataFrame | None, query: SearchQuery) -> DataFrame:
    """The same by joining everything; the plain form that `search` is held against."""
    base = _candidates(images, members, query)
    if query.text is None:
        return _page(base, query)
    joined = (
        base.join(descriptions.select(F.col("image_id").alias("id"), "description"), "id", "left")
        .join(faces.select(F.col("image_id").alias("id"), "person_id"), "id", "left")
        .join(persons.select(F.col("id").alias("person_id"), "name"), "person_id", "left")
    )
    texts = [ascii_lower(camera_text()), ascii_lower(F.coalesce("description", F.lit(""))), ascii_lower(F.coalesce("name", F.lit("")))]
    for token in query.tokens():
        joined = joined.where(F.contains(texts[0], F.lit(token)) | F.contains(texts[1], F.lit(token)) | F.contains(texts[2], F.lit(token)))
    return _page(joined.select(*COLUMNS).dropDuplicates(["id"]), query)


def search_persons(persons: DataFrame, text: str) -> DataFrame:
    """Persons whose name holds the text, in any case of A to Z; % and _ in it are wildcards. All for an empty text."""
    escape = next(c for c in "!#|^~" if c not in text)
    pattern = f"%{text.lower()}%".replace("'", "''")
    return persons.where(F.expr(f"translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '{pattern.replace(chr(92), chr(92) * 2)}' escape '{escape}'")).select("id", "name").orderBy("name", "id")


def library_rows(images: DataFrame) -> DataFrame:
    """Image rows with the camera's fields in a struct ``meta``."""
    meta = ("filename", "taken_at", "make", "model", "lens", "focal_length", "aperture", "iso", "width", "height", "orientation")
    return images.select("id", "path", "added_at", "status", "raw_path", F.struct(*meta).alias("meta"))


def where_camera(images: DataFrame, taken_from: int | None = None, taken_to: int | None = None, iso_from: int | None = None, iso_to: int | None = None, make: str | None = None) -> DataFrame:
    """Planned in the original: images taken in a span of time, at some ISO, by some maker (in any case of A to Z). Null values match no filter."""
    for c, low, high in (("taken_at", taken_from, taken_to), ("iso", iso_from, iso_to)):
        if low is not None:
            images = images.where(F.col(c) >= low)
        if high is not None:
            images = images.where(F.col(c) <= high)
    return images if make is None else images.where(ascii_lower("make") == make.lower())
