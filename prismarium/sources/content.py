"""Contents of picture files: hashes, previews in raw files, and the camera's fields."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismarium.functions import col
from prismarium.functions.dates import exif_epoch

#: Fixed values of the raw format: its first bytes, and where the place and length of the preview stand (big-endian).
RAW_MAGIC, PLACE_AT, LENGTH_AT = b"FUJIFILMCCD-RAW ", 84, 88
#: Tags of the exchangeable image file format.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal_length", 0xA002: "width", 0xA003: "height", 0xA434: "lens"}
EXIF_POINTER = 0x8769
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
METADATA = "path string, filename string, taken_text string, make string, model string, lens string, focal_length double, aperture double, iso long, width long, height long, orientation long"


def content_key(content: Column | str) -> Column:
    """32 bytes that equal contents share."""
    return F.unhex(F.sha2(col(content), 256))


def preview_column(content: Column | str) -> Column:
    """The preview in a raw file's bytes, null where there is none that is whole and begins as a JPEG does."""
    c = col(content)
    number = lambda at: F.conv(F.hex(F.substring(c, at + 1, 4)), 16, 10).cast("long")
    place, length = number(PLACE_AT), number(LENGTH_AT)
    head = (F.length(c) >= LENGTH_AT + 4) & (F.substring(c, 1, len(RAW_MAGIC)) == F.lit(RAW_MAGIC))
    inside = (place > 0) & (length > 0) & (place + length <= F.length(c))
    jpeg = F.substring(c, (place + 1).cast("int"), length.cast("int"))
    return F.when(head, F.when(inside, F.when(F.hex(F.substring(jpeg, 1, 2)) == "FFD8", jpeg)))


def extract_preview(data: bytes) -> bytes:
    """The preview in a raw file's bytes; ValueError says what is wrong with them."""
    if len(data) < LENGTH_AT + 4 or not data.startswith(RAW_MAGIC):
        raise ValueError("not a raw file of this kind")
    place, length = (struct.unpack_from(">I", data, at)[0] for at in (PLACE_AT, LENGTH_AT))
    if not place or not length:
        raise ValueError("the raw file has no preview")
    if place + length > len(data):
        raise ValueError("the preview goes beyond the end of the file")
    if data[place : place + 2] != b"\xff\xd8" or length < 2:
        raise ValueError("the preview is no JPEG")
    return data[place : place + length]


def loadable(path: str) -> bytes:
    """Bytes that an image library can read: a raw file's preview, else the file."""
    data = Path(path).read_bytes()
    return extract_preview(data) if path.lower().endswith(".raf") else data


def _tiff(data: bytes) -> dict[str, object]:
    """Fields of a TIFF structure, of its first directory and the one for exposure data; what is broken is left out."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return {}
    out: dict[str, object] = {}
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if not size or place + size > len(data):
                continue
            if tag == EXIF_POINTER:
                todo.append(struct.unpack_from(order + "I", data, place)[0])
            elif tag in TAGS and TAGS[tag] not in out:
                value = _value(data, order, kind, place, size)
                if value is not None:
                    out[TAGS[tag]] = value
    return out


def _value(data: bytes, order: str, kind: int, place: int, size: int) -> object:
    if kind == 2:
        try:
            return data[place : place + size].split(b"\0")[0].decode().strip() or None
        except UnicodeDecodeError:
            return None
    if kind == 5:
        num, den = struct.unpack_from(order + "II", data, place)
        return num / den if den else None
    return struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind], data, place)[0] if kind in (1, 3, 4) else None


def exif_fields(data: bytes) -> dict[str, object]:
    """The camera's fields in the bytes of a JPEG or TIFF; empty where there are none."""
    if data[:2] in (b"II", b"MM"):
        return _tiff(data)
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tiff(data[at + 10 : at + 2 + size])
        if marker == 0xDA:
            break
        at += 2 + size
    return {}


def metadata_of(path: str) -> dict[str, object]:
    """The file name and what its camera wrote; every failure leaves only the name."""
    out: dict[str, object] = {"path": path, "filename": path.rpartition("/")[2]}
    try:
        found = exif_fields(loadable(path))
    except (OSError, ValueError, struct.error):
        return out
    kinds = {"make": str, "model": str, "lens": str, "taken": str, "focal_length": float, "aperture": float}
    for name in ("make", "model", "lens", "focal_length", "aperture", "iso", "width", "height", "orientation", "taken"):
        value = found.get(name)
        if isinstance(value, kinds.get(name, int)):
            out["taken_text" if name == "taken" else name] = value
    return out


def extract_metadata(files: DataFrame) -> DataFrame:
    """Camera fields of ``files`` (path), which every executor can open; taken_at in seconds."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in METADATA.split(", ")]
        for b in batches:
            rows = [metadata_of(p) for p in b["path"]]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return files.select("path").mapInPandas(read, METADATA).withColumn("taken_at", exif_epoch("taken_text")).drop("taken_text")


def hash_files(files: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(path, size, hash): SHA-256 of each file, read in pieces; a file that can't be read has a null hash."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                digest = hashlib.sha256()
                try:
                    with open(path, "rb") as f:
                        while piece := f.read(chunk):
                            digest.update(piece)
                    out.append(digest.digest())
                except OSError:
                    out.append(None)
            yield b.assign(hash=pd.Series(out, dtype=object, index=b.index))

    return files.select("path", "size").mapInPandas(run, "path string, size long, hash binary")
