"""Pixels: turning, shrinking and coding as PNG with numpy and zlib. Other codecs are given by the caller."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from prismarium.sources.content import exif_fields, loadable

PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode_png(pixels: np.ndarray) -> bytes:
    """RGB or grey bytes (height, width[, channels]) as a PNG."""
    rows = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, c = rows.shape
    kind = next(k for k, n in CHANNELS.items() if n == c)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows.reshape(h, -1).astype(np.uint8)], 1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG of 8 bits a channel that is not interlaced."""
    if not data.startswith(PNG):
        raise ValueError("no PNG")
    at, packed, head = len(PNG), b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        raise ValueError("a PNG of this kind isn't read")
    w, h, c = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        how, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if how == 2:
            line = (line + above) & 255
        elif how:
            left = np.zeros(c, np.int64)
            corner = np.zeros(c, np.int64)
            for x in range(0, w * c, c):
                up = above[x : x + c]
                if how == 1:
                    add = left
                elif how == 3:
                    add = (left + up) // 2
                else:
                    p = left + up - corner
                    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
                    add = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
                line[x : x + c] = (line[x : x + c] + add) & 255
                left, corner = line[x : x + c], up
        out[y] = line
        above = line
    return out.reshape(h, w, c)


def apply_orientation(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Turns and mirrors as one of the eight orientations asks; others leave the picture as it is."""
    mirrored = pixels[:, ::-1]
    turned = {2: lambda: mirrored, 3: lambda: np.rot90(pixels, 2), 4: lambda: pixels[::-1], 5: lambda: np.rot90(mirrored, 1), 6: lambda: np.rot90(pixels, -1), 7: lambda: np.rot90(mirrored, -1), 8: lambda: np.rot90(pixels, 1)}
    return turned.get(orientation, lambda: pixels)()


def read_orientation(data: bytes) -> int:
    value = exif_fields(data).get("orientation")
    return value if isinstance(value, int) else 1


def resize_nearest(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = pixels.shape[:2]
    rows = np.minimum(((np.arange(height) + 0.5) * h / height).astype(int), h - 1)
    cols = np.minimum(((np.arange(width) + 0.5) * w / width).astype(int), w - 1)
    return pixels[rows][:, cols]


def resize_mean(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Shrinks by averaging the pixels that fall together."""
    h, w = pixels.shape[:2]
    y, x = np.arange(height) * h // height, np.arange(width) * w // width
    ny, nx = np.diff([*y, h]), np.diff([*x, w])
    total = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), y, 0), x, 1)
    return np.rint(total / (ny[:, None, None] * nx[None, :, None])).astype(np.uint8)


def read_pixels(path: str, decode: Callable[[bytes], np.ndarray] = decode_png) -> np.ndarray:
    """The upright picture of a file with three colours."""
    data = loadable(path)
    pixels = apply_orientation(decode(data), read_orientation(data))
    return np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else np.ascontiguousarray(pixels[:, :, :3])


def thumbnail(data: bytes, most: int, decode: Callable[[bytes], np.ndarray] = decode_png) -> bytes:
    """A PNG at most ``most`` pixels wide and high, in proportion and upright."""
    pixels = apply_orientation(decode(data), read_orientation(data))
    h, w = pixels.shape[:2]
    scale = min(most / w, most / h)
    size = (max(1, round(w * scale)), max(1, round(h * scale)))
    return encode_png(resize_mean(pixels, *size) if scale < 1 else resize_nearest(pixels, *size))


def thumbnails(files: DataFrame, most: int = 256, decode: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """(path, png, error) of ``files`` (path, content); what can't be decoded has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    out.append((path, thumbnail(bytes(content), most, decode), None))
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job
                    out.append((path, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["path", "png", "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, "path string, png binary, error string")
