"""The bloom filter of the seen sets, over 32-byte digests."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from prismarium.functions import col

#: Probes of a digest, bits per entry, the least bits, and entries times this beyond the bits call for a rebuild.
PROBES, BITS_PER_ITEM, MIN_BITS, REBUILD = 7, 9.585, 8192, 10


def optimal_bits(n: int) -> int:
    """A power of two with at least BITS_PER_ITEM bits for each of n entries, and MIN_BITS for none."""
    return MIN_BITS if n == 0 else 1 << max(0, math.ceil(n * BITS_PER_ITEM) - 1).bit_length()


def bits_for(n: int) -> int:
    return max(MIN_BITS, optimal_bits(n))


def bits_column(n: Column | str) -> Column:
    """`bits_for` of a column of counts."""
    whole = F.ceil(col(n) * BITS_PER_ITEM).cast("long")
    power = F.when(whole <= 1, F.lit(0)).otherwise(F.length(F.bin(whole - 1)))
    return F.when(col(n) == 0, F.lit(MIN_BITS).cast("long")).otherwise(F.greatest(F.lit(MIN_BITS).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), power)))


def too_full(n: Column | int, bits: Column | int) -> Column | bool:
    """Whether a filter of so many bits is to be built anew when it holds n entries."""
    return (col(n) if isinstance(n, str) else n) * REBUILD > bits


def position_column(digest: Column | str, bits: int) -> Column:
    """Array of the probes' bit positions. The number of bits is a power of two, so halves of the digest are masked before they are multiplied."""

    def low(first: int) -> Column:  # the low seven bytes of a little-endian number that begins at byte ``first``
        turned = F.concat(*(F.hex(F.substring(col(digest), first + k, 1)) for k in range(6, -1, -1)))
        return F.conv(turned, 16, 10).cast("long").bitwiseAND(bits - 1)

    a, b = low(1), low(9).bitwiseOR(1)
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (a + i * b).bitwiseAND(bits - 1))


def positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """(n, PROBES) positions of digests given as an (n, 32) byte array; numbers wrap at 64 bits."""
    halves = np.ascontiguousarray(digests[:, :16]).view("<u8").astype(np.uint64)
    with np.errstate(over="ignore"):
        return ((halves[:, :1] + np.arange(PROBES, dtype=np.uint64) * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


class Bloom:
    """Bits set for some digests: no false negatives, about 1 % false positives."""

    def __init__(self, digests: Iterable[bytes] = (), bits: int | None = None):
        rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        self.bits = bits or bits_for(len(rows))
        self.words = np.zeros(self.bits, bool)
        self.words[positions(rows, self.bits).ravel()] = True

    def __contains__(self, digest: bytes) -> bool:
        return bool(self.words[positions(np.frombuffer(digest, np.uint8).reshape(1, 32), self.bits)].all())

    def add(self, digests: Iterable[bytes]) -> None:
        rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        self.words[positions(rows, self.bits).ravel()] = True


class SeenSet:
    """Hashes in the order they came, repeated ones kept, with a filter that is built anew when it is too full for them."""

    def __init__(self, digests: Iterable[bytes] = ()):
        self.entries = list(digests)
        self.bloom = Bloom(self.entries)

    def insert(self, digest: bytes) -> None:
        self.entries.append(digest)
        if too_full(len(self.entries), self.bloom.bits):
            self.bloom = Bloom(self.entries)
        else:
            self.bloom.add([digest])

    def probably_contains(self, digest: bytes) -> bool:
        return digest in self.bloom

    def __len__(self) -> int:
        return len(self.entries)

    def is_empty(self) -> bool:
        return not self.entries
