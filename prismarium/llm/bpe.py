"""Problem 6: token ids of a byte-level BPE vocabulary.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary (one slot per token, no gaps)
finds those that are tokens as a whole; the others are merged pair by pair, lowest rank first, with a heap
over a linked list of their bytes, so that a very long pre-token takes n log n steps. Workers remember
the ids of pre-tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the pattern that splits text into pre-tokens for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers at most, and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 64
BUCKET_KEYS = 2
_MASK = (1 << 64) - 1


def load_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash: bucket displacements send n keys to n slots; a slot's key tells whether a probe is in the set."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // BUCKET_KEYS))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.zeros(self.n, np.int64)
        if not self.n:
            return
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            held[h % self.buckets].append(i)
        free = bytearray(b"\x01") * self.n
        order = sorted(range(self.buckets), key=lambda b: -len(held[b]))
        singles = []
        for b in order:
            members = held[b]
            if len(members) < 2:
                singles.append(b)
                continue
            d = 1
            while True:
                slots = [self._slot(hashes[i], d) for i in members]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(members, slots):
                free[s] = 0
                self.slot_key[s] = i
        rest = iter([s for s in range(self.n) if free[s]])
        for b in singles:
            for i in held[b]:  # a bucket of one key names its slot
                s = next(rest)
                self.shift[b] = -1 - s
                self.slot_key[s] = i

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * 0x9E3779B97F4A7C15)) & _MASK) * 0xFF51AFD7ED558CCD & _MASK) >> 32) % self.n

    def candidate(self, key: bytes) -> int:
        """The only position at which ``key`` can be."""
        h = xxhash.xxh3_64_intdigest(key)
        d = int(self.shift[h % self.buckets])
        return int(self.slot_key[-1 - d if d < 0 else self._slot(h, d)])


class Encoder:
    """Encodes texts with the tokens of a vocabulary, without special tokens."""

    def __init__(self, tokens: list[bytes], whole: PerfectHash | None = None):
        self.tokens = tokens
        self.whole = whole or PerfectHash(tokens)
        self.known = _Memo(self)
        self.find = regex.compile(PATTERN).findall

    def rank(self, piece: bytes) -> int:
        """The rank of a token, or -1."""
        if not self.tokens:
            return -1
        at = self.whole.candidate(piece)
        return at if self.tokens[at] == piece else -1

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        at = self.rank(data)
        return (at,) if at >= 0 else self.merge(data)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Joins neighbours, the pair with the lowest rank first, the leftmost on a tie."""
        n = len(data)
        end = list(range(1, n + 1))  # part i holds data[i:end[i]]; parts that were joined to another end nowhere
        before = list(range(-1, n - 1))
        ranks: dict[bytes, int] = {}

        def pair(i: int) -> int:
            if end[i] >= n:
                return -1
            both = data[i : end[end[i]]]
            r = ranks.get(both)
            if r is None:
                r = ranks[both] = self.rank(both)
            return r

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) >= 0]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            j = end[i]
            end[i] = end[j]
            alive[j] = 0
            if end[i] < n:
                before[end[i]] = i
                if (r := pair(i)) >= 0:
                    heapq.heappush(heap, (r, i, end[end[i]]))
            k = before[i]
            if k >= 0 and (r := pair(k)) >= 0:
                heapq.heappush(heap, (r, k, end[i]))
        out, i = [], 0
        while i < n:
            out.append(self.rank(data[i : end[i]]))
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.known.__getitem__, self.find(text)))) if text else 0


class _Memo(dict):
    """Ids by pre-token; forgets all when it has grown to REMEMBERED."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encoder.piece(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def shared_encoder(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A broadcast of the tokens and their hash (as large as the vocabulary, about 1 MB, whatever the corpus)."""
    tokens = load_ranks(vocabulary)
    return spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row's text, an empty list for a null and for an empty one.

    Rows stay where they are read: no shuffle, whole texts, any length. Other columns are ignored.
    """
    shared = shared_encoder(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for start in range(0, b.num_rows, 1000):
                found = [encoder.encode(t) for t in texts.slice(start, 1000).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(at[-1]))
                yield pa.RecordBatch.from_arrays([keys.slice(start, 1000), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], [key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def counted(df: DataFrame, *keep: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of token ids of every row's text."""
    shared = shared_encoder(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array([encoder.count(t) for t in b.column(len(keep)).to_pylist()], pa.int64())], [*keep, "tokens"])

    kinds = dict(df.dtypes)
    return df.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", tokens long")
