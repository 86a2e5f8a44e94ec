"""Problem 2: rows of new batches that repeat something already accepted.

Rows show the same photo if they have the same valid hash, or the same taken_at and paths that name the same file.
Case, slashes, dots and codes of letters are settled where a path is read (`light_path`). How people and programs name a copy
is left to a segment index for edit distance over the words and numbers of paths: every indexed path is cut into a fixed
number of segments, kept by length and position; a path within EDITS edits (words) of an indexed one shares a segment
with it near the same place (pigeonhole), so probing the selected substrings of a new path finds all candidates.
Their edit distance is verified, and then that what differs is a copy's mark or a letter or two.

`History` keeps the index in a folder. A batch probes it, and appends its own keys and segments.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismarium.llm.canonical import distance
from prismarium.operators.components import connected_components, union_labels
from prismarium.operators.grouped import by_group
from prismarium.session import Scratch

#: Edits between the words of two paths, and the segments that a path is cut into; edits between the letters of two canonical paths.
EDITS = 4
SEGMENTS = EDITS + 1
LETTER_EDITS = 2
#: The index is kept in so many buckets by the month a photo was taken, so that a batch reads those of its own months.
BUCKETS, MONTH = 8, 31 * 86_400
#: How systems, sync tools and file managers name a copy, before and behind the stem.
COPY_BEFORE = r"(?:copy|kopie|copie|copia|cópia|kopia|copy \(\d+\)) (?:of|von|de|di|från) "
COPY_BEHIND = r"(?:[ _-]+(?:copy|kopie|copie|copia|cópia|kopia)(?:[ _-]*\d{1,2})?| ?\(\d{1,3}\)|~\d{1,2}| - \d{1,2}|(?<=\d{3})_\d)"
SAME_EXTENSION = {"jpeg": "jpg", "jpe": "jpg", "tif": "tiff", "htm": "html"}


@lru_cache(maxsize=100_000)
def folder_spelling(folder: str) -> str:
    parts: list[str] = []
    for part in folder.split("/"):
        part = part.strip()
        if part == "..":
            parts[-1:] = []
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def light_path(path: str) -> str:
    """A path without what systems spell differently: case, slashes, dots, percent signs, composition of letters, blanks, and names of one extension."""
    text = unquote(path, errors="replace") if "%" in path else path
    if "\\" in text:
        text = text.replace("\\", "/")
    if not text.isascii() or not text.isprintable():
        text = unicodedata.normalize("NFC", text)
        text = "".join(" " if c.isspace() else c for c in text if c.isspace() or unicodedata.category(c)[0] != "C")
    text = re.sub(r"^(?:file:/+|[a-z]:/)", "/", text.casefold().strip())
    folder, _, name = text.rpartition("/")
    stem, dot, extension = name.rpartition(".")
    if not dot:
        stem, extension = name, ""
    extension = extension.strip()
    return f"{folder_spelling(folder)}/{stem.strip()}.{SAME_EXTENSION.get(extension, extension)}"


@lru_cache(maxsize=100_000)
def unmarked(light: str) -> str:
    """A light path without the marks of a copy."""
    folder, _, name = light.rpartition("/")
    stem, _, extension = name.rpartition(".")
    while True:
        shorter = re.sub(rf"^{COPY_BEFORE}", "", re.sub(rf"{COPY_BEHIND}$", "", stem)).strip()
        if shorter == stem or not shorter:
            break
        stem = shorter
    return f"{folder}/{stem}.{extension}"


def canonical_path(path: str) -> str:
    """One spelling of a path, however a system writes it and names a copy."""
    return unmarked(light_path(path))


def numbers(text: str) -> list[str]:
    return re.findall(r"\d+", text)


def same_file(a: str, b: str) -> bool:
    """Whether two canonical paths are within LETTER_EDITS edits and hold the same numbers and extension."""
    return numbers(a) == numbers(b) and a.rpartition(".")[2] == b.rpartition(".")[2] and distance(a, b, LETTER_EDITS) <= LETTER_EDITS


def words_of(light: str) -> str:
    """The words and numbers of a light path, a character for each, so that a string's edits are edits of words."""
    return "".join(chr(0xE000 + xxhash.xxh32_intdigest(w) % 0x100000) for w in re.findall(r"[^\W\d_]+|\d+", light))


def cuts(length: int) -> list[tuple[int, int]]:
    """Start and length of each segment of a string of this length; earlier segments are the shorter ones."""
    base, longer = divmod(length, SEGMENTS)
    out, at = [], 0
    for k in range(SEGMENTS):
        size = base + (k >= SEGMENTS - longer)
        out.append((at, size))
        at += size
    return out


def index_keys(text: str) -> list[tuple[int, int, str]]:
    """(length, position, segment) under which a string is indexed."""
    return [(len(text), k, text[at : at + size]) for k, (at, size) in enumerate(cuts(len(text)))]


def probe_keys(text: str) -> list[tuple[int, int, str]]:
    """(length, position, substring) that find every indexed string within EDITS edits: substrings that start so near a segment's
    place that the edits before it and behind it can both be afforded."""
    out = set()
    n = len(text)
    for length in range(max(n - EDITS, 0), n + EDITS + 1):
        shift = n - length
        for k, (at, size) in enumerate(cuts(length)):
            low = max(0, at - k, at + shift - (EDITS - k))
            high = min(n - size, at + k, at + shift + (EDITS - k))
            out.update((length, k, text[s : s + size]) for s in range(low, high + 1))
    return sorted(out)


def spelled(images: DataFrame) -> DataFrame:
    """(id, added_at, hash_key, taken_at, path_key, light): path_key stands for taken_at and light path; both keys are null where they don't count.

    A null added_at counts as the earliest time; a null path never matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            light = [None if p is None or t is None else light_path(p) for p, t in zip(b.column(4).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(light, pa.string())], ["id", "added_at", "hash_key", "taken_at", "light"])

    counts = (F.length("hash") == 32) & (F.col("hash") != F.lit(bytes(32))) & (F.col("file_size") > 0)
    rows = images.where("id is not null").select("id", F.coalesce("added_at", F.lit(-(1 << 62))).alias("added_at"), F.when(counts, F.col("hash")).alias("hash_key"), "taken_at", "path")
    read = rows.mapInArrow(run, "id long, added_at long, hash_key binary, taken_at long, light string")
    return read.withColumn("path_key", F.when(F.col("light").isNotNull(), _digest(F.concat_ws("|", F.col("taken_at").cast("string"), "light"))))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _bucket(taken_at: str) -> Column:
    return F.pmod(F.floor(F.col(taken_at) / MONTH), F.lit(BUCKETS)).cast("int")


def near_key() -> Column:
    """What two spellings of one path must share: taken_at, and the numbers of four and more digits, as a copy's mark is no such number."""
    return F.xxhash64("taken_at", F.array_join(F.regexp_extract_all("light", F.lit(r"(\d{4,})")), ","))


def segments(paths: DataFrame, probes: bool) -> DataFrame:
    """(key, node) per indexed segment or probed substring of ``paths`` (node, near, light)."""
    keys = probe_keys if probes else index_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, (near, light) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                own = {xxhash.xxh64_intdigest(f"{near}|{n}|{place}|{s}") - (1 << 63) for n, place, s in keys(words_of(light))}
                at += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), b.column(0).take(pa.array(at, pa.int32()))], ["key", "node"])

    return paths.select("node", "near", "light").mapInArrow(run, "key long, node long")


def _verified(bounds: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Links of each bucket (key, node, light, probe), one per row at most: paths that are one without marks, or but for a letter or two.

    Paths that may be one have the same numbers and extension without marks, so only such are compared.
    """
    node, light, probe = b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False)
    left, right = [], []
    for start, end in zip(bounds, bounds[1:]):
        if end - start < 2 or probe[start:end].all():
            continue
        alike: dict[tuple, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in range(start, end):
            plain = unmarked(light[i])
            alike[plain.rpartition(".")[2], *numbers(plain)][plain].append(i)
        at = {int(n): i for i, n in enumerate(np.unique(node[start:end]))}
        ids = np.array(list(at))
        a, c = [], []
        for spellings in alike.values():
            plains = list(spellings)
            for x, plain in enumerate(plains):
                rows = list(spellings[plain])
                for other in plains[:x]:
                    if distance(plain, other, LETTER_EDITS) <= LETTER_EDITS:
                        rows += spellings[other]
                kept = [j for j in rows if not probe[j]]
                for i in rows:
                    if probe[i]:
                        own = words_of(light[i])
                        for j in kept:
                            if node[i] != node[j] and distance(own, words_of(light[j]), EDITS) <= EDITS:
                                a.append(at[int(node[i])])
                                c.append(at[int(node[j])])
        if a:
            label = union_labels(len(ids), np.array(a), np.array(c))
            moved = np.flatnonzero(label != np.arange(len(ids)))
            left.append(ids[moved])
            right.append(ids[label[moved]])
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def repeats(images: DataFrame, scratch: Scratch | None = None, later: int = 0) -> DataFrame:
    """(repeat, accepted): every row that shows a photo which an earlier row shows, with the earliest row of that photo (by added_at, then id).

    The rows become a `History` of their own: all but the last ``later`` days of added_at as one batch, then each of these days. Null or
    invalid hashes and null times never match; an empty table gives an empty result; columns besides id, path, hash,
    file_size, added_at and taken_at are ignored.
    """
    spark = images.sparkSession
    scratch = scratch or Scratch(spark)
    history = History(spark, f"{scratch.root}/history")
    day = F.floor(F.coalesce("added_at", F.lit(-(1 << 62))) / 86_400)
    last = sorted(r.day for r in images.select(day.alias("day")).distinct().orderBy(F.desc("day")).limit(later).collect()) if later else []
    found = history.add(images.where(day < last[0]) if last else images, scratch)
    for k in last:
        found = found.union(history.add(images.where(day == k), scratch))
    if not last:
        return found
    # A repeat accepted before a later batch joined its photo to an earlier one follows that one; a batch adds one step at most.
    found = scratch.save(found)
    for _ in last:
        further = found.select(F.col("repeat").alias("accepted"), F.col("accepted").alias("_first"))
        found = found.join(further, "accepted", "left").select("repeat", F.coalesce("_first", "accepted").alias("accepted"))
    return found


class History:
    """Everything accepted so far, as keys, paths and segments in ``folder``; a batch reads these, not the library.

    ``add`` gives (repeat, accepted) for the rows of a batch and appends the batch. Where a row shows that two
    photos accepted apart are one, the later of them is reported as a repeat then. A batch counts once its manifest is
    written, as the last of its files, so a batch that fails leaves nothing behind that is read, and a folder can be opened
    again at any time. One writer at a time; a second one fails at the manifest.
    """

    KINDS = {
        "keys": "key binary, id long",
        "paths": "near long, node long, light string, bucket int",
        "segments": "key long, node long, bucket int",
        "photos": "id long, root long, root_added long",
        "merges": "root long, into long, into_added long",
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.batches = 0
        while self._fs.exists(self._manifest(self.batches)):
            self.batches += 1

    def _manifest(self, k: int):
        return self._path(f"{self.folder}/manifest/{k:08d}.json")

    def _commit(self, rows: int) -> None:
        to = self._fs.create(self._manifest(self.batches), False)  # fails where there is one
        to.write(bytearray(json.dumps({"batch": self.batches, "rows": rows}).encode()))
        to.close()
        self.batches += 1

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{name}/{k}" for k in range(self.batches)]
        if not paths:
            return self.spark.createDataFrame([], self.KINDS[name])
        read = self.spark.read.schema(self.KINDS[name])
        if buckets is None:
            return read.parquet(*paths)
        parts = [read.parquet(p) for p in paths]
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return out.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))

    def _write(self, name: str, df: DataFrame) -> None:
        to = f"{self.folder}/{name}/{self.batches}"  # what a failed attempt left there is replaced
        if "bucket" in df.columns:
            df.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(to)
        else:
            df.write.mode("overwrite").option("compression", "zstd").parquet(to)

    def add(self, batch: DataFrame, scratch: Scratch | None = None) -> DataFrame:
        scratch = scratch or Scratch(self.spark)
        rows = scratch.save(spelled(batch))
        # 1. Same hash, or the same taken_at and light path.
        keys = rows.select("id", F.explode(F.filter(F.array(F.when(F.col("hash_key").isNotNull(), _digest(F.hex("hash_key"))), F.col("path_key")), lambda k: k.isNotNull())).alias("key"))
        new = keys.groupBy("key").agg(F.min("id").alias("new"), F.count("*").alias("n"))
        old = self._read("keys").join(new.select("key"), "key", "left_semi").withColumnRenamed("id", "old")
        known = scratch.save(new.join(old, "key", "left"))
        alike = known.where("old is not null or n > 1").select("key", F.coalesce("old", "new").alias("node"))
        exact = keys.join(alike, "key").where("id != node").select(F.col("id").alias("a"), F.col("node").alias("b"))
        # 2. Paths that are new, against the segments of all paths taken at the same time.
        fresh = known.where("old is null").select(F.col("key").alias("path_key"), F.col("new").alias("node"))
        nodes = scratch.save(rows.where("light is not null").select("path_key", "taken_at", "light", "id").join(fresh, "path_key").where("id = node").dropDuplicates(["path_key"]).select(near_key().alias("near"), "node", "light", _bucket("taken_at").alias("bucket")))
        buckets = sorted(r.bucket for r in nodes.select("bucket").distinct().collect())
        there = self._read("paths", buckets).join(nodes.select("near").distinct(), "near", "left_semi")
        shared = nodes.select("near", "node", "light", F.lit(True).alias("fresh")).union(there.select("near", "node", "light", F.lit(False)))
        several = shared.groupBy("near").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("near")
        asked = scratch.save(shared.join(several, "near", "left_semi"))
        probes = segments(asked.where("fresh"), True)
        kept = self._read("segments", buckets).select("key", "node").join(asked.where("not fresh").select("node"), "node", "left_semi").select("key", "node").union(segments(asked.where("fresh"), False))
        both = probes.withColumn("probe", F.lit(True)).union(kept.withColumn("probe", F.lit(False)))
        met = both.join(asked.select("node", "light").dropDuplicates(["node"]), "node").select("key", "node", "light", "probe")
        near = met.repartition("key").sortWithinPartitions("key").mapInArrow(by_group(0, _verified), "a long, b long").distinct()
        # 3. What is linked, with the photos that it touches, becomes one photo.
        linked = scratch.save(exact.withColumn("by", F.lit("key")).union(near.withColumn("by", F.lit("segment"))).distinct())
        ends = linked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        touched = self._read("photos").join(ends, "id", "left_semi")
        merges = self._read("merges")
        roots = connected_components(linked.select("a", "b").union(touched.select("id", "root")).union(merges.select("root", "into")), "a", "b", scratch)
        photo = roots.select(F.col("node").alias("id"), F.col("root").alias("photo")).union(roots.select("root", "root").distinct())
        times = rows.select("id", "added_at").union(touched.select("root", "root_added")).union(merges.select("into", "into_added")).distinct()
        timed = photo.join(times, "id")
        first = timed.groupBy("photo").agg(F.min(F.struct("added_at", "id")).alias("first"))
        reported = merges.select(F.col("root").alias("id"))
        found = scratch.save(timed.join(reported, "id", "left_anti").join(first, "photo").where("id != first.id").select("id", F.col("first.id").alias("accepted"), F.col("first.added_at").alias("accepted_at")))
        self.linked = linked
        # 4. The batch joins the history; its tables are written side by side.
        tables = {
            "keys": known.where("old is null").select("key", F.col("new").alias("id")),
            "paths": nodes,
            "segments": segments(nodes, False).join(nodes.select("node", "bucket"), "node").select("key", "node", "bucket"),
            "merges": found.join(rows.select("id"), "id", "left_anti").select(F.col("id").alias("root"), F.col("accepted").alias("into"), F.col("accepted_at").alias("into_added")),
            "photos": rows.select("id", "added_at").dropDuplicates(["id"]).join(found, "id", "left").select("id", F.coalesce("accepted", "id").alias("root"), F.coalesce("accepted_at", "added_at").alias("root_added")),
        }
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(lambda item: self._write(*item), tables.items()))
        self._commit(rows.count())
        return found.select(F.col("id").alias("repeat"), "accepted")

    def links(self) -> DataFrame:
        """(by, links): how many links the last batch got from equal keys, and how many from segments."""
        return self.linked.groupBy("by").agg(F.count("*").alias("links"))
