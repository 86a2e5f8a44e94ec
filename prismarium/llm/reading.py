"""Problem 8: the reading level of each document, by smoothed unigram language models per language and level."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
#: The models are fitted on about this many labelled documents (never more than twice as many), chosen by a hash of their ids.
LABELLED = 20_000
#: With fewer labelled documents than this, texts whose level a formula gives are added.
FEWEST, SEEDED = 30, 2_000
#: Occurrences of every word that are added to its counts, spread over the levels as all words are.
SMOOTHING = 1.0
LEAST_WORDS, LEAST_FUNCTION_WORDS, LEAST_DIFFERENT = 40, 0.125, 2
#: The most frequent function words of each language.
FUNCTION_WORDS = {
    "de": "der die das ein eine einen einem und ist sind war waren in im zu von mit auf für wir sie er es ich nicht auch dass dem den des sich bei aus als wie wenn nach weil an am hat haben",
    "en": "the a an and of to in is are was were it that this for on with as at by from we you they he she i my our not but or be have has had which when than if so",
    "es": "el la los las un una unos y es son era de del en al que no se con por para su lo como más pero me mi muy una este esta fue si o nos cuando",
    "fr": "le la les un une des et est sont était de du en à au aux il elle nous on que qui dans pour pas sur avec ce cette se sa son mon plus par ne si ou comme",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFC", text).casefold().replace("’", "'"))


def prose(text: str | None) -> tuple[str, list[str]] | None:
    """(language, words) of a text with at least LEAST_WORDS words of running prose in a known language, else None.

    Running prose is known by its function words, which lists, logs and field dumps lack; what lang says is not asked.
    """
    if not text or len(text.split()) < LEAST_WORDS:
        return None
    found = words(text)
    if not found:
        return None
    counts = {k: sum(map(v.__contains__, found)) for k, v in _FUNCTION.items()}
    language = max(sorted(counts), key=counts.__getitem__)
    if counts[language] < LEAST_FUNCTION_WORDS * len(found) or len(_FUNCTION[language].intersection(found)) < LEAST_DIFFERENT:
        return None
    return language, found


def formula_level(text: str, found: list[str]) -> int:
    """A level from sentence length and the share of long words (the LIX formula)."""
    sentences = max(1, len(re.findall(r"[.!?:]+(?:\s|$)", text)))
    lix = len(found) / sentences + 100 * sum(len(w) > 6 for w in found) / max(1, len(found))
    return 1 + sum(lix >= x for x in (25, 37, 50, 65))


class Models:
    """Log probabilities of words by language and level, relative to the language's own, and of the levels."""

    def __init__(self, rows: list[tuple[str, str, list[int]]], levels: list[int]):
        total: dict[str, np.ndarray] = {}
        for language, _, counts in rows:
            total[language] = total.get(language, 0) + np.array(counts, float)
        self.words: dict[str, dict[str, int]] = {k: {} for k in total}
        table = np.zeros((len(rows), LEVELS), np.float32)
        share = {k: (n + 1) / (n + 1).sum() for k, n in total.items()}
        for i, (language, word, counts) in enumerate(rows):
            own = share[language]
            self.words[language][word] = i
            table[i] = np.log((np.array(counts) + SMOOTHING * own) / (sum(counts) + SMOOTHING) / own)
        self.table = table
        self.prior = np.log((np.array(levels, float) + 1) / (sum(levels) + LEVELS))

    def level(self, language: str, found: list[str]) -> int:
        """The level with the highest posterior; the lower one on a tie."""
        known = self.words.get(language, {})
        at = [i for i in map(known.get, found) if i is not None]
        return int((self.prior + self.table[at].sum(0, dtype=np.float64)).argmax()) + 1


def fit(documents: DataFrame, labels: DataFrame) -> Models:
    """Models from documents (doc_id, text) and labels (doc_id, reading_level); a document's level is its annotators' mean."""
    each = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.floor(F.avg("reading_level") + 0.5).cast("int").alias("level"))
    many = each.count()
    if many > LABELLED:
        each = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(LABELLED / many * (1 << 30)))
    learn = documents.select("doc_id", "text").join(F.broadcast(each), "doc_id").select("text", "level")  # at most 2 * LABELLED ids
    if many < FEWEST:
        learn = learn.union(documents.where("text is not null").select("text", F.lit(0).alias("level")).orderBy(F.xxhash64("doc_id")).limit(SEEDED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, level in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                read = prose(text)
                if read:
                    language, found = read
                    level = level or formula_level(text, found)
                    seen.update((language, w, level) for w in found)
                    seen[("", "", level)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))), pa.array([seen[k] for k in keys], pa.int64())], ["language", "word", "level", "n"])

    counts = learn.mapInArrow(count, "language string, word string, level int, n long")
    wide = counts.groupBy("language", "word").agg(*(F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(1, LEVELS + 1)))
    rows = wide.orderBy("language", "word").toArrow()  # the words of at most 2 * LABELLED documents
    found = list(zip(rows["language"].to_pylist(), rows["word"].to_pylist(), zip(*(rows[f"n{k}"].to_pylist() for k in range(1, LEVELS + 1)))))
    return Models([f for f in found if f[1]], next((list(f[2]) for f in found if not f[1]), [0] * LEVELS))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level) of every document with at least 40 words of running prose in English, German, French or Spanish.

    Null, empty and other texts have no row. Whole texts are read where they are; only the models are sent around.
    Without labels the models follow a readability formula; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            ids, levels = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                read = prose(text)
                if read:
                    ids.append(key)
                    levels.append(models.level(*read))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(levels, pa.int32())], ["doc_id", "reading_level"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, reading_level int").select("doc_id", F.col("reading_level").cast("long").alias("reading_level"))
