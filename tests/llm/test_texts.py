import random
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismarium.llm.bpe import PATTERN, Encoder, PerfectHash, counted, encode, load_ranks
from prismarium.llm.mixing import mix, pivotal
from prismarium.llm.reading import Models, formula_level, prose, reading_levels, words


@pytest.fixture(scope="module")
def both():
    tokens = load_ranks()
    return Encoder(tokens), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_perfect_hash():
    for n in (0, 1, 2, 50, 3000):
        keys = [str(k * 7919).encode() for k in range(n)]
        h = PerfectHash(keys)
        assert sorted(h.slot_key.tolist()) == list(range(n)) and all(h.candidate(k) == i for i, k in enumerate(keys))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_a_known_encoder(both, text):
    own, known = both
    assert own.encode(text) == known.encode_ordinary(text)


def test_hard_texts(both):
    own, known = both
    for text in ("<|endoftext|>", " \n\n  a 　b\t", "éé😀👨‍👩‍👧", "zzz" * 3000, "漢字かな" * 500, "a1b2 'S 're", "\x00\x1c\x85"):
        assert own.encode(text) == known.encode_ordinary(text)
    assert own.count("ab" * 100_000) == len(own.encode("ab" * 100_000)) == 100_000
    assert own.encode(None) == own.encode("") == []


def test_encoding_a_table(spark, both, rows):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, None), (None, "hello world", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode(df).collect()}
    assert got == {1: both[1].encode_ordinary("hello world"), 2: [], 3: [], None: got[1]}
    assert encode(df.limit(0)).count() == 0
    assert rows(counted(df, "doc_id")) == [(1, 2), (2, 0), (3, 0), (None, 2)]


def test_pivotal_keeps_mass_and_expectation():
    draw = random.Random(2)
    docs = [(k, draw.randrange(1, 50), 0.3) for k in range(200)]
    total, chosen = sum(w * p for _, w, p in docs), Counter()
    for seed in range(300):
        settled, held = pivotal(docs, seed)
        assert len(settled) == 200 - (held is not None) and {p for _, p in settled} <= {0.0, 1.0}
        weight = dict((k, w) for k, w, _ in docs)
        assert abs(sum(weight[k] * p for k, p in settled) + (held[1] * held[2] if held else 0) - total) < 1e-6
        chosen.update(k for k, p in settled if p)
        if held:
            chosen[held[0]] += held[2]
    assert all(0.15 < chosen[k] / 300 < 0.45 for k in range(200))
    assert pivotal([(1, 5, 0.0), (2, 5, 1.0)], 1) == ([(1, 0.0), (2, 1.0)], None) and pivotal([], 1) == ([], None)


TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("none", 0.1, 2), ("z", 0.1, 0), (None, 0.2, 3)]


def mixture(spark, **more):
    draw = random.Random(4)
    docs = [(k, "word " * draw.randrange(1, 9), "a" if k % 3 else "b", "x") for k in range(600)] + [(1000, None, "a", ""), (1001, "", "b", ""), (1002, "text", None, ""), (1003, "text", "c", ""), (None, "text", "a", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, copies string").repartition(5)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    mixed, report = mix(d, t, **more)
    return {r.doc_id: r for r in mixed.collect()}, {r.source: r for r in report.collect()}


def test_mixture_reaches_its_shares(spark):
    mixed, report = mixture(spark)
    assert set(report) == {"a", "b", "none", "z"}
    assert abs(report["a"].actual_share - 0.5 / 0.8) < 0.01 and abs(report["b"].actual_share - 0.3 / 0.8) < 0.01
    assert report["none"].actual_share == report["z"].actual_share == 0 and report["none"].tokens == 0
    assert all(r.copies <= {"a": 1, "b": 4}[r.source] for r in mixed.values()) and not {1000, 1001, 1002, 1003} & set(mixed)
    assert report["a"].tokens == sum(r.tokens * r.copies for r in mixed.values() if r.source == "a")


def test_mixture_of_a_size(spark):
    mixed, report = mixture(spark, total=400.0)
    assert abs(sum(r.tokens * r.copies for r in mixed.values()) - 400) <= 2 * 9
    mixed, report = mixture(spark, total=1e9)
    assert all(r.copies == {"a": 1, "b": 4}[r.source] for r in mixed.values()) and report["b"].most_copies == 4


def test_mixture_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    mixed, report = mix(d, t)
    assert mixed.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
    assert mix(d, t.limit(0))[1].count() == 0


EASY = {"en": "the cat is red and we see a dog in the park it is big", "de": "der hund ist rot und wir sehen ein kind im park das ist neu"}
HARD = {"en": "notwithstanding the epistemological contingency of representation which presupposes an ontological indexicality in the discourse", "de": "ungeachtet der erkenntnistheoretischen kontingenz der darstellung die eine ontologische indexikalität voraussetzt und überformt"}


def text(draw, kind, n=60):
    out = []
    while len(out) < n:
        out += draw.sample(kind.split(), 8)
    return " ".join(out) + "."


def test_levels_on_held_out_texts(spark):
    draw = random.Random(6)
    docs = [(k, text(draw, (EASY if k % 2 else HARD)["en" if k % 3 else "de"])) for k in range(300)]
    labels = [(k, f"p{a}", (1 if k % 2 else 5) + (a == 1) * (1 if k % 2 else -1) * (k % 7 == 0)) for k in range(200) for a in range(3)]
    got = {r.doc_id: r.reading_level for r in reading_levels(spark.createDataFrame(docs, "doc_id long, text string").withColumn("reading_level", F.lit("x")), spark.createDataFrame(labels, "doc_id long, annotator string, reading_level long")).collect()}
    right = sum(got[k] == (1 if k % 2 else 5) for k in range(200, 300))
    assert len(got) == 300 and right >= 97


def test_what_is_no_prose(spark):
    log = "\n".join(f"19:51:1{k} INFO copied /photos/IMG_{k}.JPG (123 bytes)" for k in range(40))
    tags = ", ".join(["hat", "wide lens", "street scenes", "zoo"] * 20)
    other = "Это просто русский текст о фотографии и о море " * 10
    for t in (None, "", "  ", "The cat is here.", log, tags, other, "?! " * 100):
        assert prose(t) is None
    assert prose(text(random.Random(1), EASY["de"]))[0] == "de" and prose(("the cat is on the mat and we see it " * 100_000))[0] == "en"
    assert words("L’arbre Été don't") == ["l'arbre", "été", "don't"]


def test_without_labels_a_formula_seeds(spark):
    docs = [(k, text(random.Random(k), (EASY if k % 2 else HARD)["en"])) for k in range(40)] + [(99, None)]
    labels = spark.createDataFrame([], "doc_id long, annotator string, reading_level long")
    got = reading_levels(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert len(got) == 40 and formula_level("A b. C d.", ["a", "b", "c", "d"]) == 1
    assert reading_levels(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0
    assert Models([], [0] * 5).level("en", ["x"]) == 1


def test_a_mixture_does_not_depend_on_files(spark):
    draw = random.Random(8)
    docs = [(k, draw.choice(["a", "a", "a", "b", "c"]), "word " * draw.randrange(1, 60)) for k in range(600)]
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 3), ("c", 0.2, 1), ("none", 0.1, 1)], "source string, target_share double, max_repeats long")
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = [sorted(tuple(r) for r in mix(x, targets)[0].collect()) for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("doc_id")))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_words_that_occur_once_count():
    models = Models([("en", "the", [5, 5, 5, 5, 5]), ("en", "once", [0, 0, 1, 0, 0])], [1, 1, 1, 1, 1])
    assert models.level("en", ["the", "once"]) == 3 and models.level("en", ["unknown"]) == 1
