import random

import pytest

from prismarium.llm.canonical import distance
from prismarium.llm.history import EDITS, History, canonical_path, index_keys, light_path, probe_keys, repeats, same_file, words_of

KIND = "id long, path string, hash binary, file_size long, added_at long, taken_at long, lens string"


def h(k):
    return bytes([k]) * 32


ROWS = [
    (1, "/p/d/IMG_0001.jpg", h(1), 10, 100, 1000, "a"),
    (2, "/p/d/IMG_0001 (1).JPG", h(2), 11, 200, 1000, None),  # 1, named as a copy
    (3, "/q/else.jpg", h(2), 11, 300, None, None),  # the hash of 2, so the photo of 1
    (4, "/p/d/IMG_0001.RAF", h(3), 10, 100, 1000, None),  # a raw file is another photo
    (5, "/p/d/IMG_0001_2.jpg", h(4), 10, 400, 2000, None),  # named as a copy, taken at another time
    (6, "/p/d/IMG_0002.jpg", h(5), 10, 400, 1000, None),  # another number
    (7, "\\P\\D\\img_0002.jpeg", h(6), 10, 50, 1000, None),  # 6 in another spelling, and earlier
    (8, "/z/1.jpg", bytes(32), 10, 1, 5, None),
    (9, "/z/2.jpg", bytes(32), 10, 2, 6, None),
    (10, "/z/3.jpg", h(7), 0, 1, 7, None),
    (11, "/z/4.jpg", h(7), 0, 2, 8, None),
    (12, "/z/5.jpg", b"short", 9, 1, 9, None),
    (13, "/z/6.jpg", b"short", 9, 2, None, None),
    (14, None, None, None, None, None, None),
    (15, None, None, None, None, 7, None),
    (16, "/p/Caf%C3%A9 %26 Bar/./x/../IMG_7.jpg", h(8), 5, 500, 77, None),
    (17, "/p/Café & Bar/Copy of IMG_7.jpg", h(9), 5, 600, 77, None),
    (18, "/p/Cafe _ Bar/IMG_7 - Kopie (2).jpg", h(10), 5, 700, 77, None),  # two edits off
    (19, "/p/d/IMG_0001.jpg", None, 10, 900, 1000, None),
]
TRUE = {(2, 1), (3, 1), (19, 1), (6, 7), (17, 16), (18, 16)}


def test_repeats(spark):
    assert {(r["repeat"], r.accepted) for r in repeats(spark.createDataFrame(ROWS, KIND)).collect()} == TRUE
    assert repeats(spark.createDataFrame([], KIND)).count() == 0


def test_batches_equal_the_whole(spark, tmp_path):
    rows = [r for r in ROWS if r[4] is not None]
    draw = random.Random(3)
    for k in range(20, 60):  # more photos and their copies, in random order of time
        base = draw.choice([r for r in rows if r[1] and r[5]])
        name = draw.choice(["{}", "{} (1)", "Copy of {}"]).format(base[1].replace("\\", "/").rpartition("/")[2].rpartition(".")[0])
        rows.append((k, f"/p/d/{name}.jpg", draw.choice([base[2], h(k)]), 10, draw.randrange(1000), base[5], None))
    whole = {(r["repeat"], r.accepted) for r in repeats(spark.createDataFrame(rows, KIND)).collect()}
    seen, links = {}, {}
    for start, end in ((0, 300), (300, 500), (500, 2000)):
        index = History(spark, str(tmp_path / "index"))  # the folder is opened anew for every batch
        assert index.batches == (0 if not start else 1 if start == 300 else 2)
        for r in index.add(spark.createDataFrame([x for x in rows if start <= x[4] < end], KIND)).collect():
            seen[r["repeat"]] = r.accepted

    def first(k):
        while k in seen:
            k = seen[k]
        return k

    assert {(k, first(k)) for k in seen} == whole
    assert {(r["repeat"], r.accepted) for r in repeats(spark.createDataFrame(rows, KIND), later=3).collect()} == whole
    assert {r.by for r in index.links().collect()} == {"key", "segment"} and all(r.links > 3 for r in index.links().collect())
    assert index.add(spark.createDataFrame([], KIND)).count() == 0


def test_a_batch_without_a_manifest_does_not_count(spark, tmp_path):
    at = str(tmp_path / "index")
    first = spark.createDataFrame([r for r in ROWS if r[0] in (1, 6)], KIND)
    failing = History(spark, at)
    failing._commit = lambda rows: (_ for _ in ()).throw(OSError("down"))
    with pytest.raises(OSError):
        failing.add(first)
    again = History(spark, at)
    assert again.batches == 0 and again.add(first).count() == 0 and again.batches == 1
    assert {(r["repeat"], r.accepted) for r in History(spark, at).add(spark.createDataFrame([r for r in ROWS if r[0] in (2, 19)], KIND)).collect()} == {(2, 1), (19, 1)}
    with pytest.raises(Exception, match="exist"):  # a rival that opened the same state
        again._commit(0)


def test_a_merge_is_remembered(spark, tmp_path):
    index = History(spark, str(tmp_path / "index"))
    batches = [[(1, "/a/x1.jpg", h(1), 5, 10, 5, "")], [(2, "/b/y2.jpg", h(2), 5, 20, 6, "")], [(3, "/b/y2.jpg", h(1), 5, 30, 6, "")], [(4, "/c/z3.jpg", h(2), 5, 40, 7, "")]]
    got = [sorted((r["repeat"], r.accepted) for r in index.add(spark.createDataFrame(b, KIND)).collect()) for b in batches]
    assert got == [[], [], [(2, 1), (3, 1)], [(4, 1)]]


@pytest.mark.parametrize(
    "path",
    ["/photos/a b/IMG_1234.JPG", "\\photos\\A B\\img_1234.jpg", "//photos/./a b/IMG_1234.jpeg ", "/photos/x/../a%20b/IMG_1234~2.jpg", "/photos/a b/IMG_1234_1.jpg", "/photos/a b/IMG_1234 - Copy (1).jpg", "/photos/a b/Copy of IMG_1234_copy.jpg", "/photos/a b/IMG_1234(2).jpg\0", "file:///photos/a b/IMG_1234.jpg"],
)
def test_one_spelling(path):
    assert canonical_path(path) == "/photos/a b/img_1234.jpg"[1:] or canonical_path(path) == "photos/a b/img_1234.jpg"


def test_odd_paths():
    assert canonical_path("") == "/." and canonical_path("copy of ") and canonical_path("(1).jpg") and canonical_path("/a/100%.jpg") == "a/100%.jpg"
    assert canonical_path("x" * 100_000 + ".jpg").endswith(".jpg")
    assert canonical_path("/a/IMG_12_1.jpg") == "a/img_12_1.jpg"  # too short a number to be a copy's


def test_segments_find_everything_within_reach():
    draw = random.Random(1)
    for _ in range(400):
        s = "".join(draw.choice("abc/") for _ in range(draw.randrange(1, 25)))
        t = list(s)
        for _ in range(draw.randrange(EDITS + 1)):
            at = draw.randrange(len(t) + 1)
            t[at : at + draw.randrange(2)] = draw.choice(["", "x", "a"])
        t = "".join(t)
        plain = distance(s, t, EDITS) <= EDITS and "ba" * 9 != s
        if plain and edits(s, t) <= EDITS:
            assert set(index_keys(s)) & set(probe_keys(t)), (s, t)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_marks_of_copies_are_few_words():
    assert light_path("/a/B.JPG") == "a/b.jpg" and light_path("/a/b (1).jpg") != light_path("/a/b.jpg")
    for name, words in (("b", 0), ("b (1)", 1), ("b~2", 1), ("copy of b", 2), ("copy of b - kopie (2)", 4)):
        assert len(words_of(light_path(f"/a/{name}.jpg"))) - 3 == words
        assert set(index_keys(words_of("a/b.jpg"))) & set(probe_keys(words_of(light_path(f"/a/{name}.jpg"))))


def test_same_file():
    assert same_file("a/cafe _ bar/x1.jpg", "a/cafe & bar/x1.jpg") and not same_file("a/x1.jpg", "a/x2.jpg") and not same_file("a/x1.jpg", "a/x1.raf")
