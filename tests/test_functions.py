import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismarium.functions import bloom, dates, geometry, paths, texts
from prismarium.operators import faces, files


def test_paths(spark, rows):
    names = ["/x/photo.jpg", "/x/A.RAF", "/x/.hidden.jpg", "/x/._D.JPG", "b.txt", "/x.y/noext", "/x/.profile", "/x/a.b.PNG", "/x/e.", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: tuple(r)[1:] for r in df.select("p", paths.basename("p"), paths.parent("p"), paths.stem("p"), paths.lower_extension("p"), paths.is_image("p"), paths.is_raw("p"), paths.mime_type("p")).collect()}
    assert got["/x/photo.jpg"] == ("photo.jpg", "/x", "photo", "jpg", True, False, "image/jpeg")
    assert got["/x/A.RAF"] == ("A.RAF", "/x", "A", "raf", True, True, "image/jpeg")
    assert got["/x/.hidden.jpg"][4] is False and got["/x/._D.JPG"][4] is False and got["b.txt"][1:5] == ("", "b", "txt", False)
    assert got["/x.y/noext"][1:4] == ("/x.y", "noext", "") and got["/x/.profile"][2:4] == (".profile", "")
    assert got["/x/a.b.PNG"][2:] == ("a.b", "png", True, False, "image/png") and got[None][0] is None


def test_camera_dates(spark):
    cases = {"2024:03:15 14:30:45": 1710513045, "1970:01:01 00:00:00": 0, "2024:01:01 00:00:00": 1704067200, "0000:00:00 00:00:00": -62169984000, "2024:02:30 00:00:00": 1709251200, "2023:13:01 00:00:00": 1704067200, "2024:03:15": None, "not-a-date": None, "": None, "2024-03-15T14:30:45Z": 1710513045, "20x4:03:15 14:30:45": None, None: None}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.e for r in df.select("s", dates.exif_epoch("s").alias("e")).collect()} == cases
    f = df.where("s = '2024:03:15 14:30:45'").select(*(dates.folder(dates.exif_fields("s"), p) for p in ("%Y/%m", "%Y-%m-%d", "%H")), dates.timestamp_text(F.lit(-1))).first()
    assert tuple(f) == ("2024/03", "2024-03-15", "%H", "1969-12-31  23:59:59")


def test_texts(spark):
    df = spark.createDataFrame([("Canon", "R5", "L", 2.5, 0.25, 100, 30, 20, 6), ("Canon", None, None, None, 2.8, None, 30, None, 9), (None, "R5", None, None, None, None, None, None, None)], "make string, model string, lens string, focal_length double, aperture double, iso long, width long, height long, orientation long")
    got = [tuple(r) for r in df.select(texts.info_line(), texts.orientation("orientation")).collect()]
    assert got == [("Canon R5 · L · 2 mm  f/0.2 · ISO 100 · 30 × 20", "Rotated 90° CW"), ("Canon", "Unknown"), ("", None)]
    sims = spark.createDataFrame([(0.875,), (0.5,), (0.4999,), (math.inf,), (math.nan,), (None,)], "s double")
    assert [tuple(r) for r in sims.select(texts.similarity_text("s"), texts.similarity_class("s")).collect()] == [("87.5%", "success"), ("50.0%", "warning"), ("50.0%", "dim-label"), (None, None), (None, None), (None, None)]
    one = spark.range(1).select(texts.scan_summary(F.lit(5), F.lit(1), F.lit(2)), texts.scan_summary(F.lit(5), F.lit(0), F.lit(0)), texts.copy_summary(F.lit(1), F.lit(0)), texts.copy_summary(F.lit(2), F.lit(1)), texts.count_of_images(F.lit(1)))
    assert tuple(one.first()) == ("5 images (1 imported, 2 skipped)", "5 images", "Copied 1 image", "Copied 2, 1 failed", "1 image")


def window(current, total, size):
    """The rule in words: as many as fit, half of them before, shifted into the range."""
    if not total or not size:
        return 0, 0
    n = min(size, total)
    start = min(max(current - (n - 1) // 2, 0), total - n)
    return start, start + n


def test_windows(spark):
    cases = [(c, t, s) for t in (0, 1, 2, 5, 8) for s in (0, 1, 2, 3, 9) for c in range(max(t, 1))]
    df = spark.createDataFrame(cases, "c long, t long, s long").select("c", "t", "s", geometry.buffer_window(F.col("c"), F.col("t"), F.col("s")).alias("w"))
    for r in df.collect():
        assert tuple(r.w) == window(r.c, r.t, r.s), r
    sizes = spark.createDataFrame([(0, 5), (100, 50), (4000, 3000)], "w long, h long").select(geometry.window_size(F.col("w"), F.col("h")).alias("s"))
    assert [tuple(r.s) for r in sizes.collect()] == [(960, 720), (1400, 782), (1037, 860)]


def test_rectangles(spark):
    box = tuple(F.lit(x) for x in (0.25, 0.0, 0.75, 1.0))
    zero = F.lit(0.0)
    fit = geometry.screen_rect(box, (F.lit(100.0), F.lit(50.0)), (F.lit(200.0), F.lit(200.0)), F.lit(1.0), (zero, zero))
    zoom = geometry.screen_rect(box, (F.lit(100.0), F.lit(50.0)), (F.lit(200.0), F.lit(200.0)), F.lit(2.0), (F.lit(10.0), zero))
    none = geometry.screen_rect(box, (zero, F.lit(50.0)), (F.lit(200.0), F.lit(200.0)), F.lit(1.0), (zero, zero))
    r = spark.range(1).select(fit.alias("f"), zoom.alias("z"), none.alias("n"), geometry.hit(fit, F.lit(50.0), F.lit(50.0)).alias("h")).first()
    assert tuple(r.f) == (50, 50, 100, 100) and tuple(r.z) == (90, 0, 200, 200) and r.n is None and r.h


def test_bloom_math(spark):
    import hashlib

    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(300)] + [b"\xff" * 32, b"\0" * 32]
    for bits in (8192, 1 << 20):
        df = spark.createDataFrame([(d,) for d in digests], "h binary").select("h", bloom.position_column("h", bits).alias("p"))
        arr = bloom.positions(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32), bits)
        exact = {d: [((int.from_bytes(d[:8], "little") + i * (int.from_bytes(d[8:16], "little") | 1)) & (1 << 64) - 1) % bits for i in range(7)] for d in digests}
        assert {bytes(r.h): list(r.p) for r in df.collect()} == exact
        assert arr.tolist() == [exact[d] for d in digests]
    assert [bloom.optimal_bits(n) for n in (0, 819, 820, 854, 855)] == [8192, 8192, 8192, 8192, 16384]
    b = bloom.Bloom(digests[:100])
    assert all(d in b for d in digests[:100]) and sum(d in b for d in digests[100:]) < 10


def test_vectors(spark, rows):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(faces.dot("a", "b")).collect()] == [3.0, 0.0, 0.0, 0.0]
    assert [[round(x, 4) for x in r[0]] for r in df.select(faces.l2_normalize("a")).collect()] == [[0.6, 0.8], [], [1.0], [0.0, 0.0]]
    assert [list(r[0]) for r in df.select(faces.from_blob(faces.to_blob("a"))).collect()] == [[3.0, 4.0], [], [1.0], [0.0, 0.0]]
    assert list(spark.createDataFrame([(b"\0\0\x80?\1\2",)], "b binary").select(faces.from_blob("b")).first()[0]) == [1.0]


def test_matching(spark, rows):
    known = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, []), (None, [1.0, 0.0]), (5, [math.nan, 1.0])], "person_id long, embedding array<float>")
    asked = spark.createDataFrame([(10, [0.0, 1.0]), (11, [1.0]), (12, None), (13, [0.8, 0.6])], "query_id long, embedding array<float>")
    got = [(q, r, p, round(s, 4)) for q, r, p, s in rows(faces.best_matches(asked, known, 2, 0.8, 2))]
    assert got == [(10, 1, 2, 1.0), (10, 2, 3, 1.0), (13, 1, 1, 0.96)]
    assert rows(faces.best_matches(asked, known, 2, 0.8, 0)) == []
    persons = spark.createDataFrame([(k, n) for k, n in zip(range(1, 7), "FEDCBA")], "id long, name string")
    top = [(q, r, p) for q, r, p, _, _ in rows(faces.top_k(asked, known, persons, 2, 4))]
    assert top[:4] == [(10, 1, 2), (10, 2, 3), (10, 3, 1), (10, 4, 4)]
    assert top[4:8] == [(11, 1, 6), (11, 2, 5), (11, 3, 4), (11, 4, 3)]
    assert faces.top_k(asked, known, persons.limit(0), 2, 4).count() == 0 and faces.top_k(asked, known, persons, 2, 0).count() == 0
    f = spark.createDataFrame([(1, 2, None), (2, None, [0.0, 1.0]), (3, None, [-1.0, 0.0]), (4, 99, None)], "id long, person_id long, embedding array<float>")
    assert rows(faces.labels(f, known, persons, 2, 0.5)) == [(1, "E", True, False), (2, "E", False, True), (3, "?", False, False), (4, "?", True, False)]
    assert faces.dimension(known.withColumn("face_id", F.lit(1))) == 2


def test_file_groups(spark, rows):
    f = spark.createDataFrame([("/a/D1.RAF", 1), ("/a/d1.JPG", 2), ("/a/D2.jpg", 3), ("/a/D3.raf", 4), ("/b/d1.jpg", 5), ("/a-b/x.jpg", 6), ("/a/D1.png", 7), (None, 8)], "path string, size long")
    g = files.group_files(f)
    got = {(r.dir, r.stem): (r.display.path, [c.path for c in r.companions]) for r in g.collect()}
    assert got[("/a", "d1")] == ("/a/D1.png", ["/a/D1.RAF", "/a/d1.JPG"]) and got[("/a", "d3")] == ("/a/D3.raf", []) and len(got) == 5
    assert rows(files.companions_count(g)) == [(5, 1)]
    assert [p for _, p, _ in rows(files.paths_for_copy(g, "raw_only"))] == ["/a-b/x.jpg", "/a/D1.RAF", "/a/D2.jpg", "/a/D3.raf", "/b/d1.jpg"]
    assert files.paths_for_copy(g, "all").count() == 7 and files.paths_for_copy(g, "display_only").count() == 5


def test_copy_names(spark, rows):
    plan = spark.createDataFrame([("/o", "/x/p.jpg", 1), ("/o", "/y/p.jpg", 2), ("/o", "/z/p_1.jpg", 3), ("/o", "/z/q", 4), ("/o", "/w/p.jpg", 5)], "dir string, source string, seq long")
    there = spark.createDataFrame([("/o/p_2.jpg",), ("/o/q",)], "path string")
    assert rows(files.name_copies(plan, there)) == [("/w/p.jpg", "/o/p_3.jpg"), ("/x/p.jpg", "/o/p.jpg"), ("/y/p.jpg", "/o/p_1.jpg"), ("/z/p_1.jpg", "/o/p_1_1.jpg"), ("/z/q", "/o/q_1")]


def test_merge_and_reconcile(spark, rows):
    from prismarium.schemas import conform

    i = conform(spark.createDataFrame([(1, "/a/x.raf"), (2, "/a/X.jpg"), (3, "/a/x.RAF"), (4, "/b/x.raf"), (5, None)], "id long, path string"), "images")
    kept, gone = files.merge_raw_rows(i)
    assert rows(kept, "id", "raw_path") == [(2, "/a/x.raf"), (3, None), (4, None), (5, None)] and rows(gone) == [(1,)]
    lib = spark.createDataFrame([("/a", "present"), ("/b", "missing"), ("/c", "present"), ("/d", "missing"), ("/e", "odd")], "path string, status string")
    disk = files.group_files(spark.createDataFrame([("/b", 1), ("/c", 2), ("/n.jpg", 3), ("/n.png", 4)], "path string, size long"))
    assert rows(files.reconcile(lib, disk)) == [("/a", "mark_missing", None, None), ("/b", "mark_present", None, None), ("/e", "mark_missing", None, None), ("/n.jpg", "insert", 3, "/n.png")]


def test_unknown_mode(spark):
    with pytest.raises(KeyError):
        files.paths_for_copy(files.group_files(spark.createDataFrame([], "path string, size long")), "none")
