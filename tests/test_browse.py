import numpy as np

from prismarium.operators import browse, detect
from prismarium.operators.search import where_camera
from tests.test_sources import exif_jpeg


def test_decisions(spark, rows):
    images = spark.createDataFrame([("s", k, k == 4, k == 5) for k in range(1, 8)], "session string, idx long, imported boolean, rejected boolean")
    log = [(1, "leave"), (2, "toggle"), (2, "leave"), (3, "toggle"), (3, "toggle"), (3, "leave"), (4, "leave"), (5, "toggle"), (6, "leave"), (6, "toggle")]
    df = spark.createDataFrame([("s", n, k, a) for n, (k, a) in enumerate(log)], "session string, seq long, idx long, action string")
    got = {r[1]: r[2:] for r in rows(browse.decisions(df, images))}
    assert got == {1: (False, True), 2: (True, False), 3: (False, True), 4: (False, False), 5: (True, False), 6: (True, False), 7: (False, False)}


def test_scan_with_flags(spark, rows, tmp_path):
    (tmp_path / "a.jpg").write_bytes(exif_jpeg())
    (tmp_path / "a.RAF").write_bytes(b"raw")
    (tmp_path / "b.jpg").write_bytes(b"b")
    none = spark.createDataFrame([], "hash binary")
    found = browse.scan_with_flags(spark, str(tmp_path), none, none, 2).cache()
    assert found.count() == 2
    again = browse.scan_with_flags(spark, str(tmp_path), found.where("stem = 'a'").select("hash"), none)
    assert rows(again, "stem", "imported", "rejected") == [("a", True, False), ("b", False, False)]


def test_results_and_filters(spark, rows):
    infos = spark.createDataFrame([(1, "x"), (2, "y")], "position long, source string")
    done = spark.createDataFrame([(1, "/o/x", None), (2, None, "bad")], "position long, dest string, error string")
    assert rows(browse.with_results(infos, done)) == [(1, "x", "/o/x", None), (2, "y", None, "bad")]
    images = spark.createDataFrame([(1, 10, 100, "Norvik"), (2, None, 100, "NORVIK"), (3, 20, None, None)], "id long, taken_at long, iso long, make string")
    assert rows(where_camera(images), "id") == [(1,), (2,), (3,)]
    assert rows(where_camera(images, 5, 15), "id") == [(1,)] and rows(where_camera(images, iso_to=100, make="norvik"), "id") == [(1,), (2,)]


def test_aligned_faces():
    found = detect.aligned_faces(np.array([[10.0, 10, 60, 200]]), np.array([0.7]), np.zeros((1, 224, 224, 3), np.uint8), 0.5, 100, 100, lambda c: np.array([2.0, 0.0]))
    assert found[0][0] == [0.2, 0.2, 1.0, 1.0] and found[0][1].tolist() == [1.0, 0.0] and found[0][2] == 0.7
