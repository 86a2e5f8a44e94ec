import threading
import time

import pytest
from pyspark.sql import functions as F

from prismarium.library import Conflict, Library
from prismarium.operators import queues
from prismarium.schemas import DDL, conform
from prismarium.streaming import workers
from tests.test_sources import exif_jpeg


def library(spark, tmp_path, paths):
    lib = Library.open(spark, str(tmp_path / "lib"))
    images = spark.createDataFrame([(k, p, "present", p.rpartition("/")[2]) for k, p in enumerate(paths, 1)], "id long, path string, status string, filename string")
    lib.commit(images=conform(images, "images"))
    return lib


def test_describer_and_face_finder(spark, rows, tmp_path):
    lib = library(spark, tmp_path, ["/a.jpg", "/fails.jpg", "/none.jpg"])

    def say():
        def describe(path):
            if "fails" in path:
                raise OSError(path)
            return f"at {path}"

        return describe

    w = workers.describer(lib, "m", say, lambda: 5)
    assert w.run_once() == 2 and w.run_once() == 0  # the failing one stays in the queue
    assert rows(lib.table("ai_descriptions"), "image_id", "description") == [(1, "at /a.jpg"), (3, "at /none.jpg")]

    def find():
        def faces(path):
            if "fails" in path:
                raise OSError(path)
            return [] if "none" in path else [([0.1, 0.1, 0.2, 0.2], [1.0], 0.9), ([0.3, 0.1, 0.4, 0.2], [1.0], 0.8)]

        return faces

    assert workers.face_finder(lib, find).run_once() == 2
    assert rows(lib.table("face_detections"), "image_id", "confidence") == [(1, 0.8), (1, 0.9), (3, -1.0)]
    assert rows(queues.needing_faces(lib.table("images"), lib.table("face_detections")), "id") == [(2,)]


def test_scanner_and_metadata(spark, rows, tmp_path):
    folder = tmp_path / "pics"
    lib = library(spark, tmp_path, [str(folder / "old.jpg")])
    w = workers.scanner(lib, str(folder), lambda: 7)
    assert w.run_once() == 0  # no folder yet
    folder.mkdir()
    (folder / "new.jpg").write_bytes(exif_jpeg())
    (folder / "new.RAF").write_bytes(b"raw")
    assert w.run_once() == 2 and w.run_once() == 0
    assert rows(lib.table("images").select("status", F.element_at(F.split("path", "/"), -1), F.element_at(F.split("raw_path", "/"), -1))) == [("missing", "old.jpg", None), ("present", "new.jpg", "new.RAF")]
    assert workers.metadata_filler(lib).run_once() == 0  # inserts fill in file names, so this queue stays empty
    assert workers.metadata_filler(lib, queues.never_extracted).run_once() == 2
    assert rows(lib.table("images").where("make is not null"), "make", "taken_at") == [("Canon", 1710513045)]


def test_stream_follows_new_files(spark, tmp_path):
    lib = library(spark, tmp_path, ["/a.jpg"])
    seen = []
    w = workers.Worker("counting", spark, lambda: seen.append(1) or 1)
    files = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "p", 0)], DDL["persons"])
    rows.write.parquet(files)
    for expected in (1, 1):
        w.follow(files, "persons", str(tmp_path / "cp")).awaitTermination()
        assert len(seen) == expected  # nothing new, no round
    rows.write.mode("append").parquet(files)
    w.follow(files, "persons", str(tmp_path / "cp")).awaitTermination()
    assert len(seen) == 2 and lib is not None


def test_polling_backs_off_and_stops(spark, tmp_path):
    waits = []

    def fails():
        raise OSError("down")

    w = workers.Worker("failing", spark, fails, workers.Backoff(3.0, waits.append))
    for _ in range(4):
        assert w.run_once() == 0
    assert waits == [1.0, 2.0, 3.0, 3.0]
    good = workers.Worker("polling", spark, lambda: 1).start(str(tmp_path / "poll"), "1 second")
    good.query.processAllAvailable()
    good.stop()
    assert good.handled >= 1 and not good.query.isActive


def test_of_two_writers_the_later_reads_again(spark, tmp_path):
    lib = library(spark, tmp_path, ["/a.jpg"])
    before = lib.snapshot()
    persons = spark.createDataFrame([(1, "p", 0)], DDL["persons"])
    assert lib.commit(before, persons=persons) == 2
    assert lib.commit(before, images=lib.table("images").where("id < 0")) == 3  # another table than the rival's
    assert lib.table("persons").count() == 1 and lib.table("images").count() == 0 and before.table("images").count() == 1
    with pytest.raises(Conflict):
        lib.commit(before, persons=persons.limit(0))
    assert lib.table("persons").count() == 1 and lib.snapshot().number == 3


def test_workers_at_once_lose_nothing(spark, rows, tmp_path):
    lib = library(spark, tmp_path, [f"/{k}.jpg" for k in range(6)])
    slow = lambda out: (lambda: (lambda path: time.sleep(0.2) or out))
    both = [workers.describer(lib, "m", slow("text"), lambda: 5), workers.face_finder(lib, slow([([0.1, 0.1, 0.2, 0.2], [1.0], 0.9)])), workers.describer(lib, "n", slow("other"), lambda: 6)]
    for w in both:
        w.backoff.sleep = lambda s: None
    for _ in range(3):  # the two describers write one table, so one of them may have to come again
        threads = [threading.Thread(target=w.run_once) for w in both]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert rows(lib.table("ai_descriptions").groupBy("model_id").count()) == [("m", 6), ("n", 6)]
    ids = [r.id for r in lib.table("ai_descriptions").collect()]
    assert sorted(ids) == list(range(1, 13)) and lib.table("face_detections").count() == 6


def test_tagging_sessions(spark, rows):
    log = [("s", 1, "assign", 1, 10), ("s", 2, "assign", 2, 20), ("s", 3, "back", None, None), ("s", 4, "skip", 2, None), ("s", 5, "assign", 1, 11), ("s", 6, "back", None, None), ("t", 1, "back", None, None), ("t", 2, "assign", 9, 1)]
    df = spark.createDataFrame(log, "session string, seq long, action string, face_id long, person_id long")
    assert rows(workers.sessions(df), "session", "face_id", "action", "person_id") == [("s", 1, "assign", 10), ("s", 2, "skip", None), ("t", 9, "assign", 1)]
