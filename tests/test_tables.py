import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismarium.functions.bloom import SeenSet
from prismarium.library import Library
from prismarium.operators import collections, commands, queues, seen, tournament
from prismarium.operators.components import connected_components
from prismarium.schemas import DDL, conform
from prismarium.session import Cancellable, Scratch, shared_dir


@pytest.fixture(scope="module")
def images(spark):
    return conform(spark.createDataFrame([(1, "/a.jpg", "present", None), (2, "/b.jpg", "missing", "b.jpg"), (3, "/c.jpg", "present", "c.jpg"), (4, None, "present", "d")], "id long, path string, status string, filename string"), "images")


@pytest.fixture(scope="module")
def faces(spark):
    f = [(1, 1, 0.0, 0.0, 0.0, 0.0, None, -1.0), (2, 3, 0.1, 0.1, 0.2, 0.2, None, 0.9), (3, 2, 0.1, 0.1, 0.2, 0.2, 7, 0.9), (4, 3, 0.0, 0.0, 0.0, 0.0, None, 0.5)]
    return conform(spark.createDataFrame(f, "id long, image_id long, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, person_id long, confidence double"), "face_detections")


def test_queues(spark, rows, images, faces):
    said = spark.createDataFrame([(1, 1, "m", "x", 1), (2, 3, "other", "x", 1)], DDL["ai_descriptions"])
    assert rows(queues.needing_description(images, said, "m"), "id") == [(3,), (4,)]
    assert rows(queues.needing_faces(images, faces), "id") == [(4,)]
    assert rows(queues.with_untagged_faces(images, faces)) == [(3,)]
    assert rows(queues.of_persons(faces, [7])) == [(2,)]
    assert rows(queues.of_persons(faces, [])) == []
    assert rows(queues.needing_metadata(images), "id") == [(1,)]


def test_collections(spark, rows):
    c = spark.createDataFrame([(1, "b", None, 0), (2, "a", "#fff", 0)], DDL["collections"])
    m = spark.createDataFrame([(1, 1, 5, 0), (2, 1, 6, 0), (3, 1, 6, 0), (4, None, 6, 0)], DDL["collection_images"])
    assert [tuple(r) for r in collections.with_counts(c, m).collect()] == [(2, "a", "#fff", 0, 0), (1, "b", "#3584e4", 0, 3)]
    assert rows(collections.of_images(c, m)) == [(5, 1, "b", 3), (6, 1, "b", 3)]
    assert [tuple(r) for r in collections.picker(c, m, 5).collect()] == [(2, "a", False), (1, "b", True)]


def test_insert_ignores_known_paths_and_first_wins(spark, rows, images):
    new = spark.createDataFrame([(2, "/new.jpg", b"2", 2, None), (1, "/new.jpg", b"1", 1, "/new.raf"), (3, "/a.jpg", b"3", 3, None), (4, None, b"4", 4, None)], "seq long, path string, hash binary, file_size long, raw_path string")
    out = commands.insert_images(images, new, 99)
    assert rows(out.where("id > 4"), "id", "path", "file_size", "raw_path", "filename", "status", "added_at") == [(5, "/new.jpg", 1, "/new.raf", "new.jpg", "present", 99)]


def test_updates_carry_nulls(spark, rows, images):
    log = spark.createDataFrame([(1, 2, "x"), (2, 2, None), (1, 3, "y"), (1, None, "z")], "seq long, id long, filename string")
    assert rows(commands.update(images, log, "id"), "id", "filename") == [(1, None), (2, None), (3, "y"), (4, "d")]
    marks = spark.createDataFrame([(1, "/a.jpg", "missing"), (2, "/b.jpg", "present")], "seq long, path string, status string")
    assert rows(commands.mark(images, marks), "id", "status") == [(1, "missing"), (2, "present"), (3, "present"), (4, "present")]


def test_descriptions_last_wins_and_ids_stay(spark, rows):
    base = spark.createDataFrame([(10, 1, "m", "old", 1)], DDL["ai_descriptions"])
    log = spark.createDataFrame([(1, 1, "m", "new", 5), (2, 1, "m", "newest", 6), (1, 2, "m", "other", 7)], "seq long, image_id long, model_id string, description string, created_at long")
    assert rows(commands.upsert_descriptions(base, log)) == [(10, 1, "m", "newest", 6), (11, 2, "m", "other", 7)]


@pytest.mark.parametrize("parts", [8, 64])
def test_ids_of_a_million_rows_are_exactly_1_to_n(spark, parts):
    n = 1_000_000
    rows = spark.range(0, n, 1, parts).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("seq"), F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit("x" * 40)).alias("path"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")  # adaptive execution brings these together differently in every plan
    try:
        out = commands.with_ids(rows, spark.createDataFrame([(0,)], "id long"), ["seq", "path"]).cache()
        got = out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
        assert tuple(got) == (n, n, 1, n, 0)
        seqs = out.groupBy("seq").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).orderBy("seq").collect()
        assert all(r.high - r.low + 1 == r.n for r in seqs) and all(a.high + 1 == b.low for a, b in zip(seqs, seqs[1:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert commands.with_ids(rows.limit(0), spark.createDataFrame([(7,)], "id long"), ["seq", "path"]).count() == 0


def test_persons_and_names(spark, rows, faces):
    persons = spark.createDataFrame([(7, "Ann", 0)], DDL["persons"])
    log = spark.createDataFrame([(1, 2, "Bo"), (2, 3, None), (3, 2, "Ann"), (4, 4, "Bo")], "seq long, id long, name string")
    grown, assigned = commands.assign_names(persons, faces, log, 5)
    assert rows(grown) == [(7, "Ann", 0), (8, "Bo", 5)]
    assert rows(assigned, "id", "person_id") == [(1, None), (2, 7), (3, None), (4, 8)]


def test_collections_refuse_taken_names(spark, rows):
    c = spark.createDataFrame([(1, "a", None, 0), (2, "b", None, 0)], DDL["collections"])
    with pytest.raises(ValueError):
        commands.create_collections(c, spark.createDataFrame([(1, "a", "#1")], "seq long, name string, color string"), 0)
    with pytest.raises(ValueError):
        commands.rename_collections(c, spark.createDataFrame([(1, 1, "b")], "seq long, id long, name string"))
    made = commands.create_collections(c, spark.createDataFrame([(1, "z", "#1"), (2, "y", None)], "seq long, name string, color string"), 3)
    assert rows(made, "id", "name") == [(1, "a"), (2, "b"), (3, "z"), (4, "y")]


def test_members_and_deletes(spark, rows, images, faces):
    m = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 3, 0)], DDL["collection_images"])
    more = commands.add_members(m, spark.createDataFrame([(1, 1, 1), (2, 2, 3), (3, 2, 3)], "seq long, collection_id long, image_id long"), 9)
    assert rows(more, "id", "collection_id", "image_id") == [(1, 1, 1), (2, 1, 3), (3, 2, 3)]
    assert rows(commands.remove_members(more, spark.createDataFrame([(1, 3)], "collection_id long, image_id long")), "id") == [(1,), (3,)]
    left = commands.delete({"images": images, "face_detections": faces, "collection_images": more}, "images", spark.createDataFrame([(3,)], "id long"))
    assert [rows(left[n], "id") for n in ("images", "face_detections", "collection_images")] == [[(1,), (2,), (4,)], [(1,), (3,)], [(1,)]]
    gone = commands.delete({"persons": spark.createDataFrame([(7, "x", 0)], DDL["persons"]), "face_detections": faces}, "persons", spark.createDataFrame([(7,)], "id long"))
    assert rows(gone["face_detections"], "person_id") == [(None,)] * 4


def test_import_rows(spark, rows):
    log = spark.createDataFrame([(1, 1, "/o/a.jpg", b"1", 5, True, None), (1, 2, "/o/a.raf", b"2", 9, False, None), (2, 3, None, b"3", 5, True, "failed"), (3, 4, "/o/c.raf", b"4", 5, False, None)], "group_id long, seq long, dest string, hash binary, file_size long, is_display boolean, error string")
    assert rows(commands.import_rows(log), "path", "raw_path") == [("/o/a.jpg", "/o/a.raf")]


def test_components(spark, rows):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (100, 60), (7, 7), (None, 3), (60, 50)]
    found = rows(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Scratch(spark)))
    assert found == [(k, 1) for k in range(2, 41)] + [(60, 50), (100, 50)]
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", Scratch(spark))) == []


def test_a_hot_root_is_spread(spark, rows, monkeypatch):
    from prismarium.operators import components

    monkeypatch.setattr(components, "HOT_ROOT", 20)
    draw = random.Random(4)
    edges = [(k, 5000) for k in range(200, 400)] + [(5000, 100), (100, 7)] + [(k, 1000 + k // 10) for k in range(1500, 1700)] + [(draw.randrange(6000, 6400), draw.randrange(6000, 6400)) for _ in range(300)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Scratch(spark))))
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {n: r for n, r in label.items() if n != r}


def test_places_in_groups_of_any_size(spark, rows):
    from prismarium.operators.ranges import numbered

    draw = random.Random(2)
    data = [("big" if k % 3 else f"g{k % 7}" if k % 5 else None, draw.randrange(50), k) for k in range(600)]
    got = numbered(spark.createDataFrame(data, "g string, o long, k long").repartition(9), "g", ["o", "k"], "r", "n").collect()
    for group in {d[0] for d in data}:
        mine = sorted((o, k) for g, o, k in data if g == group)
        assert sorted((r.r, (r.o, r.k), r.n) for r in got if r.g == group) == [(i + 1, x, len(mine)) for i, x in enumerate(mine)]


def test_cosine_groups_over_blocks(spark, rows, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 8))
    v = centres[draw.integers(0, 12, 150)] + draw.normal(size=(150, 8)) * 0.15
    data = [(int(k), [float(x) for x in w]) for k, w in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = list(range(150))
    hits = np.argwhere(np.round(u @ u.T, 9) >= 0.92)
    for _ in range(150):
        for a, b in hits:
            label[a] = label[b] = min(label[a], label[b])
    true = sorted((k, label[k]) for k in range(150) if label.count(label[k]) > 1)
    for block in (20_000, 20):
        monkeypatch.setattr(tournament, "BLOCK", block)
        assert rows(tournament.cosine_groups(df, 8)) == true
    assert tournament.cosine_groups(df.limit(0), 8).count() == 0


def test_a_seen_set_grows_its_filter():
    for n in (819, 820, 854, 855):
        s = SeenSet()
        assert s.is_empty() and s.bloom.bits == 8192
        for k in range(n):
            s.insert(hashlib.sha256(str(k).encode()).digest())
        s.insert(hashlib.sha256(b"0").digest())
        assert len(s) == n + 1 and s.bloom.bits == (16384 if n + 1 > 854 else 8192)
        assert all(s.probably_contains(hashlib.sha256(str(k).encode()).digest()) for k in range(n))


def test_cancelled_work_gives_nothing(spark):
    work = Cancellable(spark)
    assert work.run(lambda: spark.range(10).count()) == 10
    assert work.run(lambda: work.cancel() and 5) is None
    with pytest.raises(ZeroDivisionError):
        work.run(lambda: 1 // 0)


def test_a_cluster_needs_a_shared_folder(spark):
    class Unset:
        @staticmethod
        def get(key, default=None):
            return default

    class Other:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = Unset

        conf = Unset

    with pytest.raises(RuntimeError):
        shared_dir(Other)


def test_seen_sets(spark, rows, tmp_path):
    import hashlib

    h = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    known = spark.createDataFrame([(x,) for x in h[:1000]], "hash binary")
    asked = spark.createDataFrame(list(enumerate([*h[500:1500], None])), "id long, hash binary")
    table, bits = seen.bloom_table(known)
    maybe = {r.id for r in seen.probably_seen(asked, table, bits).collect()}
    assert set(range(500)) <= maybe and len(maybe) < 550
    flagged = seen.flags(asked, known, known.limit(0))
    assert flagged.where("imported").count() == 500 and seen.visible(flagged).count() == 501
    data = seen.write_seen([*h[:3], h[0]])
    assert seen.read_seen(data) == [*h[:3], h[0]] and seen.read_seen(data[:-1]) == [] and seen.read_seen(b"bad") == [] and seen.read_seen(b"\x02" + data[1:]) == []
    files = spark.createDataFrame([("x", data), ("y", b"no"), ("z", None)], "path string, content binary")
    assert [r[:2] for r in rows(seen.parse_seen(files), "path", "seq")] == [("x", k) for k in range(4)]


def test_neighbours_and_rounds(spark, rows):
    f = spark.createDataFrame([("d", 1, False, False), ("d", 2, True, False), ("d", 3, False, False), ("d", 4, False, True)], "folder string, idx long, imported boolean, rejected boolean")
    assert rows(seen.neighbours_visible(f)) == [("d", 1, None, 3), ("d", 2, 1, 3), ("d", 3, 1, None), ("d", 4, 3, None)]
    e = spark.createDataFrame([(1, k, k) for k in range(1, 6)] + [(2, 9, 1)], "group_id long, id long, seed long")
    m = tournament.first_round(e)
    assert rows(m) == [(1, 0, 1, None), (1, 1, 2, 5), (1, 2, 3, 4), (2, 0, 9, None)]
    won = spark.createDataFrame([(1, 1, 5), (1, 2, 3)], "group_id long, match long, id long")
    assert rows(tournament.advance(m, won)) == [(1, 1, 0), (1, 3, 2), (1, 5, 1), (2, 9, 0)]
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.92), (4, 5, 0.91)], "a long, b long, similarity double")
    assert rows(tournament.threshold_groups(pairs)) == [(1, 1), (2, 1), (3, 1)]


def test_library_snapshots(spark, rows, images, tmp_path):
    lib = Library.open(spark, str(tmp_path / "x" / "lib"))
    assert lib.table("images").count() == 0
    assert lib.commit(images=images.drop("raw_path")) == 1
    assert lib.table("images").columns == images.columns and lib.table("images").count() == 4
    assert lib.commit(images=lib.table("images").where(F.col("id") == 1)) == 2 and lib.table("images").count() == 1
    assert set(lib.tables()) == set(DDL)
