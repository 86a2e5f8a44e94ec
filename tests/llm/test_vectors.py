import numpy as np
import pyarrow as pa
import pytest

from prismarium.llm import linking
from prismarium.llm import vectors as V
from prismarium.llm.clusters import clusters, describe
from prismarium.llm.features import FeatureTree, agglomerate, leaves
from prismarium.llm.neighbours import copies, meetings, nearest, neighbours, offers, scan, scan_near, spots
from prismarium.operators.components import union_labels
from prismarium.operators.grouped import by_group

DIM = 16
KIND = "id long, embedding array<float>, other string"


def points(people=60, most=12, seed=0, noise=0.09):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(people):
        centre = V.unit(draw.normal(size=(1, DIM)))[0]
        for _ in range(draw.integers(1, most)):
            rows.append(np.float16(centre + draw.normal(size=DIM) * noise).astype(np.float32) * draw.choice([1, 4, 0.25]))
    return [(int(i) + 1, [float(x) for x in v], "x") for i, v in zip(draw.permutation(len(rows)), rows)]


def brute(rows, k, least):
    """The k nearest of each row at or above ``least``, the smaller id first."""
    rows = sorted(r for r in rows if r[1] is not None and len(r[1]) == DIM and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]))
    ids = [r[0] for r in rows]
    u = V.unit(np.array([r[1] for r in rows], np.float32), np.float64)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        best = sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in best if s[i, j] >= least}
    return out


@pytest.fixture(scope="module")
def odd():
    """Rows that are no vectors, and copies of others."""
    bad = [None, [], [1.0] * (DIM - 1), [0.0] * DIM, [float("nan")] + [1.0] * (DIM - 1), [float("inf")] * DIM, [None] + [1.0] * (DIM - 1)]
    return [(9000 + k, v, None) for k, v in enumerate(bad)]


def test_packing():
    draw = np.random.default_rng(1)
    half = np.float16(draw.normal(size=(7, DIM))).astype(np.float32)
    for values in (half, half * np.float32(1 / 3), np.concatenate([half, half * np.float32(1 / 3)]), half * np.float32(1e30)):
        assert (V.unpack_exact(V.pack_exact(values), DIM) == values).all()
    u = V.unit(draw.normal(size=(500, DIM)).astype(np.float32))
    small = V.unpack_small(V.pack_small(u), DIM)
    assert np.abs(small @ small.T - u @ u.T).max() < 0.01
    assert np.isfinite(V.unit(np.full((1, DIM), 3e38, np.float32))).all()


@pytest.mark.parametrize("cell", [60, 10_000])
def test_neighbours_against_brute_force(spark, odd, cell, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", cell)
    rows = points() + odd
    rows += [(5000 + k, rows[3][1], "copy") for k in range(8)]  # more copies than neighbours, so ids decide
    found = {(r.a, r.b) for r in neighbours(spark.createDataFrame(rows, KIND), 5, 0.8, DIM).collect()}
    true = brute(rows, 5, 0.8)
    assert len(found & true) >= 0.98 * len(true) and len(found - true) <= 0.02 * len(true)


def test_offers(spark, rows):
    faces = spark.createDataFrame([(1, None), (2, 7), (3, 7), (4, 8), (5, None)], "id long, person_id long")
    near = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.95), (1, 4, 0.8), (1, 5, 0.9), (2, 3, 0.9)], "a long, b long, similarity double")
    assert rows(offers(faces, near)) == [(1, 7, 2, 0.95), (1, 8, 1, 0.8)]


def test_nearest_gives_k_to_rows_without_close_ones(spark, odd):
    rows = points(60, 5, noise=0.2) + odd
    df = spark.createDataFrame(rows, KIND)
    true = brute(rows, 5, -2)
    found = {(r.a, r.b) for r in nearest(df, 5, DIM).collect()}
    assert found == true and len(brute(rows, 5, 0.8)) < 0.8 * len(true)
    some = {(r.a, r.b) for r in nearest(df, 5, DIM, asked=df.where("id < 20")).collect()}
    assert some == {x for x in true if x[0] < 20}
    assert nearest(spark.createDataFrame([], KIND), 5, DIM).count() == 0


def test_neighbours_of_nothing(spark, odd):
    assert neighbours(spark.createDataFrame([], KIND), 5, 0.8, DIM).count() == 0
    assert neighbours(spark.createDataFrame(odd, KIND), 5, 0.8, DIM).count() == 0
    assert neighbours(spark.createDataFrame(points(1, 2), KIND), 5, 0.8, DIM).count() == 0


@pytest.mark.parametrize("block", [200, 100_000])
def test_a_dense_group_is_searched_by_blocks(spark, block, monkeypatch):
    from prismarium.llm import neighbours as N

    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    draw = np.random.default_rng(2)
    centre = V.unit(draw.normal(size=(1, DIM)))[0]
    rows = [(k, [float(x) for x in np.float32(centre + draw.normal(size=DIM) * 0.05)], "") for k in range(900)]
    rows += [(2000 + k, rows[0][1], "") for k in range(300)] + [(3000 + k, rows[1][1], "") for k in range(2)]
    got = [(r.a, r.b) for r in neighbours(spark.createDataFrame(rows, KIND).repartition(3), 5, 0.8, DIM).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 0.8)
    assert {b for a, b in got if a == 2100} == {0, 2000, 2001, 2002, 2003}


@pytest.mark.parametrize("block", [8_000, 100_000])
def test_a_large_group_keeps_its_recall(spark, block, monkeypatch):
    from prismarium.llm import neighbours as N

    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    draw = np.random.default_rng(11)  # a third of all rows in one identity, too wide for the cells of a few trees
    n, centre = 60_000, V.unit(draw.normal(size=(1, 96)))[0]
    one = np.float16(centre + draw.normal(size=(n // 3, 96)) * 0.035).astype(np.float32)
    values = np.concatenate([one, np.float16(draw.normal(size=(n - n // 3, 96))).astype(np.float32)])
    df = spark.createDataFrame(pa.table({"id": np.arange(n), "embedding": pa.array(list(values))})).repartition(8)
    found = neighbours(df, 5, 0.8).toArrow()
    got = set(zip(found["a"].to_pylist(), found["b"].to_pylist()))
    u, ask = V.unit(one, np.float64), draw.choice(n // 3, 400, replace=False)
    s = u[ask] @ u.T
    s[np.arange(400), ask] = -2
    true = {(int(a), int(b)) for a, r, top in zip(ask, s, np.argsort(-s, axis=1)[:, :5]) for b in top if r[b] >= 0.8}
    assert len(true) > 1000 and len(got & true) >= 0.999 * len(true)


def test_late_copies_of_a_batch():
    values = np.array([[1.0, 0], [0, 1], [1, 0], [1, 0], [1, 0]], np.float32)
    late, head = copies(np.array([9, 1, 3, 7, 5]), values, 2)
    assert late.tolist() == [0] and head.tolist() == [3]
    late, head = copies(np.array([9, 1, 3, 7, 5]), values, 0)
    assert sorted(late.tolist()) == [0, 3, 4] and set(head.tolist()) == {3} and not len(copies(np.arange(5), values, 3)[0])


def test_squares_of_a_dense_prefix_bring_every_pair_together():
    ids = np.arange(500)
    blocks = np.array([1, 3, 1])
    code = np.where(ids < 400, 1, 2)
    row, cell, role = spots(code, 0, blocks, ids, 3)
    met = set()
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        met |= {(int(a), int(b)) for a in row[at][(role[at] & 1) > 0] for b in row[at][(role[at] & 2) > 0]}
    assert met == {(a, b) for a in range(500) for b in range(500) if (a < 400) == (b < 400)}
    asks, _, only = spots(code, 0, blocks, ids, 1)
    assert len(asks) == 400 * 3 + 100 and set(only.tolist()) == {1}


def test_scan_is_exact_over_blocks():
    draw = np.random.default_rng(12)
    values = np.float32(draw.normal(size=(9000, DIM)))
    values[100:140] = values[7]  # ties
    ids = draw.permutation(9000)
    a, b, s = scan(ids[:600], values[:600], ids, values, 5, -1)
    u = V.unit(values, np.float64)
    order = np.argsort(ids)
    for i in (0, 7, 100, 333, 599):
        v = u[order] @ u[i]
        v[ids[i]] = -2
        assert b[a == ids[i]].tolist() == np.lexsort((np.arange(9000), -np.rint(v * 1e9)))[:5].tolist()
    assert len(a) == 3000 and not len(scan(ids[:5], values[:5], ids[:5], values[:5], 5, 1.1)[0])


def test_many_rows_below_a_prefix_meet_few():
    draw = np.random.default_rng(31)
    centres = V.unit(draw.normal(size=(900, 96)))
    values = np.float16(centres[draw.integers(0, 900, 9000)] + draw.normal(size=(9000, 96)) * 0.05).astype(np.float32)
    values[5:40] = values[3]  # more copies than neighbours
    ids, units = draw.permutation(9000), V.unit(values)
    met = sum(len(who) * len(others) for who, others in meetings(units, units, ids, 0.14))
    assert met < 0.2 * 9000 * 9000  # before, every row met every other
    true = set(zip(*(x.tolist() for x in scan(ids, values, ids, values, 5, 0.8)[:2])))
    a, b, s = scan_near(ids, values, ids, values, 5, 0.8)
    got = set(zip(a.tolist(), b.tolist()))
    assert len(true) > 5000 and len(got) == len(a) and len(got & true) >= 0.995 * len(true) and np.bincount(a).max() <= 5
    again = draw.permutation(9000)  # neither centres nor results depend on the order of the rows
    assert set(zip(*(x.tolist() for x in scan_near(ids[again], values[again], ids, values, 5, 0.8)[:2]))) == got
    few = np.arange(100)
    assert [(len(x), len(y)) for x, y in meetings(units[few], units[few], few, 0.12)] == [(100, 100)]
    assert [len(x) for x in scan_near(ids[:9], values[:9], ids, -values, 5, 0.99)] == [0, 0, 0]


def test_visits_do_not_grow_with_the_table():
    draw = np.random.default_rng(32)
    units = V.unit(draw.normal(size=(6000, 96)).astype(np.float32))
    few, many = (V.Forest.fit(units, rows, 1).trees[0] for rows in (32_000, 320_000))
    assert len(few.centres) == V.FEW_CENTRES and len(many.centres) < 2 * len(few.centres)  # before, 80 and 200 of this sample
    assert len(V.Forest.fit(units, 10**9, 1).trees[0].centres) == len(units) // V.SAMPLED_PER_CENTRE


def test_copies_are_linked_without_comparing(spark):
    rows = points(20, 6) + [(7000 + k, points(1, 2, seed=9)[0][1], "") for k in range(400)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = clusters(df, 0.75, 5, DIM).where("member >= 7000").groupBy("cluster_id").count().collect()
    assert [r["count"] for r in got] == [400]


def test_copies_keep_their_group(spark):
    rows = points(6, 14, seed=5)
    rows += [(8000 + k, rows[k][1], "") for k in range(len(rows))]
    got = {r.member: r.cluster_id for r in clusters(spark.createDataFrame(rows, KIND).coalesce(1), 0.75, 5, DIM).collect()}
    assert all(got[8000 + k] == got[rows[k][0]] for k in range(len(rows) // 2) if rows[k][0] in got) and len(got) > 50


def test_a_hot_centre_keeps_its_group_together(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT_ROWS", 300)
    draw = np.random.default_rng(21)  # a third of all rows in one identity, which the trees of features hold in one leaf
    n, centre = 4500, V.unit(draw.normal(size=(1, 96)))[0]
    one = centre + draw.normal(size=(n // 3, 96)) * 0.035
    values = np.float16(np.concatenate([one, draw.normal(size=(n - n // 3, 96))])).astype(np.float32)
    df = spark.createDataFrame(pa.table({"id": np.arange(n), "embedding": pa.array(list(values))})).repartition(4)
    assert [tuple(r) for r in clusters(df).groupBy("cluster_id").count().collect()] == [(0, n // 3)]


def test_strings_are_stable_and_hot_prefixes_deepen(spark, monkeypatch):
    draw = np.random.default_rng(3)
    units = V.unit(draw.normal(size=(3000, DIM)).astype(np.float32))
    df = spark.createDataFrame([(k, v.tolist(), "") for k, v in enumerate(units)], KIND)
    monkeypatch.setattr(V, "CELL_ROWS", 600)
    plain = V.Forest.fit(units, 3000, 2).counted(df, DIM)
    monkeypatch.setattr(V, "HOT_ROWS", 200)
    deep = V.Forest.fit(units, 3000, 2).counted(df, DIM)
    assert not V.Forest.fit(units[:0], 0, 3).trees and len(V.Forest.fit(units, 3000, 3).trees[0].centres) == 5
    for forest in (plain, deep):
        assert [t.sizes.sum() for t in forest.trees] == [3000, 3000]
        a, b = forest.visits(units, 0.0, 1), forest.visits(units[::-1], 0.0, 1)
        assert all((x[0][1] == y[0][1][::-1]).all() for x, y in zip(a, b)) and all(len(x[0][0]) == 3000 for x in a)
        assert sum(len(r) for r, _ in a[0][1:]) <= 3000 * (len(forest.trees[0].hot) if forest is deep else 1)
    most = [max(np.unique(f.visits(units, 0.0, 1)[0][0][1], return_counts=True)[1]) for f in (plain, deep)]
    assert most[0] == plain.trees[0].sizes.max() and most[1] <= 200 < most[0] and len(deep.trees[0].hot[0])
    everything = plain.visits(units, 0.0, 6000)  # an ascent in both trees at once goes on until both hold all rows
    assert all(sum(len(rows) for rows, _ in steps) == 5 * 3000 for steps in everything)


def test_centres_of_one_dense_group_form_one_cell():
    draw = np.random.default_rng(4)
    centre = V.unit(draw.normal(size=(1, DIM)))
    dense = V.unit((centre + draw.normal(size=(6, DIM)) * 0.03).astype(np.float32))
    tree = V.Forest([np.concatenate([dense, V.unit(draw.normal(size=(4, DIM)).astype(np.float32))])]).trees[0]
    assert tree.dense.sum() == 1 and len(tree.dense) == 5 and tree.strings(dense, 1)[0].ravel().tolist() == [int(np.flatnonzero(tree.dense)[0])] * 6


def test_groups_arrive_whole():
    import pyarrow as pa

    keys = np.repeat(np.arange(40), 13)
    got = []

    def handle(bounds, rows):
        k = rows.column(0).to_numpy()
        got.extend((int(k[s]), e - s) for s, e in zip(bounds, bounds[1:]))
        yield rows

    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 17])], ["k"]) for i in range(0, len(keys), 17)]
    out = list(by_group(0, handle, least=50)(iter(batches)))
    assert got == [(k, 13) for k in range(40)] and sum(b.num_rows for b in out) == len(keys)
    assert list(by_group(0, handle)(iter([]))) == []


@pytest.mark.parametrize("cell", [90, 10_000])
def test_clusters_against_brute_force(spark, odd, cell, monkeypatch):
    monkeypatch.setattr(linking, "CENTRE_ROWS", cell)
    rows = points(80, 14, seed=4, noise=0.12) + odd + [(8000, points(80, 14, seed=4, noise=0.12)[0][1], "copy")]
    got = {(r.cluster_id, r.member) for r in clusters(spark.createDataFrame(rows, KIND), 0.75, 5, DIM).collect()}
    good = sorted(r for r in rows if r[0] < 9000)
    u = V.unit(np.array([r[1] for r in good], np.float32), np.float64)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.75, 1))
    label = union_labels(len(good), i, j)
    size = np.bincount(label, minlength=len(good))
    true = {(good[label[k]][0], good[k][0]) for k in range(len(good)) if size[label[k]] >= 5}
    assert len(got & true) >= 0.98 * len(true) and len(got - true) <= 0.02 * len(true)
    assert clusters(spark.createDataFrame([], KIND), 0.75, 5, DIM).count() == 0


def test_typical_members(spark):
    rows = points(6, 14, seed=5)
    df = spark.createDataFrame(rows, KIND)
    members = clusters(df, 0.75, 5, DIM).cache()
    got = {(r.cluster_id, r["rank"]): (r.member, r.size) for r in describe(df, members, 3, DIM).collect()}
    by: dict[int, list[int]] = {}
    for r in members.collect():
        by.setdefault(r.cluster_id, []).append(r.member)
    at = {r[0]: V.unit(np.array([r[1]], np.float32), np.float64)[0] for r in rows}
    for c, ids in by.items():
        mean = sum(at[i] for i in ids)
        mean /= np.linalg.norm(mean)
        best = sorted(ids, key=lambda i: (-round(float(at[i] @ mean), 9), i))[:3]
        assert [got[c, k + 1] for k in range(3)] == [(b, len(ids)) for b in best]


def test_ward_joins_the_nearest_first():
    a = np.array([[1.0, 0], [0.99, 0.1], [0, 1.0], [0.1, 0.9], [-1, 0]])
    assert agglomerate(a, np.ones(5), 3).tolist() == [0, 0, 2, 2, 4] and agglomerate(a, np.ones(5), 9).tolist() == [0, 1, 2, 3, 4]
    assert agglomerate(a * 50, np.full(5, 50.0), 3).tolist() == [0, 0, 2, 2, 4] and agglomerate(np.ones((5, 2)), np.ones(5), 1).tolist() == [0] * 5
    assert agglomerate(np.zeros((0, 2)), np.zeros(0), 3).tolist() == []


def test_feature_trees_are_bounded_and_merge(spark):
    draw = np.random.default_rng(6)
    centres = V.unit(draw.normal(size=(40, DIM)))
    units = V.unit(centres[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, DIM)) * 0.02)
    whole, parts = FeatureTree(DIM, 100), [FeatureTree(DIM, 100) for _ in range(2)]
    whole.add(units, np.ones(4000))
    for k, tree in enumerate(parts):
        tree.add(units[k::2], np.ones(2000))
    parts[0].add(parts[1].total, parts[1].n)
    for tree in (whole, parts[0]):
        assert len(tree.n) <= 100 and tree.n.sum() == 4000 and np.allclose(tree.total.sum(0), units.sum(0))
        assert np.allclose(np.array([tree.total[tree.node == k].sum(0) for k in range(len(tree.inner))]), tree.inner)
        assert (centres @ V.unit(tree.total).T).max(1).min() > 0.9
    df = spark.createDataFrame([(k, v.tolist(), "") for k, v in enumerate(units)], KIND).repartition(20)
    total, n = leaves(df, DIM, 60)
    assert len(n) <= 60 and n.sum() == 4000 and np.allclose(total.sum(0), units.sum(0), atol=1e-2)
    assert not len(leaves(spark.createDataFrame([], KIND), DIM)[1])


def test_linking_of_dense_and_sparse_cells():
    draw = np.random.default_rng(8)
    for noise, n in ((0.02, 900), (0.3, 700), (1.0, 400)):
        centres = V.unit(draw.normal(size=(5, DIM)))
        units = V.unit((centres[draw.integers(0, 5, n)] + draw.normal(size=(n, DIM)) * noise).astype(np.float32))
        i, j = np.nonzero(np.triu(units @ units.T >= 0.8, 1))
        assert V.linked_labels(units, 0.8).tolist() == union_labels(n, i, j).tolist()
        own = np.flatnonzero(i < n // 3)
        assert V.linked_labels(units, 0.8, n // 3).tolist() == union_labels(n, i[own], j[own]).tolist()
    assert V.linked_labels(np.zeros((0, DIM), np.float32), 0.8).tolist() == []


def test_ties_go_to_the_smaller_id():
    draw = np.random.default_rng(9)
    units = V.unit(draw.integers(-1, 2, (60, 3)).astype(np.float64) + 1e-12, np.float64)
    ids = draw.permutation(60)
    rows = [(int(i), v.tolist() + [0.0] * (DIM - 3), "") for i, v in zip(ids, units)]
    values = np.array([r[1] for r in rows], np.float32)
    a, b, _ = scan(ids, values, ids, values, 5, 0.5)
    assert set(zip(a.tolist(), b.tolist())) == brute([r for r in rows if any(r[1])], 5, 0.5)


def test_usable_faces(spark, rows):
    f = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.9), (2, 0.1, 0.0, 0.0, 0.0, 0.0), (3, 0.1, 0.1, 0.1, 0.1, -1.0), (4, 0.1, None, None, None, None), (5, None, 0.2, None, None, 0.5), (None, 0.1, 0.1, 0.1, 0.1, 0.9)], "id long, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, confidence double")
    assert rows(f.where(V.usable_face()), "id") == [(2,), (5,)]
