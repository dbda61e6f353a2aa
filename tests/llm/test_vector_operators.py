import numpy as np
import pytest

from graphspark.llm import ann, descent

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [3.0, 1.0], None), (6, [2.0, 4.0], 1), (6, [2.0, 4.0], 1), (7, [float("inf"), 1.0], 1), (8, [1.0, 2.0, 3.0], 1)]


@pytest.fixture(scope="module")
def clusters(spark):
    """Loose vectors, pairs, a large group of near copies and one of exact copies."""
    rng = np.random.default_rng(4)
    x = [rng.normal(size=16) for _ in range(300)]
    x += [v + rng.normal(size=16) * 0.08 for v in x[:40]]
    center = rng.normal(size=16)
    x += [center + rng.normal(size=16) * 0.12 for _ in range(120)]
    x += [center * 2] * 60
    x = np.array(x, np.float32)[rng.permutation(len(x))]
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), x.astype(float)


def test_near_duplicates(clusters, monkeypatch):
    frame, x = clusters
    monkeypatch.setattr(descent, "BLOCK", 32)
    got = {r["vec_id"]: r for r in descent.near_duplicates(frame).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    forest = descent.Forest(len(x))
    i, j = np.nonzero(near)
    forest.link(i[i < j], j[i < j])
    assert [got[k]["n_links"] for k in range(len(x))] == near.sum(1).tolist()
    assert [got[k]["component_id"] for k in range(len(x))] == forest.label.tolist()
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in range(len(x)))


def test_near_duplicates_odd(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    rows = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicates(frame).collect())
    assert rows == [(0, 2, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 2, 0, False), (6, 2, 0, False), (7, 0, 7, True), (8, 0, 8, True), (100, 2, 0, False)]
    assert descent.near_duplicates(frame.limit(0)).count() == 0


def exact(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return order.tolist(), d[order]


def test_neighbours(spark, clusters):
    frame, x = clusters
    rows = ann.neighbours(frame, every=10).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, len(x), 10))
    hits = 0
    for q, got in by.items():
        got.sort(key=lambda r: r["rank"])
        want, _ = exact(x, q)
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(np.sqrt(((x[r["vec_id"]] - x[q]) ** 2).sum()), abs=1e-12) for r in got)
        assert sorted(got, key=lambda r: (r["score"], r["vec_id"])) == got
        hits += len(set(want) & {r["vec_id"] for r in got})
    assert hits / (10 * len(by)) >= 0.95


def test_recall_on_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    got: dict = {}
    for r in ann.neighbours(frame).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[int(ids[q])] & {int(ids[k]) for k in exact(x, q)[0]}) for q in np.flatnonzero(ids % 100 == 0)]
    assert np.mean(hits) / 10 >= 0.9


def test_neighbours_odd(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    rows = [tuple(r) for r in ann.neighbours(frame).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 100, 0.0), (0, 2, 5, pytest.approx(5**0.5)), (0, 3, 6, pytest.approx(5**0.5)), (100, 1, 0, 0.0), (100, 2, 5, pytest.approx(5**0.5)), (100, 3, 6, pytest.approx(5**0.5))]
    assert ann.neighbours(frame.limit(0)).count() == 0


def test_neighbours_hard(spark):
    """Numbers whose squares overflow or vanish, two dimensions, ties, repeats, clashing columns, joined hashes."""
    big = [(0, [1e200, 1e200]), (100, [1e200, 1.5e200]), (1, [-1e308, 1e308]), (2, [1e-200, 0.0]), (3, [3e-200, 0.0]), (200, [2e-200, 0.0]), (4, [1.0, 1.0])]
    other = [(300, [1.0, 0.0, 0.0]), (5, [1.0, 1.0, 0.0]), (6, [1.0, 0.0, 1.0]), (6, [1.0, 0.0, 1.0]), (7, [0.0, 0.0, 9.0])]
    frame = spark.createDataFrame([(i, v, 0, i, i) for i, v in big + other], "vec_id long, embedding array<double>, label int, place long, query_id long")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.neighbours(frame).collect()}
    assert got[0, 1] == (100, pytest.approx(0.5e200)) and got[0, 6][0] == 1
    assert got[200, 1] == (2, pytest.approx(1e-200, rel=1e-9, abs=0)) and got[200, 2] == (3, pytest.approx(1e-200, rel=1e-9, abs=0))
    assert [got[300, r][0] for r in (1, 2, 3)] == [5, 6, 7] and (300, 4) not in got


def test_joined_hashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * 0.3
    assert len(ann.Polytope(16, buckets=375).axes) == 2 and ann.Polytope(16, buckets=375).buckets >= 375
    p = ann.Polytope(16, buckets=375)
    assert (p.order(x[:50], 2, 7)[:, 0] == p.bucket(x[:50], 2)).all()
    assert (p.order(x[:50], 2, 7) == p.order(x[:50], 2)[:, :7]).all()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.neighbours(frame, every=30).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(exact(x, q)[0])) for q in range(0, 1500, 30)]) >= 9.5


def test_near_duplicates_hard(spark):
    """Two dimensions, clashing columns, a cosine of one, numbers whose squares overflow."""
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0, 0.0]), (4, [1.0, 1.0, 1e-3]), (5, [1.0, -1.0]), (6, [])]
    frame = spark.createDataFrame([(i, v, i, i, i) for i, v in rows], "vec_id long, embedding array<double>, id long, grp long, n_links long")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in descent.near_duplicates(frame).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6)]


def test_rotations_keep_lengths():
    p = ann.Polytope(16)
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = p.turned(x, 1)
    want = np.sqrt((x * x).sum(1)) / np.abs(x).max(1) * 16**1.5
    assert np.sqrt((y * y).sum(1)) == pytest.approx(want)
    assert (p.order(x, 1)[:, 0] == p.bucket(x, 1)).all()


def between(n, cosine, spread, seed, dim=64):
    """Two groups of n around centres at a cosine, of which few pairs are links across and no list of eight has one."""
    rng = np.random.default_rng(seed)
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    x = np.concatenate([c + rng.normal(size=(n, dim)) * spread / np.sqrt(dim) for c in (a, b)]).astype(np.float32)
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    return x, u @ u.T


def test_saturated_groups(spark):
    """Dense groups that only links beyond everyone's nearest eight join."""
    n = 200
    x, sim = between(n, 0.945, 0.1, 1)
    near = (sim >= 0.95) & ~np.eye(2 * n, dtype=bool)
    np.fill_diagonal(sim, -2)
    across = np.arange(2 * n)[:, None] // n != np.arange(2 * n)[None, :] // n
    assert (near & across).sum() > 0 and not np.take_along_axis(across, np.argsort(-sim, axis=1)[:, :8], axis=1).any()
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {r["vec_id"]: r for r in descent.near_duplicates(frame).collect()}
    assert [got[i]["n_links"] for i in range(2 * n)] == near.sum(1).tolist()
    assert {r["component_id"] for r in got.values()} == {0}


def test_bridges(spark):
    """The only guard where no leaf and no meeting holds both ends."""
    n = 200
    x, sim = between(n, 0.945, 0.1, 1)
    u = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
    units = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(u)], "id long, x binary")
    groups = spark.createDataFrame([(i, i // n * n) for i in range(2 * n)], "id long, grp long")
    assert {(r["u"] // n, r["v"] // n) for r in descent.bridges(groups, units, 0.95, 8).collect()} in ({(0, 1)}, {(1, 0)})


def test_audit_counts_vectors(spark):
    """Lost pairs show beside a large group that is whole."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.eye(64)[0] + rng.normal(size=(300, 64)) * 0.005, np.repeat(np.eye(64)[1:21], 2, axis=0)]).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    units = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, x binary")
    groups = spark.createDataFrame([(i, 0) for i in range(300)], "id long, grp long")
    lost, recall = descent.missed(units.collect(), units, groups, 0.95)
    assert recall == 0 and lost.count() == 40


def test_failed_audits_end_in_all_pairs(spark, clusters, monkeypatch):
    frame, x = clusters
    monkeypatch.setattr(descent, "AUDITS", 1)
    monkeypatch.setattr(descent, "WHOLE", 200, raising=False)
    monkeypatch.setattr(descent, "ROUNDS", 1)
    monkeypatch.setattr(descent, "grouped", lambda *a: spark.createDataFrame([], "id long, grp long"))
    got = {r["vec_id"]: r for r in descent.near_duplicates(frame).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    forest = descent.Forest(len(x))
    i, j = np.nonzero(near)
    forest.link(i[i < j], j[i < j])
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in range(len(x))] == list(zip(near.sum(1).tolist(), forest.label.tolist(), strict=True))
