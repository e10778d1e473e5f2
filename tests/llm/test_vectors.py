"""Near-duplicate vectors against all pairs, and on awkward tables."""

import numpy as np
import pytest

from plumbline.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, threshold=0.9):
    """Rows as the operator gives them, from all pairs of distinct (id, vector)."""
    good = lambda i, v: i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    single = lambda v: tuple(np.array(v, np.float32).tolist())
    nodes = sorted({(i, single(v)) for i, v in rows if good(i, v)})
    up, degree = list(range(len(nodes))), [0] * len(nodes)

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for dim in {len(v) for _, v in nodes}:
        mine = [k for k, (_, v) in enumerate(nodes) if len(v) == dim]
        x = np.array([nodes[k][1] for k in mine], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            a, b = mine[a], mine[b]
            degree[a] += 1
            degree[b] += 1
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    at = {n: k for k, n in enumerate(nodes)}
    out = []
    for i, v in rows:
        k = at.get((i, single(v))) if good(i, v) else None
        least = i if k is None else nodes[root(k)][0]
        out.append((i, 0 if k is None else degree[k], least, i == least))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def cloud(seed, centres, dim):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(centres):
        c = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 9))):
            v = c + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3, 0.36])
            rows.append((len(rows), (v * rng.choice([1, 10, 1e-3])).astype(np.float32).tolist()))
    return rows


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("x", "h", "g", "w", "node", "rep", "key", "tab", "home", "mine", "least", "c")})


AWKWARD = [
    (1000, None), (1001, []), (1002, [0.0] * 64), (1003, [None] * 64), (1004, [float("nan")] + [1.0] * 63), (1005, [float("inf")] + [1.0] * 63),
    (None, [1.0] * 64), (None, None), (1006, [1.0] * 64), (1007, [2.0] * 64), (1008, [1.0] * 64), (1008, [1.0] * 64), (1009, [1.0] * 63), (1009, [1.0] * 64),
    (1010, [3.0]), (1011, [5.0]), (1012, [-1.0]), (1013, [1e38] * 64), (1014, [1e-38] * 64), (-5, [-1.0] * 64), (1015, [1.0, 0.0]), (1016, [0.95, 0.1]),
]


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = cloud(1, 120, 64) + AWKWARD
    assert got(vectors.near_duplicates(frame(spark, rows))) == by_hand(rows)


def test_other_shapes_and_functions(spark):
    rows = cloud(2, 40, 20)
    for functions in (1, 3):
        assert got(vectors.near_duplicates(frame(spark, rows), functions=functions)) == by_hand(rows)
    assert got(vectors.near_duplicates(frame(spark, rows), threshold=0.97)) == by_hand(rows, 0.97)


def test_recall_at_the_threshold():
    """Pairs at a cosine of just 0.9 meet as often as the number of tables promises."""
    rng = np.random.default_rng(5)
    for dim in (16, 64, 300):
        x, z = rng.normal(size=(2, 3_000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
        t = vectors.Tables(dim, vectors.tables_for(dim, 2, 4, 0.9, 1e-4), 2, 4)
        assert vectors.meeting(t.keys(x), t.keys(y)).any(1).mean() > 0.998


def test_each_pair_is_owned_by_one_bucket():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 64))
    y = x + 0.3 * rng.normal(size=x.shape)
    t = vectors.Tables(64, 6, 2, 4)
    a, b = t.keys(x), t.keys(y)
    for k in range(len(x)):
        p, q = a[k : k + 1], b[k : k + 1]
        places = {(i, key) for i in range(6) for key in {*p[0, i].tolist(), *q[0, i].tolist()} if (key == p[0, i, 0] and key in q[0, i]) or (key == q[0, i, 0] and key in p[0, i])}
        assert sum(bool(vectors.owned(p, q, i, key)[0]) for i, key in places) == bool(places)


def test_transform_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)) / 32, x)


def test_query_filter_and_empty_table(spark):
    from plumbline.llm import queries

    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(queries.op12_embedding_near_dedup(spark, "/root/testdata/sf0.01")) == by_hand(rows)
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    some = cloud(3, 20, 16)
    kept = vectors.one_of_each(frame(spark, some + [(None, [1.0] * 16)] * 2))
    assert sorted(repr(r[0]) for r in kept.collect()) == sorted([eval(r)[0].__repr__() for r in by_hand(some) if eval(r)[3]] + ["None"] * 2)
