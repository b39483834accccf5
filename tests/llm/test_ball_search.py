import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from costloom.llm import ball_search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("row", T.LongType()), T.StructField("shard", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 9) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, **kw):
    return sorted(map(tuple, ball_search.top_products(frame(spark, rows), F.col("id") % 50 == 0, **kw).collect()))


@pytest.mark.parametrize("shards", [1, 7])
def test_clusters_and_norms(spark, monkeypatch, shards):
    monkeypatch.setattr(ball_search, "LEAF", 16)
    monkeypatch.setattr(ball_search, "SEED", 40)
    monkeypatch.setattr(ball_search, "BLOCK", 11)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 12))
    rows = [(i, ((centres[i % 9] + rng.normal(size=12) * 0.2) * rng.lognormal()).tolist()) for i in range(1500)]
    assert found(spark, rows, shards=shards) == brute(rows)


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ball_search, "LEAF", 8)
    monkeypatch.setattr(ball_search, "SEED", 16)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i % 3), 1.0, 0.0]) for i in range(100)]
    assert found(spark, rows, shards=5) == brute(rows)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (50, [1.0, 1.0, 0.25]), (7, []), (100, []), (None, [9.0, 9.0])]
    rows += [(150, [1e30, -1e30]), (8, [1e30, 1e30]), (9, [1e30, 1.5]), (10, [1e-300, 3.3])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(3, [1.0])]) == []


def test_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [1.0, 2.0])]
    assert found(spark, rows) == [(50, 1, 1, 131072), (50, 1, 1, 131072), (50, 2, 1, 65536), (50, 2, 1, 65536)]


def test_bounds_close_nodes():
    """On clustered vectors most leaves are never scored."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 8)) * 1000
    x = np.floor(centres[np.arange(64).repeat(256)] + rng.normal(size=(64 * 256, 8)) * 5)
    tree = ball_search.BallTree(x, np.arange(len(x)))
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key.start)
            return super().__getitem__(key)

    tree.x = tree.x.view(Watched)
    q = x[::4096]
    number, ids, score = tree.search(q, np.arange(0, len(x), 4096), np.full(len(q), -(2**63)), 5)
    want = sorted(zip(-(x @ q[0]), range(len(x))))
    assert [(-s, i) for s, i in zip(score[:5], ids[:5])] == [w for w in want if w[1] != 0][:5]
    assert len(set(seen)) <= len(tree.bounds) // 4
