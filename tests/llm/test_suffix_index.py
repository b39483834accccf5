import glob
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from costloom.llm import hashing, suffix_index


def brute(rows, width=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + width] for _, t in texts for k in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mutated(rng, t, n):
    for _ in range(n):
        k = rng.randrange(len(t))
        t = t[:k] + rng.choice("äqxz") + t[k + rng.randrange(2) :]
    return t


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_equals_brute_force(clashing, monkeypatch, hot):
    """Also where over one or three contexts of a key count as too many for a task."""
    monkeypatch.setattr(suffix_index, "TOGETHER", 7)
    monkeypatch.setattr(suffix_index, "HOT", hot)
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choice("abcdefgh  é") for _ in range(n))
    base = prose(1500)
    rows = [(i, mutated(rng, base, rng.randrange(6))) for i in range(25)]
    rows += [(100 + i, prose(rng.randrange(300)) + base[200 : 200 + rng.choice([398, 399, 400, 401, 700])] + prose(rng.randrange(300))) for i in range(15)]
    rows += [(200, base), (201, base), (202, None), (203, ""), (204, "a" * 399), (205, "a" * 400), (206, "b" * 401), (207, "ab" * 700), (208, prose(40) * 40)]
    rows += [(None, None), (None, ""), (None, ""), (300, prose(100) + "é" * 3000)]
    rows += [(200, base), (200, prose(900)), (None, base[:900]), (None, base[100:800]), (209, "x" * 2000 + base[:500])]
    got = suffix_index.drop_repeated_bytes(clashing(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_equals_brute_force_on_a_table(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect() if len(r.text) < 6000]
    got = suffix_index.drop_repeated_bytes(sample.filter(F.length("text") < 6000)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_levels(docs, spark):
    """Every batch is scanned against all before it; levels of equal rank merge; any number of batches gives the same."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdef ") for _ in range(900))
    df = docs([(i, mutated(rng, base, 1)) for i in range(14)])
    texts = suffix_index.keyed(df, "doc_id", "text").withColumn("k", F.col("id") % 7)
    index, ranks, found = suffix_index.SuffixIndex(spark), [], []
    for k in range(7):
        found += index.add(suffix_index.runs(texts.filter(F.col("k") == k).drop("k"))).select("head", "gram").collect()
        ranks.append([rank for rank, _, _ in index.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]
    rows = [r for _, name, _ in index.levels for r in spark.table(name).collect()]
    runs = suffix_index.runs(texts.drop("k")).collect()
    assert sum(r.n for r in rows) == len(runs)
    times = Counter((bytes(r["head"]), r.gram) for r in runs)
    assert {(bytes(r["head"]), r.gram) for r in found} == {k for k, n in times.items() if n > 1}
    for _, name, path in index.levels:  # each bucket's file is in the order of the suffixes
        for file in glob.glob(path.removeprefix("file:") + "/*.parquet"):
            heads = pq.read_table(file, columns=["head"]).column("head").to_pylist()
            assert heads == sorted(heads)
    index.close()
    results = [sorted(map(tuple, suffix_index.drop_repeated_bytes(df, batches=n).collect()), key=repr) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2] == brute([(r.doc_id, r.text) for r in df.collect()])


def test_batches_follow_the_bytes():
    assert [suffix_index.batches_for(n << 20) for n in (0, 600, 1280, 1 << 20)] == [4, 4, 10, 32]


def test_levels_meet_without_a_shuffle(spark, docs):
    df = suffix_index.keyed(docs([(i, "abcdefg " * 60 + f"{i}" * 400) for i in range(6)]), "doc_id", "text")
    index = suffix_index.SuffixIndex(spark)
    index.add(suffix_index.runs(df.filter("id < 3")))
    other = index._stored(5, spark.table(index.levels[0][1]))
    x, y = spark.table(index.levels[0][1]), spark.table(other[1])
    plan = index.merged(x, y)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_segments(monkeypatch):
    texts = [random.Random(k).randbytes(n) for k, n in ((1, 5000), (2, 400), (3, 0), (4, 399), (5, 1300))]
    covered = lambda: sorted((i, p) for o, _, _, _, lo, _, hi in suffix_index.runs_of(texts, 400, 64) for i, a, b in zip(o, lo, hi) for p in range(a, b + 1))
    one = covered()
    monkeypatch.setattr(suffix_index, "SEGMENT", 700)
    assert covered() == one == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 399)]


def test_sliding_argmin():
    v = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64) << np.uint64(40)
    assert hashing.sliding_argmin(v, 3).tolist() == [1, 1, 4, 4, 4]


def test_empty(docs):
    assert suffix_index.drop_repeated_bytes(docs([])).collect() == []


def test_near_variants_under_one_id_and_under_none(docs):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh  é") for _ in range(3000))
    edited = lambda shift: "".join(c if (k + shift) % 300 else "#" for k, c in enumerate(base))
    one, other = edited(0), edited(150)
    for rows in ([(None, one), (None, other)], [(7, one), (7, other)], [(7, one), (7, other), (8, base), (8, base), (None, base[:1400]), (None, one[500:])]):
        got = suffix_index.drop_repeated_bytes(docs(rows)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_intervals_that_touch_become_one(spark):
    rows = [(1, 5, 3, 3), (1, 5, 4, 9), (1, 5, 12, 12), (1, 5, 5, 6), (1, 6, 0, 0), (2, 5, 1, 2), (2, 5, 1, 2), (2, 5, 3, 3)]
    df = spark.createDataFrame(rows, "gram long, ctx long, lo int, hi int")
    got = {(r.gram, r.ctx): [tuple(s) for s in r.spans] for r in suffix_index.merged_intervals(df).collect()}
    assert got == {(1, 5): [(3, 9), (12, 12)], (1, 6): [(0, 0)], (2, 5): [(1, 3)]}
