import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from costloom.llm import components, ngram_join


def sets(rows, width=3):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute(rows, share=90):
    """(id, size, component); rows of one id are one node."""
    s, parent = sets(rows), {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for p, (i, _) in enumerate(rows):
        for q in range(p):
            j, n = rows[q][0], len(s[p] & s[q])
            if None not in (i, j) and n and 100 * n >= share * len(s[p] | s[q]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s[p]), None if i is None else root(i)) for p, (i, _) in enumerate(rows)), key=repr)


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_equals_brute_force(clashing, monkeypatch, most):
    """Also where every open list counts as crowded."""
    monkeypatch.setattr(ngram_join, "MOST_PAIRS", most)
    rng = random.Random(6)
    rows = []
    for family in range(12):
        base = [f"f{family}x{rng.randrange(400)}" for _ in range(rng.choice([4, 11, 40, 160]))]
        for _ in range(rng.choice([1, 3, 15])):
            rows.append((len(rows) * 3 - 50, " ".join(edit(rng, base, rng.randrange(5)))))
    line = " ".join(f"common{i}" for i in range(12))
    rows += [(1000 + i, line + " " + " ".join(f"u{i}v{k}" for k in range(i % 5))) for i in range(30)]
    rows += [(2000, "A b"), (2001, "a B"), (2002, "a"), (2003, ""), (2004, None), (2005, ""), (2006, "Ä b"), (2007, "ä b"), (None, "a b"), (2000, "A b")]
    rows += [(3000, "z " * 20_000), (3001, "z " * 30_000)]
    got = sorted(map(tuple, ngram_join.near_copies(clashing(rows)).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_chains_and_hubs_are_exact(docs, monkeypatch, most):
    """Near copies of near copies: ends of a chain don't link, but are in one component."""
    monkeypatch.setattr(ngram_join, "MOST_PAIRS", most)
    rng = random.Random(8)
    rows, words = [], [f"a{i}" for i in range(100)]
    for i in range(25):
        rows.append((i, " ".join(words)))
        words[rng.randrange(100)] = f"b{i}"
    rare = "one rare line that many texts share".split()  # and little else: a crowded list
    rows += [(500 + i, " ".join([*rare, *(f"r{i}s{k}" for k in range(25))])) for i in range(20)]
    rows += [(600 + i, " ".join([*rare, *(f"t{i // 2}s{k}" for k in range(25)), *["end"] * (i % 2)])) for i in range(12)]
    hub = [f"c{i}" for i in range(60)]
    rows += [(100 + i, " ".join(edit(rng, hub, rng.choice([0, 1, 1, 2])))) for i in range(40)]
    rng.shuffle(rows)
    assert sorted(map(tuple, ngram_join.near_copies(docs(rows)).collect()), key=repr) == brute(rows)


def test_texts_of_one_template_write_few_pairs(docs, monkeypatch):
    """Below the share, in one another's lists: short maps rule them out inside the join."""
    rng, written_pairs, across = random.Random(3), [], ngram_join.across
    monkeypatch.setattr(ngram_join, "across", lambda *a: written_pairs.append(across(*a)) or written_pairs[-1])
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(edit(rng, base, rng.randrange(6, 14)))) for i in range(600)]
    assert sorted(map(tuple, ngram_join.near_copies(docs(rows)).collect()), key=repr) == brute(rows)
    assert written_pairs and sum(p.count() for p in written_pairs) < 300


def test_equals_brute_force_on_a_table(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted(map(tuple, ngram_join.near_copies(sample).collect()), key=repr) == brute(rows)


def test_five_words_and_080(docs):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(["x", *base[1:50], "y", *base[51:]])), (3, " ".join(base[::-1]))]
    got = {r.doc_id: r.component_id for r in ngram_join.near_copies(docs(rows), width=5, share=(80, 100)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert [r.doc_id for r in ngram_join.drop_near_copies(docs(rows), width=5, share=(80, 100)).orderBy("doc_id").collect()] == [1, 3]


def test_empty(docs):
    assert ngram_join.near_copies(docs([])).collect() == []
    assert ngram_join.drop_near_copies(docs([])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    n = 300
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, n), rng.randrange(200, n)) for _ in range(60)]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}


def test_sets_equal_words(docs):
    rows = [(1, "a b c a b c"), (2, "x"), (3, " \t"), (4, "A B c d")]
    got = [len(s) for s in ngram_join.shingle_sets([t.encode() for _, t in rows], 3)]
    assert got == [len(s) for s in sets(rows)]
    assert all((np.diff(s.astype(object)) > 0).all() for s in ngram_join.shingle_sets([b"a b c a b c"], 3))


def test_slices_follow_the_texts_not_what_they_pack_to():
    z = zstandard.ZstdCompressor()
    texts = [b"the same line\n" * k for k in (1, 5000, 5000, 1, 60_000, 2, 2)]
    packed = pa.array([z.compress(t) for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), packed, packed], ["a", "x", "y"])
    got = [b.column(0).to_pylist() for b in ngram_join.unpacked_slices([batch, batch.slice(0, 0)], (1, 2), 200_000)]
    assert got == [[0, 1], [2, 3], [4], [5, 6]]


def test_texts_that_pack_very_well(docs):
    """Long texts of few lines, more of them than fit into a slice as texts."""
    rows = [(i, " ".join(f"line {k % (40 + i % 2)} of text {i % 4}" for k in range(20_000)) + f" end {i}") for i in range(12)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_copies(docs(rows)).collect()}
    assert got == {i: i % 4 for i in range(12)}


def test_shuffle_files_go_with_their_job(spark, docs):
    """Each of the many joins would leave its files until the driver collects its garbage."""
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    there, setting = files(), spark.conf.get(key)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(edit(rng, base, i % 6))) for i in range(60)]
    found = ngram_join.near_copies(docs(rows))
    assert files() <= there
    assert spark.conf.get(key) == setting
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_frequent_elements_stand_out_of_full_buckets():
    """Common lines must not open the prefixes of large tables, where every bucket has thousands of other elements."""
    rng = np.random.default_rng(2)
    counts = rng.poisson(5000, 1 << ngram_join.BUCKET_BITS)
    counts[7] += 600
    out = ngram_join.standing_out(counts)
    assert out[7] > 8 and (out > 0).mean() < 0.02
    few = ngram_join.standing_out(np.array([0, 1, 1, 0, 9, 1, 2, 0]))
    assert few.tolist() == [0, 0, 0, 0, 3, 0, 0, 0]


def test_order_needs_both_buckets():
    text = " ".join(f"w{i}" for i in range(40)).encode()
    s, size = ngram_join.shingle_sets([text], 3)[0], 1 << ngram_join.BUCKET_BITS
    ways = np.zeros((2, size), np.int32)
    hot, once = s[5], s[9]
    for way in (0, 1):
        ways[way][ngram_join._bucket(np.array([hot]), way)] = 80
    ways[0][ngram_join._bucket(np.array([once]))] = 80
    ((got, order),) = ngram_join.ordered_sets([text], 3, (np.zeros(size, np.int32), ways), -1000)
    assert (got == s).all() and order.tolist() == [i for i in range(len(s)) if i != 5] + [5]


@pytest.mark.parametrize("share", [(90, 100), (80, 100), (100, 100)])
def test_lists_split_by_size_lose_no_link(docs, monkeypatch, share):
    """Sizes whose ratio is just the share, or just below, all in the same lists."""
    monkeypatch.setattr(ngram_join, "PLAIN_PAIRS", 0)
    rows = [(i, " ".join(f"w{k}" for k in range(n + 2))) for i, n in enumerate([1, 2, 4, 5, 8, 9, 10, 16, 20, 24, 30, 72, 80, 81, 90, 100, 110, 120, 150])]
    rows += [(100 + i, " ".join([*(f"w{k}" for k in range(12)), *(f"x{i}y{k}" for k in range(i))])) for i in range(0, 60, 3)]
    got = sorted(map(tuple, ngram_join.near_copies(docs(rows), share=share).collect()), key=repr)
    assert got == brute(rows, share[0])


def test_bands_hold_every_pair_that_may_link_and_few_others(spark):
    entries = spark.range(1, 3000).selectExpr("7L AS token", "id AS node", "id AS n", "0 AS pos", "id AS component", "0L AS main", "1L AS weight")
    bands = ngram_join.size_bands(entries, (90, 100)).select("token", "n").toPandas()
    sizes = bands.groupby("token")["n"].agg(["min", "max", "size"])
    held = set(zip(sizes["min"], sizes["max"]))
    assert all(any(a <= n and -(-n * 10 // 9) - (n * 10 % 9 > 0) <= b for a, b in held) for n in range(1, 2700))
    assert (sizes["size"] ** 2).sum() < 2999**2 / 4
