import collections
import math
import re

import pytest
from pyspark.sql import types as T

from costloom.llm import lexical

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the stated formulas; a null doc_id comes as None."""
    have = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(have), sum(sum(c.values()) for _, c in have)
    df = collections.Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in have:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if unnamed else i, -s) for r, (s, unnamed, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, make, **kw):
    got = lexical.search(make(docs), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS), **kw).collect()
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got], key=str)


def test_cases(spark, clashing):
    docs = [
        (1, "The cat sat. The CAT ran!"), (2, "cat"), (3, "concatenate cats"), (4, None), (5, ""), (6, " \t-- "), (None, "cat"), (None, "a cat"), (7, "Ünï-cöde Ünï"), (8, "ünï"),
        (9, "x1_y2 x1"), (9, "y2 cat"), (10, "cat"), (11, "日本 cat\x00dog\x7fbird"), (12, "dog" * 500), (13, "é cat é"),
    ]
    items = [(1, "Cat, cat; THE dog"), (2, None), (3, ""), (4, "?!"), (5, "nothing here"), (6, "Ünï"), (6, "x1 y2"), (None, "bird"), (7, "É é 日本"), (8, "cat")]
    assert found(spark, docs, items, clashing) == brute(docs, items)


@pytest.mark.parametrize("bytes_", [1 << 20, 300])
def test_many_texts_in_blocks_and_pieces(spark, docs, monkeypatch, bytes_):
    monkeypatch.setattr(lexical, "PIECE", 500)
    words = [f"w{i * i % 97}" for i in range(200)]
    rows = [(i, " ".join(words[(i * k) % 200] for k in range(i % 40))) for i in range(300)]
    rows.append((1000, " ".join(f"w{i % 50}" for i in range(5000))))  # many pieces
    rows += [(2000 + i, "w3 w5 common") for i in range(100)]  # ties
    items = [(i, f"w{i} w{i * 3 % 97} W{i * 7 % 97} common") for i in range(30)]
    assert found(spark, rows, items, docs, block_bytes=bytes_) == brute(rows, items)


def test_empty_tables(spark, docs):
    assert found(spark, [], [(1, "a")], docs) == []
    assert found(spark, [(1, "a")], [], docs) == []
    assert found(spark, [(1, "..")], [(1, "a")], docs) == []


def test_numbers_beyond_64_bits():
    block = lexical.Block([(0, b"a")])
    scorer = lexical.Scorer(block, 10**12, 10**13, [1])
    import numpy as np

    one = np.array([0])
    _, _, score = scorer.scores(np.array([10**9]), one, one, np.array([3]))
    m = 10 + 90 * 10**9 * 10**12 // 10**13
    assert score[0] == math.floor(1000 * math.log((2 * 10**12 + 2) / 3)) * ((3 * 10**9) // (3000 + 8 * m))
