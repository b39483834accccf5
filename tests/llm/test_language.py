import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from costloom.llm import language


def brute_bits(train, text, lang):
    """PPM with escapes, method C, a byte at a time."""
    trees = [defaultdict(Counter) for _ in range(4)]
    for t in train[lang]:
        b = b"   " + t
        for i in range(3, len(b)):
            for k in range(4):
                trees[k][b[i - k : i]][b[i]] += 1
    total, b = 0.0, b"   " + text
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                total += 8
                break
            seen = trees[k][b[i - k : i]]
            n, d = sum(seen.values()), len(seen)
            if seen[b[i]]:
                total -= math.log2(seen[b[i]] / (n + d))
                break
            if n:
                total -= math.log2(d / (n + d))
    return total


def test_code_lengths_equal_brute_force():
    train = {"aa": [b"the cat sat on the mat", b"a cat"], "bb": [b"der hund und die katze", "für dich".encode()]}
    rows = [(lang, int(g), 1) for lang, ts in train.items() for t in ts for g in language.grams(t)]
    counts = pd.DataFrame(rows, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum()
    trees = language.Trees(counts)
    texts = [b"the hund", b"xyz", b"katze und cat", "ü".encode(), b"a"]
    want = [[brute_bits(train, t, lang) for lang in ("aa", "bb")] for t in texts]
    assert np.allclose(trees.bits(texts), want)
    language.PIECE, was = 4, language.PIECE
    try:
        assert np.allclose(trees.bits(texts), want)
    finally:
        language.PIECE = was


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.train(docs), keep=["doc_id", "lang"])
    rows = found.withColumn("held", language.held_out("doc_id")).filter("held and length(lang) > 0").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_cases(docs, clashing):
    rows = [(1, "the cat and the dog", "en", "s"), (3, "der hund und die katze", "de", "s"), (7, "the cat", "en", None)]
    rows += [(4, None, "en", None), (5, "12 ... !!", "xx", None), (None, "the", None, None), (8, "", None, None), (8, "", None, None)]
    df = clashing(rows)
    out = language.identify(df, language.train(df)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r.lang_pred)
    assert by[4] == by[5] == ["und"] and by[8] == ["und", "und"]
    kept = language.accepted(df, language.train(df))
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 7]
    none = docs([])
    assert language.train(none) is None
    assert language.identify(none, None).collect() == []
    assert [r.lang_pred for r in language.identify(docs([(1, "abc")]), None).collect()] == ["und"]


def test_many_labels(docs):
    """No number of labels is too many; each may have one row."""
    rows = [(i, f"word{i} {'abc'[i % 3] * 4} text", f"l{i}") for i in range(1200)]
    df = docs(rows)
    found = language.identify(df.limit(20), language.train(df)).collect()
    assert len(found) == 20 and all(r.lang_pred.startswith("l") and 0 <= r.score <= 1 for r in found)


def test_any_column_names_and_long_texts(docs, spark):
    rows = [(i, f"the cat {i} and the dog sat on it", "en") for i in range(8)] + [(i, f"le chat {i} et le chien sur la table", "fr") for i in range(8, 16)]
    rows += [(20, "the dog and the cat " * 200_000, "en"), (21, None, "en"), (22, "", "fr"), (23, "12 !", None)]
    df = docs(rows)
    odd = df.withColumnsRenamed({"source": "my col: x", "n_chars": "a`b,c"})
    trees = language.train(odd)
    kept = language.accepted(odd, trees)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {*range(16), 20}
    found = {r[0]: r for r in language.identify(odd.withColumnRenamed("doc_id", "my id: x"), trees, id_col="my id: x").collect()}
    assert found[20].lang_pred == "en" and found[21].lang_pred == found[22].lang_pred == found[23].lang_pred == "und"
