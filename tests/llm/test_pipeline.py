from collections import Counter

import corpus_pipeline as cp
import pytest


@pytest.fixture
def steps(spark, docs, sf_dir):
    def run(rows):
        df, out = docs(rows), []
        columns = df.columns
        for name, stage in cp.STAGES:
            df = stage(spark, df, sf_dir)
            if name != "sentencepiece":
                assert df.columns == columns
            out.append((name, [r.asDict() for r in df.collect()]))
        return dict(out)

    return run


def prose(k, n=60, lang="en"):
    words = {"en": "the of and this that with were from have which", "fr": "le la des une avec pour dans est sont leur"}[lang].split()
    return " ".join(words[(k * 7 + i * i * (k + 3)) % 10] + "abcdefghij"[(i * k + i) % 10] * ((i + k) % 3) + str("") for i in range(n)) + f" x{k}"


def test_decisions_take_effect(steps):
    rows = [(i, prose(i, 60 + i, "en" if i % 3 else "fr"), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(60)]
    near = [f"w{i}" + "aeiou"[i % 5] for i in range(120)]
    rows += [(100, "12 34 ...", "en", "s0"), (101, None, "en", "s0"), (102, rows[4][1], "en", "s1"), (103, rows[4][1], "en", "s1")]
    rows += [(110, " ".join(near), "en", "s1"), (111, " ".join([*near[:50], "other", *near[51:]]), "en", "s2")]
    out = steps(rows)
    ids = lambda name: Counter(r["doc_id"] for r in out[name])
    assert not {100, 101} & set(ids("language_id")) and len(ids("language_id")) == len(rows) - 2
    assert {4, 102, 103} & set(ids("exact_dedup")) == {103}
    assert {110, 111} & set(ids("ngram_join")) == {110}
    assert 0 < len(ids("mixing")) < len(ids("ngram_join"))
    assert ids("sentencepiece") == ids("mixing") and max(ids("mixing").values()) == 1


def test_run_equals_the_stages(spark, sf_dir):
    whole = {tuple(r) for r in cp.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert whole == {tuple(r) for r in docs.select("doc_id", "ids_sha256").collect()} and whole


def test_odd_tables(steps):
    assert all(rows == [] for rows in steps([]).values())
    out = steps([(None, None, None, None), (None, "a b c", None, None), (1, "a b c d", "en", None), (1, "a b c d", "en", None), (2, "", "en", "s")])
    assert Counter(r["text"] for r in out["exact_dedup"]) == {"a b c": 1, "a b c d": 1}
