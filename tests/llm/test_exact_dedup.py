import hashlib
from collections import defaultdict

from costloom.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "x" * 100_000), (7, "x" * 100_000), (7, "x" * 100_000), (None, "a"), (None, "n"), (9, "é")]


def test_equals_brute_force(clashing, sample):
    rows = ROWS + [(100 + i, "hot") for i in range(300)]
    got = exact_dedup.exact_copies(clashing(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    got = exact_dedup.exact_copies(sample).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r.doc_id, r.text) for r in sample.collect()])


def test_equal_digests_of_different_texts_stay_apart(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab" * 32))
    got = exact_dedup.exact_copies(docs(ROWS)).collect()
    assert sorted(tuple(r)[:4] for r in got if r.doc_id) == sorted(r[:4] for r in brute(ROWS) if r[0])


def test_kept_rows(clashing, docs):
    df = clashing(ROWS)
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in ROWS})
    assert {r.doc_id for r in out.collect()} == {2, 3, 5, 6 + 1, 9, None}


def test_empty(docs):
    assert exact_dedup.exact_copies(docs([])).collect() == []
    assert exact_dedup.drop_exact_copies(docs([])).collect() == []
