import hashlib
import random

from costloom.llm import substring


def brute(rows, window=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                w = tuple(words[k : k + window])
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(words), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force(clashing, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 2000)
    monkeypatch.setattr(substring, "GROUP", 3000)
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "über", "A", "dd"]) + rng.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (13, 14, 20, 60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(20))]
            words += rng.choice(passages)[: rng.choice([12, 13, 60])]
        rows.append((i * 7 - 300, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(5, None), (6, ""), (7, "   "), (None, rows[3][1]), (8, "a " * 100), (8, "a " * 100), (9, "a " * 50), (10, "x" * 100_000)]
    got = substring.drop_repeated(clashing(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_equals_brute_force_on_a_table(sample):
    got = substring.drop_repeated(sample).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r.doc_id, r.text) for r in sample.collect()])


def test_kept_text(docs):
    p = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r.kept_text for r in substring.drop_repeated(docs([(1, p), (2, f"a {p} b")]), with_text=True).collect()}
    assert got == {1: p, 2: "a b"}


def test_empty(docs):
    assert substring.drop_repeated(docs([])).collect() == []
