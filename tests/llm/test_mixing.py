import random
from collections import defaultdict

from pyspark.sql import functions as F

from costloom.llm import mixing


def fill(budget, children):
    """children: name -> (cap, weight) -> given, round by round."""
    given, open_ = dict.fromkeys(children, 0.0), {k for k, (c, w) in children.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] - given[k] <= left * children[k][1] / total + 1e-9}
        if not full:
            for k in open_:
                given[k] += left * children[k][1] / total
            return given
        for k in full:
            left -= children[k][0] - given[k]
            given[k] = children[k][0]
        open_ -= full
    return given


def targets(tokens, share, epochs, weights):
    out, w = {}, lambda level, v: weights.get(level, {}).get(v, 1.0)
    sub = lambda *p: epochs * sum(t for leaf, t in tokens.items() if leaf[: len(p)] == p)
    domains = {leaf[0] for leaf in tokens}
    for d, b in fill(share * sum(tokens.values()), {d: (sub(d), w("domain", d)) for d in domains}).items():
        langs = {leaf[1] for leaf in tokens if leaf[0] == d}
        for x, c in fill(b, {x: (sub(d, x), w("lang", x)) for x in langs}).items():
            srcs = {leaf[2] for leaf in tokens if leaf[:2] == (d, x)}
            for s, g in fill(c, {s: (sub(d, x, s), w("source", s)) for s in srcs}).items():
                out[d, x, s] = g
    return out


def test_targets_and_prefixes(docs):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(4, 400), rng.choice(["en", "en", "fr", "de"]), f"s{min(rng.randrange(9), 4)}") for i in range(600)]
    for share, epochs in ((0.5, 1), (0.9, 1), (1.7, 2), (3.0, 2)):
        weights = {"lang": {"fr": 3.0}, "source": {"s1": 0.25}}
        out = mixing.mix(docs(rows), share, epochs, 7, weights).collect()
        assert len(out) == len(rows)
        tokens, took, least = defaultdict(int), defaultdict(int), defaultdict(lambda: 10**9)
        for r in out:
            leaf = (r.domain, r.lang, r.source)
            tokens[leaf] += r.tokens
            took[leaf] += r.tokens * r.copies
        want = targets(tokens, share, epochs, weights)
        for leaf, t in want.items():
            assert t - 1e-3 <= took[leaf] < t + 101, (leaf, t, took[leaf])
        assert max(r.copies for r in out) <= epochs


def test_prefix_is_of_the_seeded_order(docs):
    rows = [(i, "x" * 40, "en", "s") for i in range(200)]
    df = docs(rows)
    out = mixing.mix(df, 0.25, 1, 3).withColumn("place", mixing.place("doc_id", 3, F.lit(0).cast("long"))).orderBy("place").collect()
    assert [r.copies for r in out] == [1] * 50 + [0] * 150


def test_cases(clashing, docs):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "x" * 300_000, "en", "a"), (4, "abc", "en", None), (4, "abc", "en", None), (None, "abc", "en", "a")]
    df = clashing(rows)
    assert mixing.mix(df).count() == len(rows)
    whole = mixing.take_mix(df, share=1.0)
    assert whole.columns == df.columns and whole.count() >= 4
    assert mixing.take_mix(df, share=0.0).count() == 0
    assert mixing.mix(docs([])).collect() == [] and mixing.take_mix(docs([])).collect() == []
