"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document's set: its distinct word 3-grams (as 64-bit hashes). Two link if 100 * shared >= 90 * union.

Order. Elements go by how often they should occur, in steps, then by hash; the order only has to be the same
everywhere. The estimate is the larger of two: the words' frequencies multiplied, and the count of the element's
own hash buckets where both stand out. They come from tables of a fixed 2**18 counts over all documents. In any
order two linked sets share an element of their prefixes (the first n - ceil(0.9 n) + 1).

Grouping. Equal sets are one node. Nodes of equal prefix and size are one group, and only groups go
through the join on prefix elements. Each element's list names a hub, the group where it stands first;
groups pair with hubs, pairs that size or place rule out go, and the rest expand to members, whose whole sets
are compared. A parity map of each set, of a bit or two for each element, rules out most pairs before
that (maps never differ in more bits than sets do in elements). What that links are components; a list whose nodes are all in one component holds no further
news. In the other lists every pair of nodes of different components is compared, unless size, place or
a short map (the parity map folded to 256 bits, tested inside the join, so that no such pair is written) rules it out.
Longer lists are first split by size: a set goes to the band of its size and the next, as sizes of a link differ by one band at
most. Where that could still be over MOST_PAIRS pairs of a band (texts that share a rare element and little
else), lists of two elements take its place, again with hubs first. So all components are exact, while a
group of a million near copies costs about one comparison each, not one for each pair. Only texts that share two
elements of their prefixes, stay below the share and are no part of one component are compared pair by pair.

Skew. Lists are never collected: hubs are minima with map-side combining, and joins on an element, a group, a hub, a set or
a component's root deal hot keys over parts (see common.spread_join). Comparisons carry compressed texts, not sets, which are several times larger.

Defined cases: no words or no text: an empty set that links with nothing; one or two words: the whole
sequence is the one element; a null id takes no part and has a null component; rows that repeat an id
are one document; ties don't occur (a component has one least id); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from costloom.llm.common import hot_keys, opened, shipped, shuffles_cleared, slices, small, spread_join, text_batches, written
from costloom.llm.components import components
from costloom.llm.hashing import U, mix, prefix_sums, spans_hash, window_starts, windows_hash, word_windows, words_of

SHINGLE = 3
SHARE = (90, 100)
BUCKET_BITS = 18
MAP_BITS = 10
BRIEF = 4  # longs of a short map
KEPT = 2_000_000  # elements of sets that a task keeps for further comparisons
MOST_PAIRS = 1_000_000  # below that, pairs cost no more than the longer lists
PAIRS_A_ROW = 16  # about so many pairs cost what a row of a longer list does
PLAIN_PAIRS = 1_000  # lists of more are split by size
LEAST = 4  # elements of sets that share two if they link, at any share of one half or more


def shingle_sets(texts: list[bytes], width: int, words: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles. words: the hashes and numbers of the texts' words, where known."""
    hashes, counts = words_of([t.lower() for t in texts]) if words is None else words  # bytes: A-Z only
    windows, n = word_windows(hashes, counts, width)
    sums, out, at, start = None, [], 0, 0
    for c, k in zip(counts.tolist(), n.tolist()):
        if k:
            out.append(np.unique(windows[at : at + k]))
        elif c:
            sums = prefix_sums(hashes) if sums is None else sums
            out.append(spans_hash(sums, np.array([start]), np.array([start + c])))
        else:
            out.append(np.zeros(0, U))
        at, start = at + k, start + c
    return out


def frequencies(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """By hash bucket, in eighths: log2 of a word's share of all words; log2 of an element's count where it stands out, for two ways to deal elements."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(3 * size, np.int64)
        for b in slices(batches, 0):
            texts = [t or b"" for t in b.column(0).to_pylist()]
            words = words_of([t.lower() for t in texts])
            elements = np.concatenate(shingle_sets(texts, width, words))
            for k, found in enumerate((_bucket(words[0]), _bucket(elements), _bucket(elements, 1))):
                n[k * size : (k + 1) * size] += np.bincount(found, minlength=size)
        at = np.flatnonzero(n)
        for s in range(0, len(at), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 20_000].astype(np.int32)), pa.array(n[at[s : s + 20_000]])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket int, n long")
    counted = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 3 * 2**18 rows at most
    n = np.zeros(3 * size)
    n[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    words, elements = n[:size], n[size:].reshape(2, size)
    share = np.log2(np.maximum(words, 1) / max(1.0, words.sum()))
    stands_out = np.array([standing_out(x) for x in elements])
    # whole eighths, so that sums are exact and an element gets one place in the order wherever it stands
    return np.round(8 * share).astype(np.int32), np.round(8 * stands_out).astype(np.int32)


def standing_out(counts: np.ndarray) -> np.ndarray:
    """log2 of what a bucket's count is over the usual, 0 where that is likely chance.

    Buckets fill as the table grows, but what chance adds grows with the root of that only. An element has two
    buckets, and chance seldom lifts both.
    """
    usual = max(1.0, float(np.median(counts)))
    spread = max(np.sqrt(usual), usual - float(np.quantile(counts, 0.16)))
    over = counts - usual
    return np.where(over > min(usual, 2.5 * spread), np.log2(np.maximum(over, 1)), 0)


def _bucket(hashes: np.ndarray, way: int = 0) -> np.ndarray:
    return (hashes << U(way * BUCKET_BITS) >> U(64 - BUCKET_BITS)).astype(np.int64)


def ordered_sets(texts: list[bytes], width: int, tables: tuple[np.ndarray, np.ndarray], total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's set, sorted by hash, and the order of its elements from rare to frequent. total: log2 of all words, in eighths."""
    share, counts_of = tables
    hashes, counts = words_of([t.lower() for t in texts])
    starts, n = window_starts(counts, width)
    windows = windows_hash(prefix_sums(hashes), width)[starts]
    sums = np.concatenate(([0], np.cumsum(share[_bucket(hashes)], dtype=np.int64)))
    expected = sums[starts + width] - sums[starts] + total
    short, at = shingle_sets(texts, width) if (n == 0).any() else None, 0
    for i, k in enumerate(n.tolist()):
        if not k:
            yield short[i], np.arange(len(short[i]))
            continue
        s, first = np.unique(windows[at : at + k], return_index=True)
        counted = np.minimum(counts_of[0][_bucket(s)], counts_of[1][_bucket(s, 1)])
        step = np.clip(np.maximum(expected[at : at + k][first], counted), 0, 1000) // 4
        yield s, np.argsort(step.astype(np.uint8), kind="stable")
        at += k


def prefix_table(docs: DataFrame, id_col: str, text_col: str, width: int, share: tuple[int, int]) -> DataFrame:
    """id, n, h1, h2 (hashes of the set), g (of prefix and size), prefix, map (parities of hash ranges), brief (map folded), more (the element after the prefix)."""
    tables = frequencies(docs, text_col, width)
    total = int(-tables[0].min())  # a word that occurs once: its share is one over all
    shared = shipped(docs.sparkSession, (tables, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(shared)
        for b in slices(batches, 1):
            n, h1, h2, g, lengths, prefixes, maps, brief, more = [], [], [], [], [], [], [], [], []
            for s, order in ordered_sets([t or b"" for t in b.column(1).to_pylist()], width, *known):
                k = len(s)
                length = k + -(-share[0] * k // share[1]) * -1 + 1 if k else 0
                prefix = s[order[:length]]
                n.append(k)
                h1.append(mix(s).sum(dtype=U))
                h2.append(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                g.append(mix(mix(prefix).sum(dtype=U) + U(k)))
                more.append(s[order[length : length + 1]])
                lengths.append(length)
                prefixes.append(prefix)
                bits = 1 << max(MAP_BITS, int(k - 1).bit_length() if k else 0)
                odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                brief.append(np.bitwise_xor.reduce(maps[-1].reshape(-1, BRIEF)))
            tokens = np.concatenate(prefixes).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), pa.array(tokens))
            longs = [pa.array(np.array(x, U).view(np.int64)) for x in (h1, h2, g)]
            kept = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, maps)]).astype(np.int32)), pa.array(np.concatenate(maps)))
            next_one = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, more)]).astype(np.int32)), pa.array(np.concatenate(more).view(np.int64)))
            folded = pa.ListArray.from_arrays(pa.array(np.arange(0, BRIEF * len(brief) + 1, BRIEF, np.int32)), pa.array(np.concatenate(brief)))
            names = ["id", "n", "h1", "h2", "g", "prefix", "map", "brief", "more"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *longs, lists, kept, folded, next_one], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(
        run, "id long, n long, h1 long, h2 long, g long, prefix array<long>, map array<long>, brief array<long>, more array<long>"
    )


def may_link(n1: str, pos1: str, n2: str, pos2: str, share: tuple[int, int]) -> Column:
    """False where sizes, or the places of a common element that may be the first, rule a link out."""
    a, b = share
    need = F.ceil((F.col(n1) + F.col(n2)) * a / (a + b) - 1e-9)
    most = F.least(F.col(n1) - F.col(pos1), F.col(n2) - F.col(pos2))
    return (most >= need) & (F.least(n1, n2) * b >= F.greatest(n1, n2) * a)


def most_apart(size: Column, share: tuple[int, int]) -> Column:
    """In how many elements two sets that link may differ at most. size: that of both together."""
    return size - 2 * F.ceil(size * share[0] / (share[0] + share[1]) - 1e-9)


def plausible(pairs: DataFrame, maps: DataFrame, share: tuple[int, int]) -> DataFrame:
    """pairs: a, b -> those whose parity maps (maps: node, n, map) differ in no more bits than the sets of a link may.

    The first of a pair may be that of very many, the second is not.
    """
    x, y = (maps.select(*[F.col(c).alias(k + c) for c in ("node", "n", "map")]) for k in "ab")
    both = spread_join(pairs, x.withColumnRenamed("anode", "a"), ["a"], "b", hot_keys(pairs, ["a"])).join(y.withColumnRenamed("bnode", "b"), "b")
    half = lambda m: (F.size(m) / 2).cast("int")
    folded = lambda m: F.zip_with(F.slice(m, F.lit(1), half(m)), F.slice(m, half(m) + 1, half(m)), lambda u, v: u.bitwiseXOR(v))
    # sets that may link differ in size by less than 2, so their maps by one halving at most
    left = F.when(F.size("amap") > F.size("bmap"), folded(F.col("amap"))).otherwise(F.col("amap"))
    right = F.when(F.size("bmap") > F.size("amap"), folded(F.col("bmap"))).otherwise(F.col("bmap"))
    both = both.filter(F.least("an", "bn") * share[1] >= F.greatest("an", "bn") * share[0])
    apart = F.aggregate(F.zip_with(left, right, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, k: t + k)
    return both.filter(apart <= most_apart(F.col("an") + F.col("bn"), share)).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, share: tuple[int, int]) -> DataFrame:
    """pairs: a, b -> those whose whole sets link."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = written(_texts_of(docs, ids, id_col, text_col))
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    both = spread_join(left, texts.select(F.col("id").alias("a"), F.col("z").alias("za")), ["a"], "b", hot_keys(pairs, ["a"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, known, held = zstandard.ZstdDecompressor(), OrderedDict(), 0

        def sets(names: list[bytes]) -> list[np.ndarray]:
            nonlocal held
            new = list(dict.fromkeys(x for x in names if x not in known))
            known.update(zip(new, shingle_sets([z.decompress(x) for x in new], width)))
            held += sum(len(known[x]) for x in new)
            out = [known[x] for x in names]
            while held > KEPT:
                held -= len(known.popitem(last=False)[1])
            return out

        for b in unpacked_slices(batches, (2, 3)):
            za, zb = sets(b.column(2).to_pylist()), sets(b.column(3).to_pylist())
            hit = []
            for x, y in zip(za, zb):
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(share[1] * both >= share[0] * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.select("a", "b", "za", "zb").mapInArrow(compare, "a long, b long")


def unpacked_slices(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose compressed texts have about `size` bytes as texts: repeated lines may pack 500 to 1."""
    for b in batches:
        held, at = 0, 0
        for row, packed in enumerate(zip(*(b.column(c).to_pylist() for c in columns))):
            n = sum(map(zstandard.frame_content_size, packed))
            if row > at and held + n > size:
                yield b.slice(at, row - at)
                held, at = 0, row
            held += n
        if b.num_rows:
            yield b.slice(at)


def compressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, 1):
            data = pa.array([z.compress((t or b"").lower()) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data], ["id", "z"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "id long, z binary")


def _texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, z of the documents with these ids; where they are few, no other text is compressed or shuffled."""
    few = small(ids)
    if few is not ids:
        return compressed(docs.join(few.withColumnRenamed("id", id_col), id_col, "left_semi"), id_col, text_col).dropDuplicates()
    return compressed(docs, id_col, text_col).join(ids, "id", "left_semi").dropDuplicates()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """id, n_shingles, component_id of each row."""
    if 2 * share[0] < share[1]:
        raise ValueError("a share of one half at least is needed")
    text_batches(docs.sparkSession)
    with shuffles_cleared(docs.sparkSession):
        return _near_copies(docs, id_col, text_col, width, share)


def _near_copies(docs: DataFrame, id_col: str, text_col: str, width: int, share: tuple[int, int]) -> DataFrame:
    sets = written(prefix_table(docs, id_col, text_col, width, share))
    full = sets.filter("n > 0 and id is not null")
    # distinct sets; one group for those of equal prefix and size, named by its least id
    nodes = written(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), F.first("g").alias("g")))
    heads = written(nodes.groupBy("g").agg(F.min("node").alias("gid"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n")))
    hot_groups = hot_keys(heads, ["g"], count="k")
    others = written(full.select("id", "g").join(heads.select(F.col("gid").alias("id"), "g"), ["id", "g"], "left_anti").distinct())
    groups = full.select("id", "g", "n", "prefix").join(small(others), ["id", "g"], "left_anti")
    postings = groups.select(F.col("id").alias("gid"), "g", "n", F.posexplode("prefix").alias("pos", "token"))
    # an element that only one group has says nothing; counting first keeps the rest of the row out of one shuffle
    shared = written(postings.groupBy("token").count().filter("count > 1"))
    hot_tokens = hot_keys(shared, ["token"], count="count")
    inside = heads.filter("k > 1").select(F.col("g").alias("token"), "gid", "g", "n", F.lit(0).alias("pos"))
    elements = spread_join(postings, shared.select("token"), ["token"], "gid", hot_tokens)
    lists = written(elements.select("token", "gid", "g", "n", "pos").unionByName(inside))
    hubs = lists.groupBy("token").agg(F.min_by("gid", "pos").alias("hub"), F.min("pos").alias("hub_pos"), F.min_by("n", "pos").alias("hub_n"))
    members = written(spread_join(nodes, lists.select("g").distinct(), ["g"], "node", hot_groups).select("node", "g", "n"))
    maps = written(full.select(F.col("id").alias("node"), "n", "map", "brief").join(members.select("node"), "node", "left_semi"))
    ahead = spread_join(lists, hubs, ["token"], "gid", hot_tokens).filter(may_link("n", "pos", "hub_n", "hub_pos", share)).select("hub", "g")
    ahead = ahead.unionByName(heads.filter("k > 1").select(F.col("gid").alias("hub"), "g")).distinct()
    pairs = spread_join(members, ahead, ["g"], "node", hot_groups).select(F.col("hub").alias("a"), F.col("node").alias("b")).filter("a != b").distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        return written(verified(written(plausible(written(pairs), maps, share)), docs, id_col, text_col, width, share))

    links = linked(pairs)
    joined = components(links)
    found = _with_component(members, joined)
    placed = spread_join(found, lists.select("token", "g", "pos"), ["g"], "node", hot_groups)
    entries = open_lists(placed.select("token", "node", "n", "pos", "component"), share)
    plain = min(PLAIN_PAIRS, MOST_PAIRS)
    bands = open_lists(size_bands(entries.filter(F.col("weight") > plain), share), share)
    rest = across(entries.filter(F.col("weight") <= plain).unionByName(bands.filter(F.col("weight") <= MOST_PAIRS)), maps, share)
    crowded = bands.filter(F.col("weight") > MOST_PAIRS)
    if not crowded.isEmpty():
        tiny = across(crowded.filter(F.col("n") < 2 * LEAST), maps, share, F.least("n1", "n2") < LEAST)
        finer = two_elements(crowded.filter(F.col("n") >= LEAST), full, share)
        links = links.unionByName(linked(hub_pairs(finer, share)))
        joined = components(links)
        now = _with_component(finer.drop("component", "main", "weight"), joined)
        rest = rest.unionByName(tiny).unionByName(across(open_lists(now, share), maps, share)).distinct()
    new = linked(rest)
    if not new.isEmpty():
        joined = components(links.unionByName(new))
    by_set = _with_component(nodes, joined).select("h1", "h2", "n", "component")
    out = spread_join(sets.select("id", "n", "h1", "h2"), by_set, ["h1", "h2", "n"], "id", hot_keys(sets, ["h1", "h2", "n"]), "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def open_lists(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Entries (token, node, n, pos, component) of lists that hold several components, with the largest one and a weight.

    That is a bound of the pairs, less in proportion where lists of two elements would have more rows than pairs are worth.
    """
    parts = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    k, rows = F.sum("k"), F.sum("n") * (1 - share[0] / share[1])
    weight = (k - F.max("k")) * k / F.greatest(F.lit(1.0), rows * PAIRS_A_ROW / 1e6)
    lists = parts.groupBy("token").agg(F.max_by("component", "k").alias("main"), F.count(F.lit(1)).alias("parts"), F.ceil(weight).alias("weight"))
    return written(entries.join(lists.filter("parts > 1").drop("parts"), "token"))


def size_bands(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Entries of the lists split by size: sizes of sets that link are in one band or in two that touch, and each set goes to its own and the next."""
    band = F.floor(F.log("n") / math.log(share[1] / share[0] + 1e-9)) if share[0] < share[1] else F.col("n")
    both = entries.drop("main", "weight").withColumn("band", F.explode(F.array(band, band + 1)))
    return both.withColumn("token", F.xxhash64("token", "band")).drop("band")


def across(entries: DataFrame, maps: DataFrame, share: tuple[int, int], more: Column | None = None) -> DataFrame:
    """a, b: every pair of nodes of different components in an open list that sizes, places and short maps don't rule out."""
    brief = [f"m{k}" for k in range(BRIEF)]
    known = maps.select("node", "n", *[F.col("brief")[k].alias(m) for k, m in enumerate(brief)])
    wide = entries.join(known, ["node", "n"])
    x, y = (wide.select("token", *[F.col(c).alias(c + s) for c in ("node", "n", "pos", "component", "main", *brief)]) for s in "12")
    apart = sum((F.bit_count(F.col(m + "1").bitwiseXOR(F.col(m + "2"))) for m in brief), F.lit(0))
    # every pair of different components has a side outside the largest one
    at = (F.col("component1") != F.col("component2")) & may_link("n1", "pos1", "n2", "pos2", share) & (x["token"] == y["token"])
    at &= apart <= most_apart(F.col("n1") + F.col("n2"), share)
    both = x.filter("component1 != main1").join(y, at if more is None else at & more)
    return both.select(F.greatest("node1", "node2").alias("a"), F.least("node1", "node2").alias("b")).distinct()


def two_elements(entries: DataFrame, full: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Open lists of two elements in place of crowded lists of one.

    Linked sets of LEAST elements or more have two elements or more in common among one more than their prefixes, so a
    pair that is in a list by one element has another there, too.
    """
    wide = full.select(F.col("id").alias("node"), "n", F.array_union("prefix", "more").alias("wide"))
    both = entries.drop("main", "weight").join(wide, ["node", "n"]).select("*", F.explode("wide").alias("other")).filter("other != token").drop("wide")
    return open_lists(both.withColumn("token", F.xxhash64("token", "other")).drop("other").distinct(), share)


def hub_pairs(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b: each list's first node with those of other components: one comparison a member."""
    hubs = entries.groupBy("token").agg(F.min(F.struct("pos", "node", "n", "component")).alias("h")).select("token", "h.*").toDF("token", "hub_pos", "hub", "hub_n", "hub_component")
    ahead = spread_join(entries, hubs, ["token"], "node", hot_keys(entries, ["token"])).filter((F.col("component") != F.col("hub_component")) & may_link("n", "pos", "hub_n", "hub_pos", share))
    return ahead.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def _with_component(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the one of the least id."""
    found = near_copies(docs, id_col, text_col, width, share)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM split
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 90 * (s.n + t.n - k)
), edges AS MATERIALIZED (
  SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = d.doc_id
"""
