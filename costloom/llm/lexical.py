"""Ranked lexical search: all items' terms are counted in all documents by one Aho-Corasick automaton, without a document index.

Automaton. The distinct terms of the items, each between two guards, are one automaton, which is broadcast. A text's
bytes are mapped so that letters A-Z are lower case and all that is no part of a term is the guard; so a match is
always a whole term, and the automaton's outputs, sorted by document and term, are the tf. A term leads to its items.

Two scans of the texts. The first counts N (documents with a term), L (terms) and each item term's df: a task sends one row
for each of its terms. The second has the weights: a task adds up w * tf part for each document and item it meets and
keeps the best k of each item while it goes, so it sends k rows for each item at most. No pair of document and item is
stored, and terms of weight 0 are not looked for. Spark keeps k rows of each item and task again before it ranks them.

Bounds. Items are dealt over blocks of about BLOCK_BYTES of text, each with its own automaton and scans; only a block is
broadcast, and its terms' counts are all that reaches the driver. Texts are read in pieces of about PIECE bytes, long ones
in several (cut between terms) whose counts are added up.

Defined cases: null and empty texts and texts without a term are no documents (they count nowhere) and items without
results; documents with a null id count and rank, after others of equal score; rows that share an id are documents or
items of their own; repeated terms of an item count once; equal scores rank by id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from costloom.llm.common import opened, shipped, slices, written

K = 10
BLOCK_BYTES = 2 << 20  # of item texts in an automaton
PIECE = 1 << 20  # bytes of texts that are scanned at once
GUARD = 32
_TERM = [c for c in range(256) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A]
MAPPED = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in set(_TERM) else GUARD for c in range(256))

_SQL_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_SQL_TERMS.format("text")} AS t FROM documents WHERE text IS NOT NULL),
i AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, list_distinct({_SQL_TERMS.format("text")}) AS t FROM benchmark WHERE text IS NOT NULL),
tot AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
of_item AS MATERIALIZED (SELECT item, unnest(t) AS term FROM i),
tfs AS MATERIALIZED (SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM of_item) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, tot GROUP BY term),
lengths AS (SELECT doc, doc_id, 100 - 90 + ((90 * CAST(len(t) AS BIGINT) * n_docs) // n_terms) AS m FROM d, tot),
scores AS (SELECT item, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM tfs JOIN weights USING (term) JOIN lengths USING (doc) JOIN of_item USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores JOIN i USING (item) WHERE score > 0
  WINDOW w AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= {K}"""


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(MAPPED).split()


class Counter:
    """Counts terms (distinct, in order of their numbers) in texts."""

    def __init__(self, terms: list[bytes], wanted: np.ndarray | None = None):
        import ahocorasick

        self.size = len(terms)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(terms):
            if wanted is None or wanted[number]:
                self.machine.add_word(f" {term.decode('latin-1')} ", number)
        if len(self.machine):
            self.machine.make_automaton()

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's number of terms; and (text number, term number, tf) of the known ones, by text and term."""
        n = np.zeros(len(texts), np.int64)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for numbers, parts in pieces(texts):
            data = b" " + b" ".join(parts) + b" "
            ends = np.cumsum([len(p) + 1 for p in parts])
            at_guard = np.frombuffer(data, np.uint8) == GUARD
            starts = np.flatnonzero(at_guard[:-1] & ~at_guard[1:])
            np.add.at(n, numbers, np.diff(np.searchsorted(starts, [0, *ends])))
            if len(self.machine):
                hits = np.fromiter(itertools.chain.from_iterable(self.machine.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
                key, count = np.unique(numbers[np.searchsorted(ends, hits[:, 0])] * self.size + hits[:, 1], return_counts=True)
                keys.append(key)
                counts.append(count)
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        tf = np.zeros(len(key), np.int64)
        np.add.at(tf, at, np.concatenate(counts))
        return n, key // max(1, self.size), key % max(1, self.size), tf


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(text numbers, mapped parts) of about PIECE bytes; a longer text is cut at guards."""
    numbers, parts, held = [], [], 0
    for number, text in enumerate(texts):
        text = text.translate(MAPPED)
        at = 0
        while at < len(text):
            cut = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
            cut = len(text) if cut < 0 else cut
            numbers.append(number)
            parts.append(text[at:cut])
            held += cut - at
            at = cut
            if held >= PIECE:
                yield np.array(numbers), parts
                numbers, parts, held = [], [], 0
    if parts:
        yield np.array(numbers), parts


class Block:
    """The terms of a block of items, their items as ranges of a list, and the items' row numbers."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.rows = np.array([r for r, _ in rows], np.int64)
        found: dict[bytes, list[int]] = {}
        for item, (_, text) in enumerate(rows):
            for term in dict.fromkeys(terms_of(text)):
                found.setdefault(term, []).append(item)
        self.terms = list(found)
        self.bounds = np.cumsum([0, *map(len, found.values())])
        self.items = np.array([i for items in found.values() for i in items], np.int64)


class Scorer:
    def __init__(self, block: Block, n_docs: int, n_terms: int, df: np.ndarray):
        self.block, self.n_docs, self.n_terms = block, n_docs, n_terms
        # a term without documents has no tf either
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item, score) of the texts that n, doc, term and tf are about."""
        m = np.array([10 + 90 * x * self.n_docs // max(1, self.n_terms) for x in n.tolist()], np.int64)  # Python integers: the product may be large
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        first, last = self.block.bounds[term], self.block.bounds[term + 1]
        width = last - first
        item = self.block.items[np.repeat(first - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        items = max(1, len(self.block.rows))
        key = np.repeat(doc, width) * items + item
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        score = np.add.reduceat(np.repeat(part, width)[order], cuts) if len(cuts) else np.zeros(0, np.int64)
        return key[cuts] // items, key[cuts] % items, score


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # scores of 0 don't count
        self.item, self.score, self.unnamed, self.doc = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, item: np.ndarray, score: np.ndarray, unnamed: np.ndarray, doc: np.ndarray) -> None:
        may = score >= self.least[item]
        both = [np.concatenate((a, b[may])) for a, b in ((self.item, item), (self.score, score), (self.unnamed, unnamed), (self.doc, doc))]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        by = both[0][order]
        place = np.arange(len(by)) - np.searchsorted(by, by)
        order, place = order[place < self.k], place[place < self.k]
        self.item, self.score, self.unnamed, self.doc = (x[order] for x in both)
        last = place == self.k - 1
        self.least[self.item[last]] = self.score[last]


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in slices(batches, 1):
        yield b, [t or b"" for t in b.column(1).to_pylist()]


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The item column, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    named = written(items.select(F.col(item_col), F.col(text_col).cast("binary").alias("__text"), F.monotonically_increasing_id().alias("__row")))
    size = named.agg(F.sum(F.length("__text") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for number in range(blocks):
        mine = named.filter((F.pmod(F.xxhash64("__row"), F.lit(blocks)) == number) & F.col("__text").isNotNull())
        ranked = _block(texts, Block([(r["__row"], bytes(r["__text"])) for r in mine.select("__row", "__text").toArrow().to_pylist()]), k)
        found = ranked if found is None else found.unionByName(ranked)
    w = W.partitionBy("__row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(named.select("__row", item_col), "__row").select(item_col, "rank", "doc_id", "score")


def _block(texts: DataFrame, block: Block, k: int) -> DataFrame:
    """__row (of the item), doc_id, score: each task's k best documents of each item of a block."""
    spark, size = texts.sparkSession, len(block.terms)
    terms = shipped(spark, block.terms)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, df = Counter(opened(terms)), np.zeros(size, np.int64)
        n_docs = n_terms = 0
        for _, part in texts_of(batches):
            n, _, term, _ = counter.count(part)
            n_docs += int((n > 0).sum())
            n_terms += int(n.sum())
            df += np.bincount(term, minlength=size)
        known = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"what": pa.array([-2, -1, *known], pa.int64()), "n": pa.array([n_docs, n_terms, *df[known]], pa.int64())})

    counts = texts.mapInArrow(tally, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the block
    df = np.zeros(size + 2, np.int64)
    df[counts.column("what").to_numpy()] = counts.column("n").to_numpy()  # the last two are N and L
    scorer = Scorer(block, int(df[-2]), int(df[-1]), df[:size])
    shared = shipped(spark, scorer)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(shared)
        counter, best = Counter(known.block.terms, known.weight > 0), Best(len(known.block.rows), k)
        for b, part in texts_of(batches):
            ids = b.column(0)
            unnamed, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            doc, item, score = known.scores(*counter.count(part))
            best.add(item, score, unnamed[doc], ids[doc])
        columns = (pa.array(known.block.rows[best.item]), pa.array(best.doc, mask=best.unnamed), pa.array(best.score))
        yield pa.RecordBatch.from_arrays(list(columns), ["__row", "doc_id", "score"])

    return texts.mapInArrow(rank, "__row long, doc_id long, score long")
