"""Substring dedup by Rabin-Karp hashes of every window of 13 words.

1. Tasks hash every window of their documents (prefix sums: a constant cost each). Windows that repeat
   within a chunk of documents are settled there: the smallest id's goes on, the others are marked.
   A window in a third of all documents is thus one entry for each chunk, not one for each document.
2. A shuffle by ranges of the hash brings equal windows together; each is counted, and all but the
   smallest id's are marked.
3. Marks meet their documents in a shuffle by id groups of a bounded size; overlapping marked windows
   merge into maximal intervals, and what they cover is removed.

The numbers of hash ranges, id groups and partitions follow the number of bytes, so no task grows with the input.

Windows are told apart by 64-bit hashes. Two different ones share a hash with a chance of 2**-64 a pair, so below
about 10**9 windows (6 GB of text) a false match is improbable, at 10**13 (60 TB) some millions are to be expected.

Defined cases: a null text has no words; fewer words than a window: nothing is removed; a null id
takes no part (its text is kept whole); rows that repeat an id are one document's and don't make
each other's windows repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from costloom.llm import packed
from costloom.llm.common import row_schema, slices, text_batches
from costloom.llm.hashing import mix, word_windows, words_of

WINDOW = 13
CHUNK = 4 << 20  # bytes of text that a task hashes at once
GROUP = 4 << 20  # bytes of text in a group of ids
PART = 16 << 20  # bytes of text for each partition of a shuffle
ENTRIES = 125_000  # windows in a range of hashes: many ranges a partition, so that partitions are even
MARKS = "grp int, ids binary, hashes binary"
MARKS_ARROW = pa.schema([("grp", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary())])
U = np.uint64


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def groups_for(size: int) -> int:
    return max(1, size // GROUP) | 1


def parts_for(size: int) -> int:
    """Partitions of the shuffles: they follow the bytes, so that no task grows with the input."""
    return max(4, size // PART)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """Groups of ids, by a hash: ids in strides fill all groups alike."""
    return (mix(ids.view(U)) % U(groups)).astype(np.int64)


def mark_rows(ids: np.ndarray, hashes: np.ndarray, groups: int, of: np.ndarray | None = None) -> list[dict]:
    """Marks (id, hash), a row for each group of ids."""
    of = group_of(ids, groups) if of is None else of
    order = np.lexsort((hashes, ids, of))
    of, ids, hashes = of[order], ids[order], hashes[order]
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    return [
        {"grp": int(of[s]), "ids": packed.planes(ids[s:e].view(U)), "hashes": hashes[s:e].astype("<u8").tobytes()}
        for s, e in zip(cuts, np.append(cuts[1:], len(of)))
    ]


def settle(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by (hash, id) -> which is the first of its hash, and which has a smaller id before it."""
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    least = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    return first, ids != least


def sealed(docs: DataFrame, id_col: str, text_col: str, groups: int) -> DataFrame:
    """grp, id and the compressed text: what goes through the last shuffle. Rows without an id are dealt by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, 1):
            texts = [t or b"" for t in b.column(1).to_pylist()]
            key = [zlib.crc32(t) if i is None else i for i, t in zip(b.column(0).cast(pa.int64()).to_pylist(), texts)]
            grp = pa.array(group_of(np.array(key, np.int64), groups).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), grp, pa.array([z.compress(t) for t in texts], pa.binary())], ["id", "grp", "z"])

    schema = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("grp int, z binary").fields])
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int, size: int, groups: int) -> DataFrame:
    """Marks: the windows of each document that a document of a smaller id has too."""
    bits = packed.bits_for(size / 6, ENTRIES)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in packed.chunks(batches, CHUNK):
            hashes, counts = words_of(texts)
            hashes, n = word_windows(hashes, counts, window)
            owner = np.repeat(ids, n)
            order = np.argsort(hashes, kind="stable")  # ids ascend within a hash
            hashes, owner = hashes[order], owner[order]
            first, later = settle(hashes, owner)
            rows = list(packed.pack(hashes[first], owner[first], bits))
            # what is marked already goes along, under a bucket of its own
            rows += [{"bucket": -1 - m["grp"], "n": 0, "base": 0, "subs": b"", "low": m["hashes"], "ids": m["ids"]} for m in mark_rows(owner[later], hashes[later], groups)]
            if rows:
                yield packed.batch_of(rows)

    def count(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        if not rows or rows[0]["bucket"] < 0:
            return pa.Table.from_pylist([{"grp": -1 - r["bucket"], "ids": r["ids"], "hashes": r["low"]} for r in rows], MARKS_ARROW)
        parts = [packed.unpack(r, bits) for r in rows]
        hashes, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, hashes))
        hashes, ids = hashes[order], ids[order]
        _, later = settle(hashes, ids)
        return pa.Table.from_pylist(mark_rows(ids[later], hashes[later], groups), MARKS_ARROW)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(entries, packed.SCHEMA)
    return rows.repartition(parts_for(size), "bucket").groupBy("bucket").applyInArrow(count, MARKS)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, n_spans, kept_sha256 (and, if asked for, the kept text) of each row."""
    text_batches(docs.sparkSession)
    size = total_bytes(docs, text_col)
    groups = groups_for(size)
    marks = repeated_windows(docs, id_col, text_col, window, size, groups)
    fields = [(id_col, None), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        texts = [z.decompress(x) for x in left.column("z").to_pylist()]
        raw = left.column("id").combine_chunks() if left.num_rows else pa.array([], left.schema.field("id").type)
        ids = np.array([0 if i is None else i for i in raw.to_pylist()], np.int64)
        known = np.array([i is not None for i in raw.to_pylist()], bool)
        marks = [np.frombuffer(h, "<u8") ^ mix(packed.from_planes(i)) for i, h in zip(right.column("ids").to_pylist(), right.column("hashes").to_pylist())]
        wanted = np.unique(np.concatenate(marks)) if marks else np.zeros(0, U)
        hashes, counts = words_of(texts) if texts else (np.zeros(0, U), np.zeros(0, int))
        windows, n = word_windows(hashes, counts, window)
        keys = windows ^ np.repeat(mix(ids.view(U)), n)
        at = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
        hit = (wanted[at] == keys) & np.repeat(known, n) if len(wanted) else np.zeros(len(keys), bool)
        # word places of the marked windows; +1 where a window starts, -1 past its end
        first_word, first_window = np.cumsum(counts) - counts, np.cumsum(n) - n
        start = np.flatnonzero(hit)
        start = start + np.repeat(first_word - first_window, n)[start]
        step = np.zeros(len(hashes) + window + 1, np.int32)
        np.add.at(step, start, 1)
        np.add.at(step, start + window, -1)
        covered = np.cumsum(step)[: len(hashes)] > 0
        out = {k: [] for k in ("n_words", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for text, s, c in zip(texts, first_word, counts):
            gone = covered[s : s + c]
            words = text.split()
            kept = b" ".join(compress(words, ~gone) if gone.any() else words)
            out["n_words"].append(int(c))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode() if with_text else None)
        cols = [raw] + [pa.array(out[k], t) for k, t in fields[1:]]
        names = [k for k, _ in fields]
        if with_text:
            cols, names = [*cols, pa.array(out["kept_text"], pa.string())], [*names, "kept_text"]
        return pa.Table.from_arrays(cols, names)

    schema = row_schema([docs.schema[id_col]], "n_words long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    texts, marks = (x.repartition(parts_for(size), "grp").groupBy("grp") for x in (sealed(docs, id_col, text_col, groups), marks))
    return texts.cogroup(marks).applyInArrow(remove, schema)


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, hash(list_slice(words, i, i + 12)) AS h, list_slice(words, i, i + 12) AS w
  FROM split, unnest(generate_series(1, len(words) - 12)) AS g(i)
), marked AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, w) AS least FROM windows) WHERE doc_id > least
), covered AS (
  SELECT DISTINCT doc_id, i + k AS place FROM marked, unnest(generate_series(0, 12)) AS g(k)
), gone AS (
  SELECT doc_id, list(place) AS places, count(*) AS n_removed FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       CAST(len(list_filter(coalesce(places, []), lambda p: NOT list_contains(places, p - 1))) AS BIGINT) AS n_spans,
       sha256(array_to_string(list_transform(list_filter(list_zip(words, generate_series(1, len(words))),
              lambda p: NOT list_contains(coalesce(places, []), p[2])), lambda p: p[1]), ' ')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""
