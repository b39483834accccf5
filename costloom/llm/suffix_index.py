"""Suffix-array dedup with a logarithmic family of sparse suffix arrays.

Which 400-byte strings occur more than once, anywhere?

Suffixes. Of a text's suffixes, those are indexed that start at an anchor: for each 400-byte string, the start of its
least 64-byte gram by hash (the leftmost of equal ones). Equal strings have the same anchor at the same
offset, so no match is lost, and about one suffix in 170 is kept. Strings in a row that share an anchor form a
run; its context is all bytes that its strings cover, 736 at most.

Family. Documents come in batches. A batch's array has a row for each distinct suffix start (16 bytes, then the
hash of 64), in the order of these bytes, with the least and largest context hash and the number of runs. It is
stored as a level: a table that is bucketed and sorted by the start, so that levels meet bucket by bucket
without a shuffle. Each batch is merge-scanned against every level before it is added: a start that both have is
a match, in one context or in several. After that, levels of equal rank merge into one of the next rank, so n
batches leave at most log2(n) + 1 levels and rewrite a row log2(n) times. A passage in a third of all documents is one
row of a level, combined before the shuffle.

Long matches. If all runs of a matched start have one context, every string of theirs is repeated. Otherwise one
run of each distinct context gives its bytes, contexts with the same start meet, and which of their 400-byte strings
agree is found there. Starts with over HOT contexts are not met in one task: contexts are cut into pieces by what
their strings share, finer where that is still too common, down to strings that Spark counts.

Identity. A run counts as repeated only if hashes of its start and of its context agree, 128 bits; strings
agree if their hash and that of their start do.

Defined cases: a null text counts as empty; texts under 400 bytes are kept whole; matches never cross
documents; rows that repeat an id are documents of their own; a null id takes part like any other; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.llm.common import delete, hot_keys, new_path, row_schema, slices, small, spread_join, text_batches, written
from costloom.llm.hashing import U, bytes_sums, mix, sliding_argmin, spans_hash, window_starts, windows_hash
from costloom.llm.substring import parts_for, total_bytes

WIDTH = 400
GRAM = 64
HEAD = 16
BATCH = 128 << 20  # bytes of text in a batch
FEWEST, MOST = 4, 32  # batches
SEGMENT = 1 << 20  # bytes that are hashed at once
GROUP = 1 << 20  # bytes of text in a group of documents
TOGETHER = 2000  # contexts that are compared at once
HOT = 250  # contexts of one key that may meet in a task
STEPS = (42, 6)  # places of strings in a piece, where there are more
START = ["head", "gram"]


def batches_for(size: int) -> int:
    return max(FEWEST, min(MOST, size // BATCH))


def runs_of(texts: list[bytes], width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of texts: number of the text, head, gram, context, first start, anchor, last start."""
    parts = [(i, at, t[at : at + SEGMENT + width - 1]) for i, t in enumerate(texts) for at in range(0, len(t) - width + 1, SEGMENT)]
    while parts:
        size, some = 0, []
        while parts and size < SEGMENT:
            some.append(parts.pop())
            size += len(some[-1][2])
        yield _runs(some, width, gram)


def _runs(parts: list[tuple[int, int, bytes]], width: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    lengths = np.array([len(p) for _, _, p in parts])
    first = np.cumsum(lengths) - lengths
    sums = bytes_sums(data)
    grams = windows_hash(sums, gram)
    start, _ = window_starts(lengths, width)  # a start's anchor is in the same part
    anchor = sliding_argmin(grams, width - gram + 1)[start]
    cut = np.flatnonzero(np.diff(anchor)) + 1
    lo, hi = start[np.concatenate(([0], cut))], start[np.concatenate((cut - 1, [len(start) - 1]))]
    anchor = anchor[np.concatenate(([0], cut))]
    part = np.searchsorted(first, lo, "right") - 1
    shift = np.array([at for _, at, _ in parts]) - first
    head = np.lib.stride_tricks.sliding_window_view(data, HEAD)[anchor]
    context = spans_hash(sums, lo, hi + width) ^ mix((anchor - lo).astype(U))
    return np.array([i for i, _, _ in parts])[part], head, grams[anchor], context, lo + shift[part], anchor + shift[part], hi + shift[part]


def binary_rows(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text as bytes, and k1 and k2 (hashes of id and text) that tell documents apart, those of one id or none too."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(id_col).alias("k1"), F.xxhash64(text).alias("k2"))


def runs(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Runs of keyed texts: k1, k2, head, gram, ctx, lo, mid (the anchor, from lo), hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            k1, k2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for owner, head, start, context, lo, anchor, hi in runs_of(b.column(0).to_pylist(), width, gram):
                longs = [k1[owner], k2[owner], start.view(np.int64), context.view(np.int64)]
                ints = [x.astype(np.int32) for x in (lo, anchor - lo, hi)]
                cols = [pa.array(longs[0]), pa.array(longs[1]), binary_rows(head), *map(pa.array, [*longs[2:], *ints])]
                yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "head", "gram", "ctx", "lo", "mid", "hi"])

    long_enough = texts.filter(F.octet_length("text") >= width).select("text", "k1", "k2")
    return long_enough.mapInArrow(run, "k1 long, k2 long, head binary, gram long, ctx long, lo int, mid int, hi int")


class SuffixIndex:
    """The family of arrays. Rows of a level: head, gram, lo and hi (least and largest context; hi null if equal), n."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.live = spark, [], []  # (rank, table name, its folder)
        # as many buckets as a shuffle has partitions: what an aggregation gives is dealt out already
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _stored(self, rank: int, rows: DataFrame) -> tuple[int, str, str]:
        path = new_path(self.spark)
        name = path.rpartition("/")[2].replace("-", "_")
        rows.write.bucketBy(self.buckets, *START).sortBy(*START).option("path", path).saveAsTable(name)
        self.live.append((rank, name, path))
        return self.live[-1]

    def _gone(self, level: tuple[int, str, str]) -> None:
        self.spark.sql(f"DROP TABLE {level[1]}")
        delete(self.spark, level[2])
        self.live.remove(level)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: runs. Stores its array, scans it against all levels, adds it and merges levels of equal rank.

        Gives the matches: head, gram, lo (the only context, unless there are several), several, n (in this batch).
        """
        array = batch.groupBy(*START).agg(F.min("ctx").alias("lo"), F.max("ctx").alias("top"), F.count(F.lit(1)).alias("n"))
        new = self._stored(0, array.select(*START, "lo", F.nullif("top", "lo").alias("hi"), "n"))
        rows = self.spark.table(new[1])
        found = [rows.filter("n > 1").select(*START, "lo", F.col("hi").isNotNull().alias("several"), "n")]
        for _, name, _ in self.levels:
            old = self.spark.table(name).select(*START, F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
            same = (F.col("lo") == F.col("old_lo")) & F.col("hi").isNull() & F.col("old_hi").isNull()
            found.append(rows.join(old, START).select(*START, "lo", (~same).alias("several"), "n"))
        matches = written(reduce(DataFrame.unionByName, found))
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._stored(a[0] + 1, self.merged(self.spark.table(a[1]), self.spark.table(b[1]))))
            self._gone(a)
            self._gone(b)
        return matches

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two arrays as one: a sort-merge of their buckets."""
        x, y = (df.select(*START, *[F.col(c).alias(c + k) for c in ("lo", "hi", "n")]) for df, k in ((a, "1"), (b, "2")))
        lo, top = F.least("lo1", "lo2"), F.greatest("lo1", "lo2", "hi1", "hi2")
        n = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
        return x.join(y, START, "full").select(*START, lo.alias("lo"), F.nullif(top, lo).alias("hi"), n.alias("n"))

    def close(self) -> None:
        """Drops all tables, those of a batch that failed, too."""
        while self.live:
            self._gone(self.live[-1])
        self.levels.clear()


def matched_runs(texts: DataFrame, size: int, batches: int, width: int, gram: int) -> DataFrame:
    """The runs whose start occurs again, with `several`; those in one context only if it is theirs."""
    index, found = SuffixIndex(texts.sparkSession), []
    try:
        for k in range(batches):
            batch = texts.filter(F.pmod(F.xxhash64("k1", "k2"), F.lit(batches)) == k)
            found.append(index.add(runs(batch, width, gram)))
    finally:
        index.close()
    starts = reduce(DataFrame.unionByName, found).groupBy(*START).agg(F.min("lo").alias("only"), F.max("several").alias("several"), F.sum("n").alias("n"))
    starts = written(starts)
    rows = runs(texts, width, gram).withColumn("__by", F.xxhash64("k1", "k2", "lo"))
    both = spread_join(rows, starts.drop("n"), START, "__by", hot_keys(starts, START, count="n"))
    return written(both.filter((F.col("ctx") == F.col("only")) | F.col("several")).drop("only", "head", "__by"))


CONTEXT = "key long, gram long, ctx long, n long, mid int, shift int, body binary"
_CONTEXT = pa.schema([(k, t) for k, t in (("key", pa.int64()), ("gram", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("mid", pa.int32()), ("shift", pa.int32()), ("body", pa.binary()))])


def contexts(texts: DataFrame, picked: DataFrame, parts: int, width: int) -> DataFrame:
    """The bytes of each picked run's context, its start as key; texts and picked are dealt out by grp."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        z, rows = zstandard.ZstdDecompressor(), {k: [] for k in _CONTEXT.names}
        where = dict(zip(zip(left.column("k1").to_pylist(), left.column("k2").to_pylist()), left.column("z").to_pylist()))
        known, text = None, b""
        for r in sorted(right.to_pylist(), key=lambda r: (r["k1"], r["k2"])):
            if (r["k1"], r["k2"]) != known:
                known = r["k1"], r["k2"]
                text = z.decompress(where[known])
            for k, v in zip(rows, (r["gram"], r["gram"], r["ctx"], r["n"], r["mid"], 0, text[r["lo"] : r["hi"] + width])):
                rows[k].append(v)
        return pa.Table.from_pydict(rows, _CONTEXT)

    return texts.groupBy("grp").cogroup(picked.repartition(parts, "grp").groupBy("grp")).applyInArrow(cut, CONTEXT)


def split(rows: DataFrame, step: int, width: int) -> DataFrame:
    """Contexts in pieces of `step` places of strings, counted from the anchor; the key becomes what all strings of a piece share.

    Strings that agree are in pieces of the same place and core, so a start with very many contexts falls apart
    into keys by what is around it; at a step of 1 the core is the string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                out = {k: [] for k in _CONTEXT.names}
                for r in b.slice(at, TOGETHER).to_pylist():
                    body, mid = r["body"], r["mid"]
                    for k in range((0 - mid) // step, (len(body) - width - mid) // step + 1):  # places k * step ... from the anchor
                        first, last = k * step + mid, (k + 1) * step - 1 + mid
                        core = hashlib.blake2b(body[max(last, 0) : first + width] if step > 1 else body[first : first + width], digest_size=8)
                        core.update(b"%d %d %d" % (r["key"], k, step))
                        lo, hi = max(first, 0), min(last, len(body) - width)
                        row = (int.from_bytes(core.digest(), "little", signed=True), r["gram"], r["ctx"], r["n"], mid - lo, r["shift"] + lo, body[lo : hi + width])
                        for name, v in zip(out, row):
                            out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, _CONTEXT)

    return rows.mapInArrow(run, CONTEXT)


def strings_of(t: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """The strings of contexts: number of the context, place in it, and a mark of content, key and place from the anchor."""
    bodies = t.column("body").to_pylist()
    lengths = np.array([len(x) for x in bodies])
    first = np.cumsum(lengths) - lengths
    at, n = window_starts(lengths, width)
    owner = np.repeat(np.arange(len(bodies)), n)
    place = at - first[owner]
    hashes = windows_hash(bytes_sums(np.frombuffer(b"".join(bodies), np.uint8)), width)[at]
    key, mid = t.column("key").to_numpy().view(U), t.column("mid").to_numpy().astype(np.int64)
    return owner, place, hashes ^ mix(key[owner] + (place - mid[owner]).astype(U))


INTERVAL = "gram long, ctx long, lo int, hi int"


def repeated_in(t: pa.Table, width: int) -> pa.RecordBatch:
    """Intervals of the repeated strings of contexts, all those of a key being there."""
    owner, place, mark = strings_of(t, width)
    key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(mark, kind="stable")
    sorted_mark, sorted_key = mark[order], key[owner[order]]
    same = (sorted_mark[1:] == sorted_mark[:-1]) & (sorted_key[1:] == sorted_key[:-1])
    again = np.zeros(len(mark), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again |= n[owner] > 1  # a context that occurs again, with all its strings
    edge = np.concatenate(([True], owner[1:] != owner[:-1], [True]))
    lo = np.flatnonzero(again & (edge[:-1] | ~np.concatenate(([False], again[:-1]))))
    hi = np.flatnonzero(again & (edge[1:] | ~np.concatenate((again[1:], [False]))))
    gram, ctx, shift = (t.column(c).to_numpy()[owner[lo]] for c in ("gram", "ctx", "shift"))
    cols = [gram, ctx, (place[lo] + shift).astype(np.int32), (place[hi] + shift).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "ctx", "lo", "hi"])


def compared(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """Intervals of repeated strings: contexts of one key meet, many keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([], _CONTEXT)
        for b in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([b]).cast(_CONTEXT)])
            while held.num_rows > TOGETHER:
                cuts = np.flatnonzero(np.diff(held.column("key").to_numpy())) + 1
                if not len(cuts):
                    break
                cut = int(cuts[min(len(cuts) - 1, np.searchsorted(cuts, TOGETHER))])
                yield repeated_in(held.slice(0, cut), width)
                held = held.slice(cut)
        if held.num_rows:
            yield repeated_in(held, width)

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, INTERVAL)


def counted(strings: DataFrame) -> DataFrame:
    """The same for single strings, of which a key may have any number: Spark counts them."""
    strings = written(strings.select("key", "gram", "ctx", "n", "shift"))
    again = strings.groupBy("key").agg(F.sum("n").alias("total")).filter("total > 1").select("key")
    return strings.join(again, "key").select("gram", "ctx", F.col("shift").alias("lo"), F.col("shift").alias("hi"))


def repeated_strings(rows: DataFrame, hot: DataFrame, parts: int, width: int) -> DataFrame:
    """Intervals of repeated strings of contexts; keys in `hot` are split until they fit into a task, strings at last."""
    if hot.isEmpty():
        return compared(rows, parts, width)
    rows, out = written(rows), []
    for step in (*STEPS, 1):
        out.append(compared(rows.join(small(hot), "key", "left_anti"), parts, width))
        pieces = split(rows.join(small(hot), "key", "left_semi"), step, width)
        if step == 1:
            out.append(counted(pieces))
            break
        rows = written(pieces)
        hot = too_many(rows, "key")
        if hot.isEmpty():
            out.append(compared(rows, parts, width))
            break
    return reduce(DataFrame.unionByName, out)


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """gram, ctx, spans: of each context its intervals, those that touch as one. There are fewer than twice `width` of them."""
    kind = "array<struct<lo:int,hi:int>>"

    def put(done, x):
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (x["lo"] <= F.get(done, F.size(done) - 1)["hi"] + 1)
        longer = F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi")))
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(x))).cast(kind)

    rows = intervals.groupBy("gram", "ctx").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    return rows.withColumn("spans", F.aggregate("spans", F.array().cast(kind), put))


def too_many(rows: DataFrame, key: str) -> DataFrame:
    return written(rows.groupBy(F.col(key).alias("key")).count().filter(F.col("count") > HOT).select("key"))


def sealed(texts: DataFrame, groups: int, parts: int) -> DataFrame:
    """grp, k1, k2, id and the compressed text of each keyed text, dealt out by grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, 4):
            data = pa.array([z.compress(t) for t in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], data], ["id", "grp", "k1", "k2", "z"])

    rows = texts.withColumn("grp", group_of(groups)).select("id", "grp", "k1", "k2", "text")
    return rows.mapInArrow(run, row_schema([texts.schema["id"]], "grp int, k1 long, k2 long, z binary")).repartition(parts, "grp")


def group_of(groups: int):
    return F.pmod(F.xxhash64("k2", "k1"), F.lit(groups)).cast("int")


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int | None = None, with_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked for, the kept bytes) of each row."""
    text_batches(docs.sparkSession)
    size = total_bytes(docs, text_col)
    groups, parts = max(1, size // GROUP) | 1, parts_for(size)
    keyed_texts = keyed(docs, id_col, text_col)
    matched = matched_runs(keyed_texts, size, batches or batches_for(size), width, gram)
    one = F.min(F.struct("k1", "k2", "lo", "mid", "hi")).alias("r")
    picked = written(matched.filter("several").groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), one).select("gram", "ctx", "n", "r.*").withColumn("grp", group_of(groups)))
    texts = sealed(keyed_texts.filter(F.octet_length("text") >= width), groups, parts)
    rows = contexts(texts, picked, parts, width)
    intervals = repeated_strings(rows, too_many(picked, "gram"), parts, width)
    within = merged_intervals(intervals)
    hot = hot_keys(picked, ["gram", "ctx"], count="n")
    rows = matched.filter("several").withColumn("__by", F.xxhash64("k1", "k2", "lo"))
    some = spread_join(rows, within, ["gram", "ctx"], "__by", hot).select("k1", "k2", "lo", F.explode("spans").alias("s"))
    some = some.select("k1", "k2", (F.col("lo") + F.col("s.lo")).alias("lo"), (F.col("lo") + F.col("s.hi")).alias("hi"))
    spans = matched.filter("not several").select("k1", "k2", "lo", "hi").unionByName(some).withColumn("grp", group_of(groups))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        marked = right.select(["k1", "k2", "lo", "hi"]).to_pandas()
        marked = {k: (p["lo"].to_numpy(np.int64), p["hi"].to_numpy(np.int64)) for k, p in marked.groupby(["k1", "k2"])}
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for key, data in zip(zip(left.column("k1").to_pylist(), left.column("k2").to_pylist()), left.column("z").to_pylist()):
            text, (lo, hi) = z.decompress(data), marked.get(key, ((), ()))
            kept, n_spans = text, 0
            if len(lo):
                step = np.bincount(lo, minlength=len(text) + 1) - np.bincount(hi + width, minlength=len(text) + 1)
                gone = np.cumsum(step)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            for k, v in zip(out, (len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None)):
                out[k].append(v)
        fields = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_bytes]
        raw = left.column("id").combine_chunks() if left.num_rows else pa.array([], left.schema.field("id").type)
        return pa.Table.from_arrays([raw, *[pa.array(v, t) for v, t in zip(out.values(), fields)]], ["id", *list(out)[: len(fields)]])

    schema = row_schema([keyed_texts.schema["id"]], "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
    whole = texts.groupBy("grp").cogroup(spans.repartition(parts, "grp").groupBy("grp")).applyInArrow(remove, schema)
    # texts that are too short for a match need no shuffle, however many there are of them
    zero = F.lit(0).cast("long")
    short = keyed_texts.filter(F.octet_length("text") < width).select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").alias("kept")] * with_bytes
    )
    return whole.unionByName(short).withColumnRenamed("id", id_col)
