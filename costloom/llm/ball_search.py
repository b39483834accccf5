"""Exact top-k by integer inner product: a ball tree for each shard, searched by branch and bound.

Vectors become whole numbers, floor(scale * x). Shards are dealt by a hash of the row, so they are of bounded size
whatever repeats. The task that holds a shard builds its ball tree once (splits at the median of the projection on the
line through two far points, so a node of equal vectors splits, too) and lets all queries stream past, a batch at a
time. A node's upper bound is q . centre + |q| * radius.

Branch and bound. The tree is walked by levels for a batch of queries; a node whose bound is below a query's current
kth score is closed for that query. The leaves that stay open are visited in order of their bounds until the next
bound is below the kth score, which rises with each leaf. The current kth score is shared between shards: every
query first meets the SEED vectors of largest norm (they lead where norms differ), takes its kth score there
along to all shards, and a shard sends on only what reaches it.

What moves: each vector once, each query once for each shard, and at most k rows back for each query and shard. The
result is exact at any size; on vectors without structure no tree closes much, and the work is that of all products,
queries times rows, as for any exact search. The seed's query vectors and the shards are bounded; nothing else is held.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those with a component
that scale * x takes out of the doubles; null ids take no part; a query meets vectors of its own length only (others
have no inner product with it); an empty vector scores 0 with other empty ones; rows repeating an id are queries and
vectors of their own but never each other's candidates; ties go to the smaller id; with fewer candidates than k, all
are returned; products that may pass 2**53 are summed as Python integers, and scores beyond 64 bits are held at the
limits; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from costloom.llm.common import opened, shards_for, shipped, stream_past, written

K = 5
SCALE = 256
LEAF = 256
SEED = 2048
SHARD_BYTES, LEAST_SHARD = 64 << 20, 2 << 20
BLOCK = 2048  # queries that walk a tree at once
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1
_OUT = "query_id long, query_row long, vec_id long, score long"

ORACLE_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) as doubles: whole numbers, exact at any size."""
    y = lambda x: x * float(scale)
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(y(x)) < EXACT, F.floor(y(x)).cast("double")).otherwise(y(x)))


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: the vectors that take part, as whole numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
    return rows.filter(F.forall("v", fine))


def by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        part = column.take(pa.array(at)) if len(at) < len(column) else column
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))


class BallTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray):
        """x: rows of whole numbers. All leaves are at one depth, of LEAF rows at most."""
        depth = max(0, int(np.ceil(np.log2(max(1.0, len(x) / LEAF)))))
        parts, self.levels = [np.arange(len(x))], []
        for level in range(depth + 1):
            if level:
                parts = [half for p in parts for half in self._halves(x, p)]
            centres = np.stack([x[p].mean(0) for p in parts])
            radii = np.array([np.sqrt(((x[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centres)])
            self.levels.append((centres, radii))
        parts = [p[np.argsort(ids[p], kind="stable")] for p in parts]
        self.bounds = np.cumsum([0, *map(len, parts)])
        order = np.concatenate(parts)
        self.x, self.ids = x[order], ids[order]
        self.largest = np.abs(x).max(initial=0.0)

    @staticmethod
    def _halves(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = x[rows]
        far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        line = own[((own - far) ** 2).sum(1).argmax()] - far
        order = rows[np.argsort(own @ line, kind="stable")]
        return order[: len(order) // 2], order[len(order) // 2 :]

    def search(self, q: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of the k best for each query that reach its floor, best first. Own ids are left out."""
        if self.largest * np.abs(q).max(initial=0.0) * max(1, q.shape[1]) >= EXACT:
            return self._exact(q, query_ids, k)
        norm = np.sqrt((q * q).sum(1))
        kth = floor.astype(float)
        open_ = np.ones((len(q), 1), bool)
        for level, (centres, radii) in enumerate(self.levels):
            upper = q @ centres.T + norm[:, None] * radii
            upper += 1 + np.abs(upper) * 1e-9  # more than all rounding
            open_ = (np.repeat(open_, 2, axis=1) if level else open_) & (upper >= kth[:, None])
        upper = np.where(open_, upper, -np.inf)
        order = np.argsort(-upper, axis=1, kind="stable")
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            best = upper[np.arange(len(q)), leaf]
            going = np.flatnonzero((best >= kth) & (best > -np.inf))
            if not len(going):
                break
            found = [held]
            by_leaf = going[np.argsort(leaf[going], kind="stable")]
            for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                s, e = self.bounds[leaf[group[0]]], self.bounds[leaf[group[0]] + 1]
                score = q[group] @ self.x[s:e].T
                row, column = np.nonzero((score >= kth[group][:, None]) & (self.ids[None, s:e] != query_ids[group][:, None]))
                found.append((group[row], self.ids[s:e][column], score[row, column]))
            held = best_of(*map(np.concatenate, zip(*found)), k)
            count = np.bincount(held[0], minlength=len(q))
            full = count >= k
            last = np.cumsum(count) - 1
            kth[full] = np.maximum(kth[full], held[2][last[full]])
        return held[0], held[1], np.round(held[2]).astype(np.int64)

    def _exact(self, q: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every product, in Python integers: for components beyond what doubles add up exactly."""
        rows = [[int(c) for c in r] for r in self.x]
        out = []
        for i, v in enumerate(q):
            v = [int(c) for c in v]
            scores = [(-max(LEAST, min(MOST, sum(a * b for a, b in zip(v, r)))), int(j)) for j, r in zip(self.ids, rows) if j != query_ids[i]]
            out += [(i, j, -s) for s, j in sorted(scores)[:k]]
        return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def best_of(number: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score and then id, in order of the queries."""
    order = np.lexsort((ids, -score, number))
    number = number[order]
    first = np.searchsorted(number, number)
    order = order[np.arange(len(order)) - first < k]
    return np.sort(number, kind="stable")[np.arange(len(number)) - first < k], ids[order], score[order]


def forest(ids: np.ndarray, column) -> dict[int, BallTree]:
    """A tree for each length of vectors."""
    return {x.shape[1]: BallTree(x, ids[at]) for at, x in by_length(column)}


def answers(trees: dict[int, BallTree], query_ids: np.ndarray, column, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) for a column of query vectors."""
    out = [(np.zeros(0, np.int64),) * 3]
    for at, q in by_length(column):
        if tree := trees.get(q.shape[1]):
            for s in range(0, len(at), BLOCK):
                part = at[s : s + BLOCK]
                number, ids, score = tree.search(q[s : s + BLOCK], query_ids[part], floor[part], k)
                out.append((part[number], ids, score))
    return tuple(map(np.concatenate, zip(*out)))


def top_products(vectors: DataFrame, query_filter, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products for each row that query_filter (a condition on id) picks."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col, scale))
    size = rows.agg(F.sum(F.size("v") * 8 + 8).alias("n")).first()["n"] or 0
    shards = shards or shards_for(spark, size, SHARD_BYTES, LEAST_SHARD)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # the same whenever the table is read again within a plan
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    seeds = rows.orderBy(F.desc(norm), "id").limit(SEED).toArrow()  # a top-k: each task sends SEED rows at most
    shared = shipped(spark, forest(seeds.column("id").to_numpy(), seeds.column("v")))

    def meet_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = opened(shared)
        for b in batches:
            number, _, score = answers(trees, b.column(0).to_numpy(), b.column(1), np.full(b.num_rows, LEAST), k)
            floor = np.full(b.num_rows, LEAST)
            full = np.bincount(number, minlength=b.num_rows) >= k
            least = np.full(b.num_rows, MOST)
            np.minimum.at(least, number, score)
            floor[full] = least[full]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], ["id", "v", "row", "floor"])

    asked = numbered.filter(query_filter).mapInArrow(meet_seeds, "id long, v array<double>, row long, floor long")

    def start(index: pa.Table):
        trees = forest(index.column("id").to_numpy(), index.column("v"))

        def search(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            query_ids, query_rows = b.column("id").to_numpy(), b.column("row").to_numpy()
            number, ids, score = answers(trees, query_ids, b.column("v"), b.column("floor").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query_ids[number], query_rows[number], ids, score)], ["query_id", "query_row", "vec_id", "score"])

        return search

    index = numbered.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    queries = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = stream_past(index, queries, shards, start, _OUT)
    w = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
