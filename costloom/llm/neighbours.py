"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Tree. Grown on a bounded sample (a hundredth of the vectors, 20,000 to 200,000, those of least hash): each node splits
its vectors by spherical k-means into `branch` children, down to bins whose expected share of all vectors is about
`bin_rows`, or four vectors of the sample: beyond 2.5 million vectors bins grow with the data. The tree is
broadcast. Every vector is then put into its bin.

Search. A query walks the tree with a priority queue of branches, nearest centre first, which orders the
bins. How many bins to visit is calibrated: for a bounded sample of queries the true neighbours are found by
an exact scan, visits widen until the bins that were visited hold at least `recall` of them, and every query
then visits that many, and goes on until the bins it visited hold k vectors of other ids. The recall reached on
the sample comes with the result. On vectors without clusters (the given ones: independent directions in 64
dimensions) no order of bins is much better than chance: half of all vectors are scored for a recall of 0.93.

Jobs. Neighbouring bins are put together into slabs of bounded size, and a larger bin is dealt over several
slabs; a slab meets blocks of the queries that visit its bins. So neither a bin with a third of all vectors nor
one that all queries visit is met whole, and a task sends on k rows for each query. Scores are exact
cosines of the original vectors in double precision, computed row by row so that equal vectors score
equally; ties go to the smaller id.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do those of
another length than the most frequent one (the longer of equally frequent ones); null ids take no part; rows
repeating an id are vectors of their own but never each other's neighbours; with fewer candidates than k,
all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from costloom.llm.common import opened, shipped, small, written

K = 5
SAMPLE, SAMPLE_SHARE, SAMPLE_MOST = 20_000, 100, 200_000  # vectors the tree is grown on: one in 100, within bounds
BRANCH = 8
BIN_ROWS = 50
SAMPLED_BIN = 4  # vectors of the sample for each bin at least
RECALL = 0.93  # 0.9 is needed; over CALIBRATION queries of five neighbours the standard error is below 0.01
CALIBRATION = 300
SLAB_ROWS = 20_000  # vectors in a slab
BLOCK = 500  # queries in a block


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles): the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (size["d"] if size else 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    def __init__(self, sample: np.ndarray, bins: int, branch: int = BRANCH, seed: int = 1):
        """sample: unit rows."""
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []  # by inner node
        self.children: list[list[tuple[bool, int]]] = []  # (is a bin, number)
        self.bins = 0
        per_bin = max(1, len(sample) // max(1, bins))
        self._grow(sample, per_bin, branch, rng)

    def _grow(self, x: np.ndarray, per_bin: int, branch: int, rng) -> tuple[bool, int]:
        start = np.unique(x[rng.choice(len(x), min(len(x), 4 * branch), replace=False)], axis=0) if len(x) > per_bin else x[:0]
        if len(start) < 2:
            self.bins += 1
            return True, self.bins - 1
        centres = start[rng.permutation(len(start))[:branch]]
        for _ in range(8):
            own = (x @ centres.T).argmax(1)
            sums = np.stack([x[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
        own = (x @ centres.T).argmax(1)
        used = np.unique(own)
        if len(used) < 2:
            self.bins += 1
            return True, self.bins - 1
        node = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[node] = [self._grow(x[own == c], per_bin, branch, rng) for c in used]
        return False, node

    def bin_of(self, x: np.ndarray) -> np.ndarray:
        """Bin of each unit row: down the nearest centres."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            own = (x[rows] @ self.centres[node].T).argmax(1)
            for c, (is_bin, number) in enumerate(self.children[node]):
                part = rows[own == c]
                if is_bin:
                    out[part] = number
                elif len(part):
                    todo.append((number, part))
        return out

    def visits(self, q: np.ndarray, most: int, size: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first `most` bins for a unit query, best first; more until they hold `least` vectors (size: of bins)."""
        if not self.centres:
            return [0][:most]
        queue, out, held = [(0.0, 0, False, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, _, is_bin, number = heapq.heappop(queue)
            if is_bin:
                out.append(number)
                held += 0 if size is None else int(size[number])
                continue
            for near, (child_bin, child) in zip(self.centres[number] @ q, self.children[number]):
                heapq.heappush(queue, (-float(near), child, child_bin, child))
        return out


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """(query id, id, score) of each query's k nearest among the rows, the query's own id left out.

    allowed: which rows each query looks at. A matrix product finds who may be among the nearest; those are
    scored again in a fixed order of additions.
    """
    out = []
    if not len(ids):
        return out
    ux, uq = unit(x), unit(q)
    rough = uq @ ux.T
    lengths = np.sqrt((x * x).sum(1))
    for i, query_id in enumerate(query_ids):
        open_rows = ids != query_id if allowed is None else (ids != query_id) & allowed[i]
        near = np.where(open_rows, rough[i], -np.inf)
        n = min(k, int(open_rows.sum()))
        if n:
            least = np.partition(near, len(near) - n)[len(near) - n]
            rows = np.flatnonzero(near >= least - 1e-9)
            score = exact_cosine(x[rows], lengths[rows], q[i], ux[rows], uq[i])
            for j in np.lexsort((ids[rows], -score))[:n]:
                out.append((int(query_id), int(ids[rows[j]]), float(score[j])))
    return out


def exact_cosine(x, lengths, q, ux, uq) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        score = (x * q).sum(1) / (lengths * np.sqrt((q * q).sum()))
    return np.where(np.isfinite(score) & (lengths > 1e-150) & (lengths < 1e150), score, (ux * uq).sum(1))


_BEST = "query_id long, vec_id long, score double"


def _best_table(rows) -> pa.Table:
    return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's candidates, with ranks. Spark keeps k a task before it shuffles."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def slabs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slab and number of slabs of each bin: bins in tree order share slabs of SLAB_ROWS vectors."""
    bins = len(size)
    first, parts, slab, held = np.zeros(bins, np.int64), np.ones(bins, np.int64), 0, 0
    for b in range(bins):
        if held and held + size[b] > SLAB_ROWS:
            slab, held = slab + 1, 0
        first[b], parts[b] = slab, max(1, -(-size[b] // SLAB_ROWS))
        held += size[b]
        if parts[b] > 1:
            slab, held = slab + parts[b], 0
    return first, parts


def exact_neighbours(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """Exact scan for a bounded number of queries: each task keeps its k best."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = best_of(b.column(0).to_numpy(), matrix(b.column(1)), *shared.value, k)
            yield from _best_table(rows).to_batches()

    return ranked(rows.mapInArrow(scan, _BEST), k)


def build(rows: DataFrame, total: int, sample: int | None = None, bin_rows: int = BIN_ROWS) -> Tree:
    sample = sample or min(SAMPLE_MOST, max(SAMPLE, total // SAMPLE_SHARE))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # a top-k: each task sends `sample` rows at most
    return Tree(unit(matrix(picked.column("v"))), max(1, min(total // bin_rows, picked.num_rows // SAMPLED_BIN)))


def calibrate(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> tuple[int, float]:
    """Bins to visit so that a sample of queries finds `recall` of its true neighbours; the recall reached."""
    picked = queries.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(CALIBRATION).toArrow()
    ids, q = picked.column("id").to_numpy(), matrix(picked.column("v"))
    truth = exact_neighbours(rows, (ids, q), k).select("query_id", F.col("vec_id").alias("id")).distinct()
    where = truth.join(rows, "id").select("query_id", "v").toArrow()  # k rows for each of CALIBRATION queries, but for repeated ids
    if not where.num_rows:
        return tree.bins, 1.0
    bins = tree.bin_of(unit(matrix(where.column("v"))))
    place = {int(i): {b: p for p, b in enumerate(tree.visits(v, tree.bins))} for i, v in zip(ids, unit(q))}
    needed = np.sort([place[int(i)][int(b)] + 1 for i, b in zip(where.column("query_id").to_numpy(), bins)])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def nearest(vectors: DataFrame, query_filter, k: int = K, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", sample: int | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score, recall (reached in calibration): the k nearest found for each row that query_filter (a condition on id) picks."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col))
    queries = rows.filter(query_filter)
    total = rows.count()
    if not total or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double")
    tree = build(rows, total, sample, bin_rows)
    visits, reached = calibrate(rows, queries, tree, k, recall)
    shared = shipped(spark, tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(shared)
        for b in batches:
            bins = known.bin_of(unit(matrix(b.column(1)))) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column(0), b.column(1)], ["bin", "id", "v"])

    placed = written(rows.mapInArrow(place, "bin int, id long, v array<double>"))
    size = np.zeros(tree.bins, np.int64)
    for r in placed.groupBy("bin").count().collect():  # a row per bin of a tree from a bounded sample
        size[r["bin"]] = r["count"]
    first, parts = slabs(size)
    where = F.broadcast(spark.createDataFrame([(b, int(first[b]), int(parts[b])) for b in range(tree.bins)], "bin int, first int, parts int"))
    left = placed.join(where, "bin").withColumn("slab", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(shared)
        for b in batches:
            ids, qs, own = (b.column(c).to_pylist() for c in range(3))
            out = {"slab": [], "id": [], "v": [], "bins": []}
            for i, v, n, q in zip(ids, qs, own, unit(matrix(b.column(1))) if ids else []):
                met: dict[int, list[int]] = {}
                for number in known.visits(q, visits, size, k + n):
                    for slab in range(first[number], first[number] + parts[number]):
                        met.setdefault(int(slab), []).append(number)
                for slab, bins in met.items():
                    for key, value in zip(out, (slab, i, v, bins)):
                        out[key].append(value)
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds)], list(out))

    repeats = queries.groupBy("id").agg(F.count(F.lit(1)).alias("own"))  # rows of an id, never each other's neighbours
    asked = written(queries.join(repeats, "id").select("id", "v", "own").mapInArrow(walk, "slab int, id long, v array<double>, bins array<int>"))
    loads = asked.groupBy("slab").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = asked.join(small(loads), "slab").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    left = left.join(small(loads), "slab").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _best_table([])
        own = a.column("bin").to_numpy()
        allowed = np.stack([np.isin(own, bins) for bins in b.column("bins").to_pylist()])
        return _best_table(best_of(a.column("id").to_numpy(), matrix(a.column("v")), b.column("id").to_numpy(), matrix(b.column("v")), k, allowed))

    found = left.select("slab", "block", "bin", "id", "v").groupBy("slab", "block").cogroup(asked.select("slab", "block", "bins", "id", "v").groupBy("slab", "block")).applyInArrow(score, _BEST)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score", F.lit(reached).alias("recall"))
