"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree: at each node it is shared
among the children by weight, and no child gets more than its subtree can give (its tokens times the
allowed epochs). What a full child can't take goes to its siblings first; since a node never
gets more than its subtree holds, a shortage reaches an ancestor's siblings only when all of the
node's own children are full. A leaf takes whole epochs and then the token-prefix of one more, in an
order that the seed and the epoch's number fix.

The prefix needs no sort of a leaf: tokens are summed by 4,096 ranges of the order, the range in which
the budget runs out is found from the sums, and only that range is ordered. So a source with
a third of all rows is never met in one task. Tables by leaf are broadcast only after a count.

The tree itself is filled by windows over the children of one node: all domains, then the languages of a domain and
the sources of a language. It may have as many leaves as a task can sort (millions), whatever they hold.

Defined cases: null domains, languages, sources count as ''; a null or empty text has no tokens and
takes the place its id gives it; rows repeating an id share its place; a document in
which the budget runs out is taken whole; an empty table gives an empty result; a budget over what all
epochs hold takes all of them. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from costloom.llm.common import small, written

LEVELS = ("domain", "lang", "source")
RANGES = 12  # bits of the order that are summed at first
DOMAINS = 3


def default_domain(source: str = "source") -> Column:
    """The given tables have no domains: sources are dealt to three by a hash of their name."""
    return F.concat(F.lit("d"), F.crc32(F.coalesce(F.col(source).cast("string"), F.lit("")).cast("binary")) % DOMAINS)


def default_tokens(text: str = "text") -> Column:
    """An estimate: a token for each four bytes begun."""
    return F.ceil(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) / 4)


def leaf_columns(domain: Column, lang: str, source: str) -> list[Column]:
    by = {"domain": domain, "lang": F.col(lang), "source": F.col(source)}
    return [F.coalesce(by[k].cast("string"), F.lit("")).alias(f"__{k}") for k in LEVELS]


def place(id_col: str, seed: int, epoch: Column | str) -> Column:
    """Place of a document in its leaf's order: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(epoch) if isinstance(epoch, str) else epoch, F.col(id_col).cast("string")), 1)


def water_fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes: parent columns, child, budget (of the parent), cap, weight -> the same with `given`."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy("__level", child).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = nodes.withColumn("__level", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    x = x.withColumn("__caps", F.sum("cap").over(order) - F.col("cap"))
    x = x.withColumn("__rest", F.sum("weight").over(by) - F.sum("weight").over(order) + F.col("weight"))
    x = x.withColumn("__full", F.col("cap") * F.col("__rest") <= (F.col("budget") - F.col("__caps")) * F.col("weight"))
    x = x.withColumn("__open", F.sum(F.when(~F.col("__full"), F.col("weight")).otherwise(0.0)).over(by))
    x = x.withColumn("__left", F.col("budget") - F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0.0)).over(by))
    share = F.when(F.col("__open") > 0, F.least("cap", F.greatest(F.lit(0.0), F.col("__left")) * F.col("weight") / F.col("__open"))).otherwise(0.0)
    return x.withColumn("given", F.when(F.col("__full"), F.col("cap")).otherwise(share)).select(*nodes.columns, "given")


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(f"__{level}") == value, float(w)).otherwise(out)
    return out


def leaf_targets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves: a row per leaf with its tokens -> the same with `target` tokens."""
    keys = [f"__{k}" for k in LEVELS]
    total = leaves.agg((F.sum("tokens") * share).alias("budget"))
    above = None
    for depth in range(1, len(keys) + 1):
        nodes = leaves.groupBy(*keys[:depth]).agg((F.sum("tokens") * float(epochs)).alias("cap"))
        nodes = nodes.crossJoin(F.broadcast(total)) if above is None else nodes.join(above, keys[: depth - 1])  # one row
        nodes = nodes.withColumn("weight", weight_of(LEVELS[depth - 1], weights))
        filled = water_fill(nodes, keys[: depth - 1], keys[depth - 1])
        above = filled.select(*keys[:depth], F.col("given").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "target"), keys)


def leaf_cuts(docs: DataFrame, share: float, epochs: int, seed: int, weights: dict, domain: Column, tokens: Column, id_col: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The narrow table of documents, and a row per leaf: whole epochs and where the last prefix ends."""
    keys = [f"__{k}" for k in LEVELS]
    narrow = written(docs.select(F.col(id_col).alias("__id"), *leaf_columns(domain, lang, source), tokens.cast("long").alias("tokens")))
    leaves = narrow.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    targets = leaf_targets(leaves, share, epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    leaf = targets.withColumn("whole", whole).select(*keys, "whole", (F.col("target") - F.col("whole") * F.col("tokens")).alias("part")).checkpoint()
    placed = narrow.join(small(leaf), keys).withColumn("place", place("__id", seed, "whole"))
    placed = placed.withColumn("range", F.shiftright("place", 63 - RANGES))
    sums = placed.groupBy(*keys, "range").agg(F.sum("tokens").alias("tokens"), F.first("part").alias("part"))
    run = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("before", F.sum("tokens").over(run) - F.col("tokens"))
    # the last range whose start is still inside the prefix
    edge = sums.filter("before < part").groupBy(*keys).agg(F.max(F.struct("range", "before")).alias("e"))
    edge = edge.select(*keys, F.col("e.range").alias("edge"), F.col("e.before").alias("before")).checkpoint()
    inside = placed.join(small(edge), keys).filter("range = edge")
    by_place = W.partitionBy(*keys).orderBy("place", "__id").rangeBetween(W.unboundedPreceding, W.currentRow)
    order = inside.groupBy(*keys, "place", "__id").agg(F.sum("tokens").alias("tokens"), F.first("part").alias("part"), F.first("before").alias("before"))
    order = order.withColumn("start", F.col("before") + F.sum("tokens").over(by_place.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens"))
    last = order.filter("start < part").groupBy(*keys).agg(F.max("place").alias("last_place"))
    return narrow, leaf.join(last, keys, "left").checkpoint()


def _copies(seed: int, id_col: str) -> Column:
    in_prefix = F.coalesce(place(id_col, seed, "whole") <= F.col("last_place"), F.lit(False))
    return F.col("whole") + in_prefix.cast("long")


def mix(docs: DataFrame, share: float = 0.5, epochs: int = 2, seed: int = 1, weights: dict | None = None, domain: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", lang: str = "lang", source: str = "source", text_col: str = "text") -> DataFrame:
    """A row per document: id, domain, lang, source, tokens, copies (0: not taken)."""
    domain = default_domain(source) if domain is None else domain
    tokens = default_tokens(text_col) if tokens is None else tokens
    narrow, cuts = leaf_cuts(docs, share, epochs, seed, weights or {}, domain, tokens, id_col, lang, source)
    keys = [f"__{k}" for k in LEVELS]
    out = narrow.join(small(cuts), keys).withColumn("copies", _copies(seed, "__id"))
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__{k}").alias(k) for k in LEVELS], "tokens", "copies")


def take_mix(docs: DataFrame, share: float = 0.5, seed: int = 1, weights: dict | None = None, domain: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", lang: str = "lang", source: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that one epoch at most gives, all columns as they were."""
    domain = default_domain(source) if domain is None else domain
    tokens = default_tokens(text_col) if tokens is None else tokens
    _, cuts = leaf_cuts(docs, share, 1, seed, weights or {}, domain, tokens, id_col, lang, source)
    boxed = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), *leaf_columns(domain, lang, source))
    return boxed.join(small(cuts), [f"__{k}" for k in LEVELS]).filter(_copies(seed, "__id") > 0).select("__row.*")
