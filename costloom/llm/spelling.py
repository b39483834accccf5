"""Spelling variants: words one edit apart, found by search schemes on two FM-indexes, one for each direction.

Words. Runs of letters are read, changed and counted by built-in functions; only counts leave a task.

Search. Of two words one insertion, deletion or replacement apart, one has a half that the other starts or ends with.
A search matches the first half of a word exactly from its leading delimiter on and extends over the second half with at
most one error (index of the reversed vocabulary), or the second half from the closing delimiter back and over the first half
(index of the vocabulary). A state is an interval of suffix ranks; the two ends are moved by counts of the symbol among
the first ranks, for all states of a block of words at once. An error tries the symbols that stand before the
interval's suffixes, nothing else. A pair that shares the first half counts in the first search only.

Shards. Each word stands, with its count, where its halves lead: by the hash of each first and last half that a word of its length
or one more or less may have (four at most). Searches go where their own half leads, so a near pair always meets and no shard has to know
the vocabulary. A half that very many words share is dealt over several parts, to all of which its searches go; a word is found only through a half that led it to the shard, so once in all. A shard has about
SHARD symbols; searches stream past it in any number. Each sends on a count and its best word.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the checksum; repeated rows count each; in the order of forms
equal counts go to the smaller word by code points; every step of a chain of forms has ten times the count, so chains end (19
steps at most) and are followed level by level; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costloom.llm.common import small, stream_past, written

LEAST = 7  # code points of a word
TWICE = 2  # occurrences of a word
TIMES = 10  # a form has so many times the count
SHARD = 1 << 20  # symbols of a shard's vocabulary
HOT = 1 << 18  # symbols of words that share a half, and stay together
BLOCK = 1 << 20  # symbols of words that are searched at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"

ORACLE_SQL = f"""WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t FROM range(256) r(v)),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY ALL),
bytes_of AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(b, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes_of, crc),
changed AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM changed WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {TWICE}),
cuts AS MATERIALIZED (SELECT word, i, left(word, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest FROM words, unnest(generate_series(1, length(word))) g(i)),
near AS (SELECT DISTINCT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near JOIN words ON b = word GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n FROM words LEFT JOIN best ON word = a),
walk AS (SELECT word, form, word AS last FROM forms UNION ALL SELECT walk.word, forms.form, forms.word FROM walk JOIN forms ON forms.word = walk.form)
SELECT f.word, f.form, w.last AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms f JOIN walk w ON w.word = f.word AND w.form IS NULL"""


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters, lower case, one code point left out where the checksum says so."""
    long_runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{LEAST},}})"), F.lit(1))  # whole runs; shorter ones stay short
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(long_runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    place = (h % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = runs.select(F.when(h % 31 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TWICE)


class FMIndex:
    """Ranks of a text's suffixes. Symbols are whole numbers from 1; 0 delimits words and begins and ends the text."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        order = suffix_order(text)
        self.before = text[order - 1]  # the symbol before each suffix in the order of ranks
        by_symbol = np.argsort(self.before, kind="stable")
        self.places = self.before[by_symbol] * (self.n + 1) + by_symbol
        self.word = (np.cumsum(text == 0) - 1)[order]  # for a suffix that begins with a delimiter: the word after it
        self.symbols = int(text.max(initial=0)) + 1
        self.delimiters = int((text == 0).sum())

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol and go on as those of lo ... hi."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def symbols_before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol): the symbols but the delimiter that stand before each interval's suffixes."""
        width = hi - lo
        wide = np.flatnonzero(width > self.symbols)
        thin = np.where(width > self.symbols, 0, width)
        number = np.repeat(np.arange(len(lo)), thin)
        key = np.unique(number * self.symbols + self.before[np.repeat(lo - (np.cumsum(thin) - thin), thin) + np.arange(len(number))])
        number, symbol = np.concatenate((key // self.symbols, np.repeat(wide, self.symbols))), np.concatenate((key % self.symbols, np.tile(np.arange(self.symbols), len(wide))))
        return number[symbol > 0], symbol[symbol > 0]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling from ranks of as many symbols as a number holds."""
    n, text = len(text), text + 1  # 0 comes after the end
    bits = int(text.max(initial=1)).bit_length()
    width = max(1, min(62 // bits, n))
    padded = np.concatenate((text, np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key << bits | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        if new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key, width = rank * (n + 1) + after, width * 2


def one_error(index: FMIndex, patterns: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern number, word number in the index) of the words that are one edit after the first `exact` symbols away.

    patterns: a row of symbols each, all of one length, in the order in which they are matched (-1: not in the index).
    """
    rows, size = patterns.shape
    none = np.zeros(0, np.int64)

    def step(q, lo, hi, symbol):
        lo, hi = index.extend(symbol, lo, hi)
        live = (lo < hi) & (symbol >= 0)
        return q[live], lo[live], hi[live]

    sound = (np.arange(rows), np.zeros(rows, np.int64), np.full(rows, index.delimiters))
    for i in range(exact):
        sound = step(*sound, patterns[sound[0], i])
    wrong = (none, none, none)
    for i in range(exact, size + 1):
        q, lo, hi = sound
        number, symbol = index.symbols_before(lo, hi)
        other = symbol != patterns[q[number], i] if i < size else np.ones(len(number), bool)
        number, symbol = number[other], symbol[other]
        put_in = step(q[number], lo[number], hi[number], symbol)  # a symbol more, or in place of the next one
        wrong = join(wrong, put_in)
        if i == size:
            break
        wrong = step(*wrong, patterns[wrong[0], i])
        left_out = patterns[q, i] != patterns[q, i + 1] if i + 1 < size else np.ones(len(q), bool)  # the last one of a run only
        wrong = join(join(wrong, put_in), (q[left_out], lo[left_out], hi[left_out]))
        sound = step(*sound, patterns[q, i])
    q, lo, _ = step(*wrong, np.zeros(len(wrong[0]), np.int64))
    key = np.unique(q * (index.delimiters + 1) + index.word[lo])
    return key // (index.delimiters + 1), key % (index.delimiters + 1)


def join(*states):
    return tuple(map(np.concatenate, zip(*states)))


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Vocabulary:
    """Words with their counts, indexed from both ends."""

    def __init__(self, words: list[str], counts: list[int], kinds: list[int], halves: list[int]):
        """A word comes once for each half (kind: first or last; length) that led it here, and is found through these halves only."""
        n = dict(zip(words, counts))
        self.words = sorted(n)  # by code points
        self.n = np.array([n[w] for w in self.words], np.int64)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        number = {w: i for i, w in enumerate(self.words)}
        at, kind = np.array([number[w] for w in words]), np.array(kinds)
        self.led = np.zeros((len(self.words), 2, 2), bool)
        self.led[at, kind, np.array(halves) - self._shorter(self.lengths[at], kind)] = True
        points = code_points(self.words)
        self.alphabet, symbols = np.unique(points, return_inverse=True)
        text = np.zeros(len(points) + len(self.words) + 1, np.int64)
        text[np.arange(len(points)) + np.repeat(np.arange(len(self.words)), self.lengths) + 1] = symbols + 1
        self.from_end, self.from_start = FMIndex(text), FMIndex(text[::-1].copy())

    @staticmethod
    def _shorter(lengths: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
        """A word's half, if it had a symbol less."""
        return (lengths - 1 + kind) // 2

    def near(self, words: list[str], last_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in words, number in self.words): near words with the same first half; or the same last half, but not the first."""
        lengths = np.array([len(w) for w in words])
        out = [(np.zeros(0, np.int64),) * 2]
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            each = max(1, BLOCK // int(size))
            for s in range(0, len(at), each):
                part = at[s : s + each]
                points = code_points([words[i] for i in part]).reshape(len(part), -1)
                place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
                symbols = np.where(self.alphabet[place] == points, place + 1, -1)
                half = int(size) // 2
                if last_half:
                    q, w = one_error(self.from_end, symbols[:, ::-1], int(size) - half)
                    fresh = np.array([not self.words[j].startswith(words[part[i]][:half]) for i, j in zip(q, w)], bool)
                    q, w = q[fresh], w[fresh]
                else:
                    q, w = one_error(self.from_start, symbols, half)
                    w = len(self.words) - 1 - w
                kind = int(last_half)
                led = self.led[w, kind, (int(size) + kind) // 2 - self._shorter(self.lengths[w], kind)]
                out.append((part[q[led]], w[led]))
        return join(*out)


_FOUND = "word string, n_near long, form string, form_n long"


def _halves(word: Column, lengths: list[Column]) -> Column:
    """Halves (kind and text) of the word, if it were of each of the lengths: its first and its last symbols."""
    sizes = F.filter(F.array(*lengths), lambda m: m >= LEAST)
    first = F.array_distinct(F.transform(sizes, lambda m: F.struct(F.lit(0).alias("kind"), F.floor(m / 2).cast("int").alias("size"), F.substr(word, F.lit(1), F.floor(m / 2).cast("int")).alias("half"))))
    last = F.array_distinct(F.transform(sizes, lambda m: F.struct(F.lit(1).alias("kind"), F.ceil(m / 2).cast("int").alias("size"), F.substr(word, F.length(word) - F.ceil(m / 2).cast("int") + 1).alias("half"))))
    return F.explode(F.concat(first, last)).alias("key")


def near_words(words: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n: of each word (a stored table of word, n) its number of near words and the most frequent of these."""
    n = F.length("word")
    keyed = words.select("word", "n", _halves(F.col("word"), [n - 1, n, n + 1])).select("word", "n", "key.*")
    asked = words.select("word", _halves(F.col("word"), [n])).select("word", "key.*")
    sizes = keyed.groupBy("kind", "half").agg(F.sum(n + 1).alias("symbols"))
    shared = written(sizes.filter(F.col("symbols") > hot).select("kind", "half", F.ceil(F.col("symbols") / hot).cast("int").alias("parts")))
    total = keyed.agg(F.sum(n + 1).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard), min(words.sparkSession.sparkContext.defaultParallelism, total // (shard // 16)))
    parts = F.coalesce("parts", F.lit(1))
    place = lambda part: F.pmod(F.xxhash64("kind", "half", part), F.lit(shards)).cast("int")
    index = keyed.join(small(shared), ["kind", "half"], "left").select(place(F.pmod(F.xxhash64("word"), parts).cast("int")).alias("shard"), "word", "n", "kind", "size")
    searches = asked.join(small(shared), ["kind", "half"], "left").select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), parts - 1), place))).alias("shard"), "word", "kind")

    def start(rows: pa.Table):
        known = Vocabulary(*(rows.column(c).to_pylist() for c in ("word", "n", "kind", "size")))

        def search(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            kind, words = b.column("kind").to_numpy(), b.column("word").to_pylist()
            q, w = join(*[(at[q], w) for k in (0, 1) for at in [np.flatnonzero(kind == k)] for q, w in [known.near([words[i] for i in at], k == 1)]])
            order = np.lexsort((w, -known.n[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            best = w[first]
            columns = ([words[i] for i in q[first]], np.diff([*first, len(q)]), [known.words[i] for i in best], known.n[best])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], ["word", "n_near", "form", "form_n"])

        return search

    found = stream_past(index, searches, shards, start, _FOUND)
    best = F.min(F.when(F.col("form_n").isNotNull(), F.struct((-F.col("form_n")).alias("k"), "form"))).alias("best")
    rows = found.withColumn("n", F.lit(None).cast("long")).unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n")))
    summed = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.k")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root to a stored table of word, form, ...: level by level from the words without a form."""
    level = forms.filter("form is null").withColumn("root", F.col("word"))
    out = level
    linked = forms.filter("form is not null")
    while True:
        above = level.select(F.col("word").alias("form"), "root")
        level = written(linked.join(above, "form"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word with its form, the most frequent near word if it is frequent enough."""
    near = near_words(written(counted_words(docs, id_col, text_col)), shard, hot)
    enough = F.col("form_n") >= TIMES * F.col("n")
    forms = written(near.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
