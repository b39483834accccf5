"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (up to three preceding bytes). A byte's code
length is that of the longest context that has seen it; where a context has not, its escape
probability (method C: distinct / (total + distinct)) is paid and the next shorter one is asked, down
to the uniform order. The trees are counted in Spark on training rows and then frozen; a text's score
for a language is its exact code length in bits over all its normalised bytes, and the shortest wins.

Training rows: text and label not null and crc32(id as text) mod 4 not 2. `per_language` bounds the
sample: a language with more training rows is thinned by a hash of the id to that many in expectation.
The statistics are small because the sample is; they, and nothing else, reach the driver. They grow with the
number of labels (about half a megabyte each for pairs of bytes); there is no cap on that.

The score is the weight of the shortest code among all, from the difference of mean code lengths a byte
(times SHARPNESS), so that it tells close calls from clear ones at any length.

Normalising: lower case, every ASCII byte but letters a blank, runs of blanks one blank.

Defined cases: text null or without a letter gives `und` with score 0; ties go to the first language by
name; without training rows every text is `und`; repeated rows each give a row; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from costloom.llm.common import opened, row_schema, shipped, slices, small, text_batches

ORDER = 3
PER_LANGUAGE = 400
SHARPNESS = 4.0  # bits of difference a byte and more, in the score
REJECT_BITS = 7.5  # a byte; text of the learned languages takes about three
PIECE = 1 << 18
_TO_BLANK = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_TO_BLANK).split())


def grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it, as one integer; a text begins after three blanks."""
    a = np.frombuffer(b"   " + data, np.uint8).astype(np.uint32)
    return a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:]


def training_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int) -> DataFrame:
    known = docs.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).alias("lang"), F.col(text_col).alias("text"))
    shares = known.groupBy("lang").agg((F.lit(per_language) / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return known.join(small(shares), "lang").filter(place < F.col("share")).select("lang", "text")


class Trees:
    """Frozen statistics of all languages, resolved to code lengths (bits) by language."""

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, gram (four bytes), n."""
        self.langs = sorted(counts["lang"].unique())
        k = len(self.langs)
        lang = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        one = np.zeros((k, 256))
        np.add.at(one, (lang, gram & 0xFF), n)
        total, kinds = one.sum(1, keepdims=True), (one > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            order0 = np.where(one > 0, -np.log2(one / (total + kinds)), -np.log2(kinds / (total + kinds)) + 8)  # k, 256
        two = np.zeros((k, 1 << 16))
        np.add.at(two, (lang, gram & 0xFFFF), n)
        two = two.reshape(k, 256, 256)
        total, kinds = two.sum(2), (two > 0).sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape1 = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            seen = -np.log2(two / (total + kinds)[:, :, None])
        self.two = np.where(two > 0, seen, escape1[:, :, None] + order0[:, None, :]).reshape(k, -1).T.copy()
        self.contexts2, self.escape2, self.keys3, self.three = self._longer(
            lang, gram & 0xFFFFFF, n, lambda key: self.two[key & 0xFFFF]
        )
        self.contexts3, self.escape3, self.keys4, self.four = self._longer(lang, gram, n, self._cost3)

    def _longer(self, lang, key, n, shorter):
        """Contexts, their escape lengths, keys and their code lengths of one order."""
        k = len(self.langs)
        keys, at = np.unique(key, return_inverse=True)
        count = np.zeros((len(keys), k))
        np.add.at(count, (at, lang), n)
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
        np.add.at(total, of, count)
        np.add.at(kinds, of, (count > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            seen = -np.log2(count / (total + kinds)[of])
        return contexts, escape, keys, np.where(count > 0, seen, escape[of] + shorter(keys))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _cost3(self, gram: np.ndarray) -> np.ndarray:
        g = gram & 0xFFFFFF
        at, hit = self._find(self.keys3, g)
        out = self.three[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            c, known = self._find(self.contexts2, g[miss] >> 8)
            out[miss] = self.two[g[miss] & 0xFFFF] + np.where(known[:, None], self.escape2[c], 0)
        return out

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each byte by language."""
        at, hit = self._find(self.keys4, gram)
        out = self.four[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            c, known = self._find(self.contexts3, gram[miss] >> 8)
            out[miss] = self._cost3(gram[miss]) + np.where(known[:, None], self.escape3[c], 0)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text by language, from pieces of bounded size."""
        out = np.zeros((len(texts), len(self.langs)))
        piece, owners, size = [], [], 0

        def flush():
            lengths = [len(p) for p in piece]
            cost = self.cost(np.concatenate(piece).astype(np.int64))
            starts = np.cumsum([0, *lengths[:-1]])
            np.add.at(out, owners, np.add.reduceat(cost, starts, axis=0))

        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                g = grams(t[at : at + PIECE]) if at == 0 else grams(t[at - 3 : at + PIECE])[3:]
                piece.append(g)
                owners.append(i)
                size += len(g)
                if size >= PIECE:
                    flush()
                    piece, owners, size = [], [], 0
        if piece:
            flush()
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Trees | None:
    """Counts the training sample's contexts in Spark and freezes them; None without training rows."""
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for lang, texts in b.to_pandas().groupby("lang")["text"]:
                g, n = np.unique(np.concatenate([grams(normalised(t)) for t in texts]), return_counts=True)
                if len(g):
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(g), "gram": g.astype(np.int64), "n": n.astype(np.int64)})

    sample = training_rows(docs, id_col, text_col, label_col, per_language)
    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counted.toArrow().to_pandas()
    return Trees(counts) if len(counts) else None


def judged(model: Trees | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and bits a byte of each text."""
    plain = [normalised(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits = model.bits(plain)
    known = np.array([bool(p) for p in plain], bool)
    each = bits / np.maximum(1, [len(p) for p in plain])[:, None]
    least = each.min(1)
    score = 1 / np.exp2(np.maximum(SHARPNESS * (least[:, None] - each), -1000)).sum(1)
    return [model.langs[i] if k else "und" for i, k in zip(bits.argmin(1), known)], np.where(known, score, 0.0), least


def identify(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Of each row: `keep` columns (the id unless said), lang_pred, score, bits_per_byte."""
    text_batches(docs.sparkSession)
    keep = keep or [id_col]
    shared = shipped(docs.sparkSession, trees)  # its size is bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for b in slices(batches, len(keep)):
            lang, score, bits = judged(model, b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], schema.names)

    schema = row_schema([docs.schema[c] for c in keep], "lang_pred string, score double, bits_per_byte double")
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, trees: Trees | None, text_col: str = "text", reject_bits: float = REJECT_BITS) -> DataFrame:
    """docs without the rows that have no language: `und`, or no learned language codes them well.

    A row goes through Python once, with its text as one of its columns; columns go by place, so names may be any.
    """
    text_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, trees)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for b in slices(batches, at):
            lang, _, bits = judged(model, b.column(at).to_pylist())
            yield b.filter(pa.array([x != "und" and n <= reject_bits for x, n in zip(lang, bits)], pa.bool_()))
        pa.default_memory_pool().release_unused()

    plain = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    return docs.toDF(*[f.name for f in plain]).mapInArrow(run, StructType(plain)).toDF(*docs.columns)
