"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character, so a merge never
crosses from a character to a following marker. A text therefore splits into chunks (markers, then
other characters) that are encoded independently: each distinct chunk of a batch is segmented once by
the sentencepiece library, and its ids are joined back by position. Vocabularies for which this does
not hold are refused. There is no shuffle: the table is built where the text is read, and the
part kept between batches has a fixed size.

Defined cases: a null text counts as empty; an empty text gives just the begin and end ids; repeated
rows each give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costloom.llm.common import row_schema, slices, text_batches

MARK = "▁"
PIECE = 1 << 18  # bytes of text that are encoded at once
TABLE_CHUNKS = 100_000  # chunks kept between batches; a bound of memory, not of what is encoded


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_vocabulary(sp) -> None:
    """Raises unless chunks of this vocabulary can be encoded on their own."""
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace marker; chunks can't be encoded on their own")
    odd = "a  b "
    if sp.encode(odd) != sp.encode("a") + sp.encode(" b") + [sp.piece_to_id(MARK)]:
        raise ValueError("the model changes white space; chunks can't be encoded on their own")


_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class ChunkTable:
    """Distinct chunk -> ids. A chunk begins with one marker or more."""

    def __init__(self, sp):
        self.sp, self.ids, self.lone = sp, {}, [sp.piece_to_id(MARK)]

    def add(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text; new ones are segmented, each once."""
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids) > TABLE_CHUNKS:
            self.ids.clear()
        new = [c for c in set(itertools.chain.from_iterable(cut)) if c not in self.ids]
        # the library puts one marker before what it is given
        self.ids.update(zip(new, self.sp.encode([c[1:] for c in new], num_threads=1)))
        self.ids[MARK] = self.lone
        return cut

    def encode(self, texts: list[str]) -> list[list[int]]:
        get, ends = self.ids.__getitem__, (self.sp.bos_id(), self.sp.eos_id())
        return [[ends[0], *itertools.chain.from_iterable(map(get, c)), ends[1]] for c in self.add(texts)]


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, ids (if asked for), n_tokens, ids_sha256, decoded_sha256 of each row."""
    text_batches(docs.sparkSession)
    check_vocabulary(processor(model))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        chunks = ChunkTable(sp)
        for b in slices(batches, 1, PIECE):
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                all_ids = chunks.encode([t or "" for t in part.column(1).to_pylist()])
                out = {
                    "n_tokens": pa.array([len(i) for i in all_ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in all_ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(sp.decode(i).encode()).hexdigest() for i in all_ids]),
                }
                ids = {"ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {}
                yield pa.RecordBatch.from_pydict({id_col: part.column(0)} | ids | out)

    schema = row_schema([docs.schema[id_col]], "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
