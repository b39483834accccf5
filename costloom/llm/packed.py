"""Packed tables of (hash, id) entries: how window hashes travel between Spark stages.

A row holds the entries of one chunk of documents for one range of hashes (`bucket`, the leading
bits), so a shuffle moves six or seven bytes of each hash and the low bytes of ids instead of whole
rows. Every hash is sent; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SCHEMA = "bucket int, n int, base long, subs binary, low binary, ids binary"
ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("base", pa.int64()), ("subs", pa.binary()), ("low", pa.binary()), ("ids", pa.binary())])


def bits_for(entries: float, per_bucket: int = 500_000) -> int:
    """Leading bits such that a bucket has about per_bucket entries; 256 buckets at least."""
    return max(8, min(30, int(np.ceil(np.log2(max(1.0, entries / per_bucket))))))


def _layout(bits: int) -> tuple[int, int]:
    """Further leading bits that are sent as counts, and low bytes that are sent as they are."""
    sub = 8 - bits % 8
    return sub, (64 - bits - sub) // 8


def planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit integers by significance, so that those that are all zero compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack(hashes: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[dict]:
    """hashes ascending, ids (int64) alongside -> a row for each bucket that has entries."""
    sub, low = _layout(bits)
    bucket = (hashes >> U(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for s, e in zip(cuts, np.append(cuts[1:], len(bucket))):
        h, i = hashes[s:e], ids[s:e]
        base = int(i.min())
        subs = np.bincount(((h >> U(64 - bits - sub)) & U((1 << sub) - 1)).astype(np.int64), minlength=1 << sub)
        yield {
            "bucket": int(bucket[s]), "n": int(e - s), "base": base, "subs": subs.astype("<u4").tobytes(),
            "low": h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes(), "ids": planes((i - base).view(U)),
        }


def unpack(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    sub, low = _layout(bits)
    h = np.zeros((row["n"], 8), np.uint8)
    h[:, :low] = np.frombuffer(row["low"], np.uint8).reshape(-1, low)
    tops = np.repeat(np.arange(1 << sub, dtype=U), np.frombuffer(row["subs"], "<u4"))
    top = U(row["bucket"]) << U(sub) | tops
    return h.view("<u8").ravel() | top << U(64 - bits - sub), from_planes(row["ids"]).astype(np.int64) + row["base"]


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ARROW)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of about `size` bytes, by id. A null id comes in no chunk, a null text as empty."""
    ids, texts, held = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if i is not None:
                    ids.append(i)
                    texts.append(t or b"")
                    held += len(texts[-1]) + 1
                if held >= size:
                    yield _by_id(ids, texts)
                    ids, texts, held = [], [], 0
    if ids:
        yield _by_id(ids, texts)


def _by_id(ids: list[int], texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    a = np.array(ids, np.int64)
    order = np.argsort(a, kind="stable")
    return a[order], [texts[k] for k in order]
