"""Blocks of documents and keys that several blocks share.

Documents are dealt by ranges of ids into blocks of bounded bytes, packed with
zstandard. The packed table is shuffled to its blocks once; plans that use it
again share that exchange. A block offers its distinct keys, sorted, in one row per
bucket of the key space, so a key costs a bucket one entry per block that holds
it, however often it occurs; the answer is one bit per entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bounds, parts_for, plan_bytes, utf8
from .rolling import U

BLOCK_BYTES = 4 << 20
#: Stands for a null id.
NO_ID = -(2**63)
OFFER = "bucket int, block int, keys binary, flags binary"
ANSWER = "block int, bucket int, step int, bits binary"


class Layout:
    """``count`` blocks of documents, ``buckets`` of the key space; what tasks need of ``Blocks``."""

    def __init__(self, count: int, buckets: int):
        self.count, self.buckets = count, buckets

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> U(32)) * U(self.buckets)) >> U(32)).astype(np.int64)

    def offer(self, block: int, keys: np.ndarray, payload: np.ndarray, flags: np.ndarray) -> pd.DataFrame:
        """Rows of OFFER for distinct ascending ``keys``; ``payload``: their bytes, one row each; ``flags``: one bit each."""
        cuts = np.searchsorted(self.bucket_of(keys), np.arange(self.buckets + 1))
        rows = [
            (k, block, payload[a:b].tobytes(), np.packbits(flags[a:b]).tobytes())
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
            if b > a
        ]
        return pd.DataFrame(rows, columns=["bucket", "block", "keys", "flags"])

    def answered(self, answers: pd.DataFrame, step: int, keys: np.ndarray) -> np.ndarray:
        """The answer bits of a step, in the order of the offered keys."""
        cuts = np.searchsorted(self.bucket_of(keys), np.arange(self.buckets + 1))
        out = np.zeros(len(keys), bool)
        own = answers[answers["step"] == step] if len(answers) else answers
        for bucket, bits in zip(own["bucket"].astype(int), own["bits"]) if len(own) else ():
            a, b = cuts[bucket], cuts[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return out

    def texts(self, pdf: pd.DataFrame) -> tuple[list, list[bytes]]:
        """(ids, texts) of a block in the order of ids, rows of one id by text."""
        z = zstandard.ZstdDecompressor()
        raw = [z.decompress(p) for p in pdf["packed"]]
        order = sorted(range(len(raw)), key=lambda i: (pdf["doc_id"].iat[i], raw[i]))
        return [int(pdf["doc_id"].iat[i]) for i in order], [raw[i] for i in order]


class Blocks(Layout):
    """``packed``: (block, doc_id, packed text), dealt by block."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        count = parts_for(plan_bytes(docs), block_bytes, 2 * docs.sparkSession.sparkContext.defaultParallelism)
        super().__init__(count, max(1, count // 4))
        bounds = id_bounds(source, "doc_id", self.count)

        def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdCompressor(level=1)
            for b in rows:
                ids = b.column(0).fill_null(NO_ID)
                at = np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32)
                packed = [z.compress(utf8(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(at), ids, pa.array(packed, pa.binary())], ["block", "doc_id", "packed"])

        self.packed = source.mapInArrow(pack, "block int, doc_id long, packed binary").repartition(self.count, "block")

    def detached(self) -> Layout:
        """The layout without Spark's tables, for use inside tasks."""
        return Layout(self.count, self.buckets)


def entries(pdf: pd.DataFrame, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, block, flag) of a bucket's offers, rows in order of blocks."""
    pdf.sort_values("block", inplace=True)
    parts = [np.frombuffer(k, dtype) for k in pdf["keys"]]
    sizes = [len(p) for p in parts]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for f, n in zip(pdf["flags"], sizes)]
    return np.concatenate(parts), np.repeat(pdf["block"].to_numpy(), sizes), np.concatenate(flags)


def answer_rows(pdf: pd.DataFrame, dtype, step: int, bits: np.ndarray) -> pd.DataFrame:
    """Rows of ANSWER that split ``bits`` by the offers of ``pdf`` (as sorted by ``entries``)."""
    sizes = pdf["keys"].map(len).to_numpy() // np.dtype(dtype).itemsize
    ends = np.cumsum(sizes)
    packed = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "step": step, "bits": packed})


def groups(sorted_parts: list[np.ndarray]) -> np.ndarray:
    """Group number of every row of sorted columns."""
    if not len(sorted_parts[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(sorted_parts[0]), bool)
    for c in sorted_parts:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


SEGMENT = 1 << 20
_PLACE = U((1 << 22) - 1)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest hash in every window of ``w`` hashes, the leftmost of equals.

    Hashes are compared by their upper 42 bits, so the choice depends on the
    window's content alone, whatever is around it. Minima of windows of 1, 2, 4, ... hashes
    come from two of half the width each, those of ``w`` from two that overlap.
    """
    m = len(h) - w + 1
    out = np.empty(max(0, m), np.int64)
    for a in range(0, max(0, m), SEGMENT):
        key = h[a : min(a + SEGMENT, m) + w - 1] & ~_PLACE
        key |= np.arange(len(key), dtype=np.uint64)
        n, width = len(key) - w + 1, 1
        while 2 * width <= w:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        least = np.minimum(key[:n], key[w - width : w - width + n])
        least &= _PLACE
        out[a : a + n] = least.view(np.int64)
        out[a : a + n] += a
    return out
