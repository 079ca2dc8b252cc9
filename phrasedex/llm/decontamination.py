"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
A document is contaminated by a benchmark item if, in some alignment, ``WINDOW``
consecutive tokens of both agree but for at most ``SUBSTITUTIONS``; an item of
``SHORT`` to WINDOW - 1 tokens must be there whole but for one token, one of
``LEAST`` to SHORT - 1 tokens whole. Items of one to three tokens are words that any
text may hold; they are no evidence and match nothing.

Every mask names the positions that count; the others are ignored. Together the
three masks leave at least one hit in every window with three substitutions (all
455 patterns are covered), and four tokens in a row in every short item with
one, so no overlap is missed. Seeds are looked for where the documents are read, through a
Bloom filter of the benchmark's seeds of bounded size (``FILTER_BITS``; a fuller filter lets
more through, never less). What passes is joined with the seeds; each alignment
that a shared seed names is verified on the token hashes around it.

Defined cases: null or empty texts, of either table, match nothing; rows that
repeat an id are separate rows (equal pairs are reported once); a null id is
reported as any other; ``remove_contaminated`` decides by the text alone, so null and
repeated ids are judged by their own texts; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasedex.session import shared_dir

from .common import release, table, utf8
from .rolling import U, batches, joined_words, mix, separators

WINDOW, SUBSTITUTIONS, SHORT, LEAST = 15, 3, 8, 4
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10))
SHORT_MASK = (0, 1, 2, 3)
FILTER_BITS = 1 << 29
NOT_TOKEN = separators(bytes(i for i in range(128) if not chr(i).isalnum()))


def seeds(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the masked tokens at every position where the mask fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, U(number + 1), np.uint64)
    for o in mask:
        out = out * U(0xD6E8FEB86659FD93) + tokens[o : o + n]
    return mix(out)


def _item_seeds(items: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            keys, hashes, offsets = [], [], []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = np.frombuffer(raw, np.uint64)
                masks = [(SHORT_MASK, len(MASKS))] if len(t) < WINDOW else [(m, i) for i, m in enumerate(MASKS)]
                for mask, number in masks if len(t) >= LEAST else []:
                    h = seeds(t, mask, number)
                    hashes.append(h.view(np.int64))
                    offsets.append(np.arange(len(h)))
                    keys += [key] * len(h)
            flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(flat(hashes), pa.int64()), pa.array(flat(offsets), pa.int64())], ["item_key", "seed", "offset"])

    return items.select("item_key", "tokens").mapInArrow(run, "item_key long, seed long, offset long")


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_key, item_id, tokens): one row per different (id, text)."""

    @F.pandas_udf("binary")
    def tokens(s: pd.Series) -> pd.Series:
        return pd.Series([joined_words([utf8(t)], NOT_TOKEN, True)[1].tobytes() for t in s])

    b = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    return b.select(F.xxhash64("item_id", "t").alias("item_key"), "item_id", tokens("t").alias("tokens"))


def _bloom(item_seeds: DataFrame) -> np.ndarray:
    """Bit array with two bits per seed; at most FILTER_BITS bits come to the driver, however many seeds there are."""
    n = item_seeds.count()
    bits = 1 << 20
    while bits < min(FILTER_BITS, 64 * n):
        bits *= 2
    at = lambda shift: F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit(bits - 1))
    hit = item_seeds.select(F.explode(F.array(at(0), at(32))).alias("b"))
    words = hit.groupBy(F.shiftrightunsigned("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if bits <= 1 << 26 else out


def _passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    if bloom.dtype == bool:
        m = U(len(bloom) - 1)
        return bloom[h & m] & bloom[(h >> U(32)) & m]
    m = U(64 * len(bloom) - 1)
    ok = np.ones(len(h), bool)
    for b in (h & m, (h >> U(32)) & m):
        ok &= (bloom.view(np.uint64)[b >> U(6)] >> (b & U(63)) & U(1)).astype(bool)
    return ok


def _regions(docs: DataFrame, bloom, short_items: bool) -> DataFrame:
    """(doc_id, start, tokens, hits): stretches of a document around seeds that pass the filter."""
    masks = [*enumerate(MASKS), *([(len(MASKS), SHORT_MASK)] if short_items else [])]
    schema = "doc_id long, start long, tokens binary, hits array<struct<seed: long, at: long>>"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids, texts = b.column(0), [utf8(t) for t in b.column(1).to_pylist()]
            for lo, hi in batches(texts):
                _, h, _, _, first = joined_words(texts[lo:hi], NOT_TOKEN, True)
                found = []
                for number, mask in masks:
                    s = seeds(h, mask, number)
                    at = np.flatnonzero(_passes(bloom.value, s))
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + mask[-1] < first[doc + 1]
                    found.append((at[inside], s[at[inside]].view(np.int64), doc[inside]))
                at, s, doc = (np.concatenate(x) for x in zip(*found))
                if not len(at):
                    continue
                order = np.lexsort((at, doc))
                at, s, doc = at[order], s[order], doc[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * WINDOW)]
                out = []
                for a, z in zip(np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(at)]):
                    d0, d1 = first[doc[a]], first[doc[a] + 1]
                    r0, r1 = max(d0, at[a] - WINDOW), min(d1, at[z - 1] + 2 * WINDOW)
                    hits = [{"seed": x, "at": y} for x, y in zip(s[a:z].tolist(), (at[a:z] - r0).tolist())]
                    out.append((ids[lo + int(doc[a])].as_py(), int(r0 - d0), h[r0:r1].tobytes(), hits))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "tokens", "hits"])
        release()

    return docs.mapInArrow(run, schema)


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """(most equal tokens in a window, its first token in ``doc``) of an alignment, or (0, -1) where no window qualifies.

    ``diagonal``: position in ``doc`` of the item's first token.
    """
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    window = min(WINDOW, len(item))
    need = window - (SUBSTITUTIONS if window == WINDOW else 1 if window >= SHORT else 0)
    if hi - lo < window or window < LEAST:
        return 0, -1
    same = np.r_[0, np.cumsum(doc[lo:hi] == item[lo - diagonal : hi - diagonal])]
    sums = same[window:] - same[:-window]
    k = int(sums.argmax())
    return (int(sums[k]), lo + k) if sums[k] >= need else (0, -1)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, equal_tokens, first_token) of every contaminated document and item."""
    spark = docs.sparkSession
    path = shared_dir(spark, "benchmark-items")
    _items(benchmark, item_id_col, item_text_col).write.parquet(path)
    items = spark.read.parquet(path)
    item_seeds = _item_seeds(items)
    bloom = spark.sparkContext.broadcast(_bloom(item_seeds))
    short_items = items.where(F.octet_length("tokens").between(8 * LEAST, 8 * (WINDOW - 1))).limit(1).count() > 0
    path = shared_dir(spark, "seed-regions")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _regions(source, bloom, short_items).withColumn("region", F.xxhash64("doc_id", "start", "tokens")).write.parquet(path)
    regions = spark.read.parquet(path)
    hits = regions.select("region", F.inline("hits"))
    lines = hits.join(item_seeds, "seed").select("region", "item_key", (F.col("at") - F.col("offset")).alias("diagonal")).distinct()

    @F.pandas_udf("struct<equal_tokens: int, at: long>")
    def verify(doc: pd.Series, item: pd.Series, diagonal: pd.Series) -> pd.DataFrame:
        found = [best_overlap(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64), int(g)) for d, i, g in zip(doc, item, diagonal)]
        return pd.DataFrame(found, columns=["equal_tokens", "at"])

    around = regions.select("region", "doc_id", "start", F.col("tokens").alias("doc_tokens"))
    v = lines.join(around, "region").join(items, "item_key")
    v = v.withColumn("v", verify("doc_tokens", "tokens", "diagonal")).where("v.equal_tokens > 0")
    first = F.col("start") + F.col("v.at")
    best = F.max_by(F.struct(F.col("v.equal_tokens").alias("n"), first.alias("p")), F.struct("v.equal_tokens", -first))
    out = v.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", F.col("b.n").cast("int").alias("equal_tokens"), F.col("b.p").alias("first_token"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, by their texts: equal texts share a verdict, whatever their ids."""
    # Empty texts match nothing; without a hash they meet no other row.
    key = F.when(F.octet_length(F.col(text_col).cast("string")) > 0, F.xxhash64(F.col(text_col).cast("string")))
    texts = docs.select(key.alias("text_hash"), F.col(text_col).alias("text")).where("text_hash is not null")
    bad = find_overlaps(texts, benchmark, "text_hash", "text").select(F.col("doc_id").alias("__bad_text")).distinct()
    return docs.join(bad, key == F.col("__bad_text"), "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
