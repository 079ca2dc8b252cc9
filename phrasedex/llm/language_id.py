"""Language identification by prediction by partial matching.

Per language, a variable-order tree of byte contexts (orders 0 to ``MAX_ORDER``)
with escape probabilities (method C: a context seen T times with D different
successors gives a successor seen c times c / (T + D) and the escape D / (T + D);
an unseen context costs nothing to leave). Statistics are frozen after training,
so the code length of a byte is a fixed function of the bytes before it. A text
gets the language with the shortest exact code length over all its bytes; the
score is that language's posterior under equal priors.

The classifier is fitted on a bounded sample: per language the
``docs_per_lang`` training documents with the smallest hash of the id among those
of at most ``max_train_bytes`` bytes. Everything is scored whole, in blocks.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so
is every text when no language could be learned; ties go to the language first
in code point order; rows are scored one by one, so repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, table, utf8

MAX_ORDER = 4
DOCS_PER_LANG = 200
MAX_TRAIN_BYTES = 16_384
UNDETERMINED = "und"
#: A text that costs more under every language is in none of them.
MAX_BITS_PER_BYTE = 7.0
BLOCK = 1 << 18
#: Context before the first byte of a text.
START = b"\n" * MAX_ORDER
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    m = _LETTER.search(text) if text else None
    while m and not m.group().isalpha():
        m = _LETTER.search(text, m.end())
    return m is not None


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams that end at bytes MAX_ORDER, MAX_ORDER + 1, ... of ``data``."""
    size = len(data) - MAX_ORDER
    code = np.zeros(size, np.uint64)
    for k in range(n):
        at = MAX_ORDER - n + 1 + k
        code = (code << np.uint64(8)) | data[at : at + size]
    return code


class Codes:
    """Row numbers of a fixed set of codes, by open addressing."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(4 * len(codes)).bit_length())
        size = 1 << self.bits
        self.rows = np.full(size, -1, np.int32)
        self.keys = np.zeros(size, np.uint64)
        left, slot = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = self.rows[slot] < 0
            put, where = left[free], slot[free]
            self.rows[where] = put  # of several codes in a slot, the last stays
            self.keys[where] = codes[put]
            lost = self.rows[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (size - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where unknown."""
        slot = self._slot(codes)
        rows = self.rows[slot]
        open_ = np.flatnonzero((self.keys[slot] != codes) & (rows >= 0))
        while len(open_):
            at = (slot[open_] + 1) & (len(self.rows) - 1)
            slot[open_] = at
            rows[open_] = self.rows[at]
            open_ = open_[(self.keys[at] != codes[open_]) & (rows[open_] >= 0)]
        return rows


@dataclass
class PpmModel:
    """``cost[k]``: bits of the last byte of each known (k+1)-gram per language; ``leave[k]``: escape bits of that gram as a context."""

    langs: list[str]
    tables: list
    cost: list
    leave: list

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length per byte and language; ``data`` begins with MAX_ORDER bytes of context."""
        return self._bits(data, MAX_ORDER, None)

    def _bits(self, data, order, at):
        codes = _grams(data, order + 1)
        if at is not None:
            codes = codes[at]
        if order == 0:
            return self.cost[0][codes.astype(np.int64)]
        rows = self.tables[order].find(codes)
        out = self.cost[order][rows]
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            where = miss if at is None else at[miss]
            shorter = self._bits(data, order - 1, where)
            context = codes[miss] >> np.uint64(8)
            if order == 1:
                shorter += self.leave[0][context.astype(np.int64)]
            else:
                known = self.tables[order - 1].find(context)
                shorter += np.where(known[:, None] >= 0, self.leave[order - 1][known], np.float32(0))
            out[miss] = shorter
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths, one row per text, one column per language."""
        out = np.zeros((len(texts), len(self.langs)))
        pieces, owners, size = [], [], 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), BLOCK):
                pieces.append((START if a == 0 else t[a - MAX_ORDER : a]) + t[a : a + BLOCK])
                owners.append(i)
                size += len(pieces[-1])
                if size >= BLOCK:
                    self._add(out, pieces, owners)
                    pieces, owners, size = [], [], 0
        if pieces:
            self._add(out, pieces, owners)
        return out

    def _add(self, out: np.ndarray, pieces: list[bytes], owners: list[int]) -> None:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        bits = self.bits(data)
        ends = np.cumsum([len(p) for p in pieces])
        # Row j belongs to byte j + MAX_ORDER; the context bytes of a piece are not counted.
        bits[_context_rows(ends)] = 0
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(bits.astype(np.float64), np.minimum(starts, len(bits) - 1), axis=0)
        np.add.at(out, owners, sums)


def _context_rows(ends: np.ndarray) -> np.ndarray:
    """Rows, between two pieces, that stand for context bytes of the next piece."""
    return (ends[:-1, None] - MAX_ORDER + np.arange(MAX_ORDER)[None, :]).ravel()


def count_grams(texts: list[bytes]) -> bytes:
    """Counts of all (k+1)-grams, k = 0..MAX_ORDER, of a language's training texts, as an npz file."""
    grams = [[] for _ in range(MAX_ORDER + 1)]
    for t in texts:
        data = np.frombuffer(START + t, np.uint8)
        for k in range(MAX_ORDER + 1):
            grams[k].append(_grams(data, k + 1))
    out = io.BytesIO()
    arrays = {}
    for k, parts in enumerate(grams):
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        arrays[f"codes{k}"], arrays[f"n{k}"] = codes, n
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def build_model(counts: dict[str, bytes]) -> PpmModel:
    """Freeze the statistics of every language into one table of code lengths per order."""
    langs = sorted(counts)
    data = {lang: np.load(io.BytesIO(counts[lang])) for lang in langs}
    tables, costs, leaves, known = [], [], [], []
    # Every gram's context and its shorter form are rows too; those of START occur only as such.
    rows = [np.arange(256, dtype=np.uint64)] * (MAX_ORDER + 2)
    rows[MAX_ORDER + 1] = np.empty(0, np.uint64)
    for k in range(MAX_ORDER, 0, -1):
        longer = rows[k + 1]
        shorter = longer & np.uint64((1 << (8 * (k + 1))) - 1)
        rows[k] = np.unique(np.concatenate([*(data[x][f"codes{k}"] for x in langs), longer >> np.uint64(8), shorter]))
    for k in range(MAX_ORDER + 1):
        codes = rows[k]
        cost = np.zeros((len(codes), len(langs)), np.float32)
        if k:
            contexts = np.searchsorted(known[-1], codes >> np.uint64(8))
            shorter = np.searchsorted(known[-1], codes & np.uint64((1 << (8 * k)) - 1))
            leave = np.zeros((len(known[-1]), len(langs)), np.float32)
        for j, lang in enumerate(langs):
            mine, n = data[lang][f"codes{k}"], data[lang][f"n{k}"]
            at = np.searchsorted(codes, mine)
            if k == 0:
                total, kinds = n.sum(), len(mine)
                cost[:, j] = np.log2((total + kinds) / kinds) + 8
                cost[at, j] = -np.log2(n / (total + kinds))
                continue
            total = np.bincount(contexts[at], weights=n, minlength=len(known[-1]))
            kinds = np.bincount(contexts[at], minlength=len(known[-1]))
            seen = kinds > 0
            leave[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
            cost[:, j] = leave[contexts, j] + costs[-1][shorter, j]
            ctx = contexts[at]
            cost[at, j] = -np.log2(n / (total[ctx] + kinds[ctx]))
        if k:
            leaves.append(leave)
        costs.append(cost)
        known.append(codes)
        tables.append(None if k == 0 else Codes(codes))
    return PpmModel(langs, tables, costs, leaves)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_lang: int = DOCS_PER_LANG, max_train_bytes: int = MAX_TRAIN_BYTES) -> PpmModel | None:
    """Model of the languages of ``docs`` (rows with text and language), or None without such rows."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where(F.col("t").isNotNull() & F.col("l").isNotNull() & F.octet_length("t").between(1, max_train_bytes))
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), F.col("i"))
    # Ranks on ids alone; the text is fetched for the chosen ones (at most docs_per_lang per language).
    chosen = rows.select("i", "l").withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_lang)
    # The chosen ids are bounded by docs_per_lang times the number of languages.
    kept = rows.join(F.broadcast(chosen.select("i")), "i", "left_semi")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "t"])
        return pd.DataFrame({"l": pdf["l"].iloc[:1], "counts": [count_grams([utf8(t) for t in pdf["t"]])]})

    found = kept.groupBy("l").applyInPandas(count, "l string, counts binary").collect()
    return build_model({r["l"]: bytes(r["counts"]) for r in found}) if found else None


def language_column(spark, model: PpmModel | None, text: Column) -> Column:
    """Struct (lang_pred, score, bits_per_byte) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            n = len(s)
            lang = np.full(n, UNDETERMINED, object)
            score, per_byte = np.zeros(n), np.zeros(n)
            at = [i for i, t in enumerate(s) if m is not None and has_letter(t)]
            raw = [utf8(s.iloc[i]) for i in at]
            if at:
                bits = m.totals(raw)
                best = bits.argmin(axis=1)
                low = bits.min(axis=1)
                lang[at] = np.array(m.langs, object)[best]
                score[at] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                per_byte[at] = low / [len(r) for r in raw]
            yield pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": per_byte})
        release()

    return predict(text.cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: PpmModel | None, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in a learned language: not undetermined and within MAX_BITS_PER_BYTE."""
    name = "__language"
    p = docs.withColumn(name, language_column(docs.sparkSession, model, F.col(text_col)))
    good = (F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.bits_per_byte") <= MAX_BITS_PER_BYTE)
    return p.where(good).drop(name)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    p = docs.select("doc_id", held_out().alias("held_out"), language_column(spark, model, F.col("text")).alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits_per_byte")
