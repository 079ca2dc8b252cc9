"""Substring dedup: Rabin-Karp hashes of every window of ``WINDOW`` words, counted in Spark.

A word goes if a window that covers it also starts earlier (smaller id, or same
document, earlier start); windows are judged on the input. Overlapping windows
merge into maximal removal intervals.

Every window is hashed (96 bits); only those that can repeat are counted: a
window names the smallest of its ``GRAM``-word hashes, equal windows name equal
ones, so a window whose named gram occurs once in all documents is unique.
Blocks of documents (ranges of ids, so block order is document order) offer
first their named grams, then the windows whose gram repeats, each distinct key
once per block; a bucket answers with one bit a key: whether the gram occurs
again, whether the window is in an earlier block. Hot windows therefore cost one
entry per block, not per occurrence.

Defined cases: null text has no words; documents shorter than a window lose
nothing; rows that repeat an id are ordered by their text; null ids come first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, NO_ID, OFFER, Blocks, answer_rows, entries, groups, window_minima
from .common import table
from .rolling import U, batches, joined_words, mix, windows

WINDOW, GRAM = 20, 10
_ENTRY = np.dtype([("h", "<u8"), ("x", "<u4")])


class _Block:
    """Windows of a block's documents; positions count the words of all its documents."""

    def __init__(self, texts: list[bytes]):
        parts, firsts, base = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
        for lo, hi in batches(texts):
            _, h, _, _, first = joined_words(texts[lo:hi])
            parts.append(h)
            firsts.append(first[1:] + base)
            base += len(h)
        self.words = np.concatenate(parts)
        self.first = np.concatenate(firsts)  # first word of each document and, last, the word count
        grams = windows(self.words, GRAM)
        least = window_minima(grams, WINDOW - GRAM + 1)
        size = np.diff(self.first)
        valid = np.zeros(len(self.words) + 1, np.int64)
        long = size >= WINDOW
        np.add.at(valid, self.first[:-1][long], 1)
        np.add.at(valid, self.first[1:][long] - WINDOW + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        places, at = np.unique(least[self.starts], return_inverse=True)
        self.grams, back, n = np.unique(grams[places], return_inverse=True, return_counts=True)
        self.again = n > 1
        self.gram_of = back[at]

    def candidates(self, repeated: np.ndarray):
        """(distinct keys ascending, their entries, key number per candidate, candidate starts) of windows whose gram repeats."""
        starts = self.starts[repeated[self.gram_of]]
        h = windows(self.words, WINDOW)[starts] if len(starts) else np.empty(0, np.uint64)
        x = windows(mix(self.words ^ U(0x5BD1E995)), WINDOW)[starts] >> U(32) if len(starts) else np.empty(0, np.uint64)
        order = np.lexsort((x, h))
        number = groups([h[order], x[order]])
        first = np.flatnonzero(np.diff(np.r_[-1, number]))
        out = np.empty(len(first), _ENTRY)
        out["h"], out["x"] = h[order][first], x[order][first]
        return out, order, number, first, starts

    def removed_words(self, answers: pd.DataFrame, blocks: Blocks) -> np.ndarray:
        keys, order, number, first, starts = self.candidates(blocks.answered(answers, 1, self.grams) | self.again)
        gone = blocks.answered(answers, 2, keys["h"])[number]
        later = np.ones(len(number), bool)
        later[first] = False  # the first in the block stays unless an earlier block has it
        covered = np.zeros(len(self.words) + 1, np.int32)
        hit = starts[order[gone | later]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
        return np.cumsum(covered[:-1]) > 0


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) per document.

    spans: maximal removed runs as (first word, end word); kept: the other words joined by one space.
    """
    blocks = Blocks(docs, id_col, text_col)
    no_answers = pd.DataFrame({"block": [], "bucket": [], "step": [], "bits": []})

    def offer_grams(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Block(blocks_texts(pdf)[1])
        return offer(int(key[0]), b.grams, b.grams, b.again)

    def offer_windows(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return offer(int(key[0]), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool))
        b = _Block(blocks_texts(pdf)[1])
        keys = b.candidates(answered(answers, 1, b.grams) | b.again)[0]
        return offer(int(key[0]), keys["h"], keys, np.zeros(len(keys), bool))

    def gram_answers(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, _, again = entries(pdf, np.uint64)
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        several = np.bincount(back, weights=again) > 0
        return answer_rows(pdf, np.uint64, 1, ((n > 1) | several)[back])

    def window_answers(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, block, _ = entries(pdf, _ENTRY)
        order = np.lexsort((block, keys["x"], keys["h"]))
        number = groups([keys["h"][order], keys["x"][order]])
        bits = np.empty(len(keys), bool)
        bits[order] = np.r_[False, number[1:] == number[:-1]][: len(keys)]
        return answer_rows(pdf, _ENTRY, 2, bits)

    def remove(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "spans", "kept"]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns})
        ids, texts = blocks_texts(pdf)
        b = _Block(texts)
        gone = b.removed_words(answers if len(answers) else no_answers, helper)
        out = []
        for i, (doc_id, t) in enumerate(zip(ids, texts)):
            g = gone[b.first[i] : b.first[i + 1]]
            words = t.split()  # ASCII white space: the same words as the pattern's
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans = [{"first": x, "end": y} for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist())]
                words = [w for w, x in zip(words, g.tolist()) if not x]
            else:
                spans = []
            out.append((None if doc_id == NO_ID else doc_id, len(g), int(g.sum()), spans, b" ".join(words).decode("utf-8", "replace")))
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    packed, helper = blocks.packed, blocks.detached()
    blocks_texts, offer, answered = helper.texts, helper.offer, helper.answered
    grams = packed.groupBy("block").applyInPandas(offer_grams, OFFER)
    first = grams.repartition(helper.buckets, "bucket").groupBy("bucket").applyInPandas(gram_answers, ANSWER).repartition(helper.count, "block")
    both = packed.groupBy("block").cogroup(first.groupBy("block")).applyInPandas(offer_windows, OFFER)
    second = both.repartition(helper.buckets, "bucket").groupBy("bucket").applyInPandas(window_answers, ANSWER).repartition(helper.count, "block")
    answers = first.unionByName(second).repartition(helper.count, "block")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first: long, end: long>>, kept string"
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(remove, schema)


def op4_repeated_windows(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
windows AS (
  SELECT doc_id, p AS k, string_agg(word, ' ') OVER o AS text_, count(*) OVER o AS n FROM words
  WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY text_ ORDER BY doc_id, k) AS nth FROM windows WHERE n = 20),
gone AS (SELECT DISTINCT doc_id, k + o AS p FROM ranked, (SELECT unnest(range(0, 20)) AS o) WHERE nth > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id::BIGINT AS doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
