"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Suffix arrays are built by induced sorting (``suffix_array``) over shards of
contexts, so that all places of any repeated string meet in one shard:

* Every LENGTH-byte string names the smallest of its ``GRAM``-byte hashes; equal
  strings name equal grams. Neighbouring strings that name the same gram form a
  run; a run's context is the text from its first string's start to its last
  one's end. A gram that no other run names has no repeats.
* Equal contexts collapse to one (their strings all repeat). Distinct contexts
  of a gram that has several go to the gram's shard, where the suffix array and
  its permuted common prefixes tell which strings start more than once.
* A gram with more than ``HOT`` contexts would fill a shard: its strings are
  counted by 96-bit hash instead, one entry per block that holds them, so no
  group of copies or common passage is gathered in a task.

Blocks of documents offer grams, then contexts, distinct per block, and get one
bit per question back. Strings never cross documents and are judged on the
input; overlapping ones count.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; rows
that repeat an id are ordered by their text (and are repeats of one another);
null ids come first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, NO_ID, OFFER, Blocks, answer_rows, entries, groups, window_minima
from .common import parts_for, plan_bytes, table
from .rolling import BYTE_VALUES, CHUNK, U, inverse_powers, mix, prefix, spans, windows
from .suffix_array import join_texts, permuted_common_prefixes, suffix_array

LENGTH, GRAM = 400, 120
HOT = 1000
#: Text bytes per shard, and context bytes sorted at once.
SHARD_BYTES, SORT_BYTES = 1 << 20, 1 << 20
#: Bytes of short texts handled at once, so that their hashes stay in a processor's cache.
CACHED = 1 << 16
_GRAM = np.dtype([("h", "<u8"), ("x", "<u8"), ("n", "<u4")])
_ENTRY = np.dtype([("h", "<u8"), ("x", "<u4")])
#: Questions of the three kinds of offers.
REPEATS, SEVERAL, TOO_MANY, EQUAL, OWN, AGAIN = range(6)
GRAMS, CONTEXTS, STRINGS = 0, 1, 2


class _Runs:
    """Runs of a block: document, first and last string start (in the document), gram and context hash."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.texts, self.length = texts, length
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for pieces in _pieces(texts, length):
            data = np.frombuffer(b"".join(texts[d][a:b] for d, a, b in pieces), np.uint8)
            if len(data) < length:
                continue
            p = prefix(BYTE_VALUES[data])
            h = _grams(p, gram)
            least = window_minima(h, length - gram + 1)
            sizes = np.array([b - a for _, a, b in pieces])
            begin = np.cumsum(np.r_[0, sizes[:-1]])
            # A run ends where the named gram changes, and where its piece's strings end.
            new = np.empty(len(least) + 1, bool)
            np.not_equal(least[1:], least[:-1], out=new[1:-1])
            stop = begin + np.maximum(sizes - length + 1, 0)
            new[begin[begin < len(least)]] = new[stop[stop < len(least)]] = new[-1] = True
            s0 = np.flatnonzero(new)
            s0, s1 = s0[:-1], s0[1:] - 1
            who = np.searchsorted(begin, s0, "right") - 1
            inside = s0 < stop[who]
            s0, s1, who = s0[inside], s1[inside], who[inside]
            if not len(s0):
                continue
            shift = np.array([a for _, a, _ in pieces])[who] - begin[who]
            cols[0].append(np.array([d for d, _, _ in pieces])[who])
            cols[1].append(s0 + shift)
            cols[2].append(s1 + shift)
            cols[3].append(h[least[s0]])
            cols[4].append(spans(p, s0, s1 + length))
        whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols]
        self.doc, self.s0, self.s1 = whole[:3]
        self.gram, self.context = (c.astype(np.uint64) for c in whole[3:])

    def grams(self):
        """(distinct grams with a context and their number of contexts, named twice, gram number per run)."""
        order = np.lexsort((self.context, self.gram))
        g, c = self.gram[order], self.context[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
        kinds = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])][: len(g)]
        size = np.diff(np.r_[first, len(g)])
        out = np.empty(len(first), _GRAM)
        out["h"], out["x"] = g[first], c[first]
        out["n"] = np.add.reduceat(kinds, first) if len(first) else 0
        back = np.empty(len(g), np.int64)
        back[order] = np.repeat(np.arange(len(first)), size)
        return out, size > 1, back

    def contexts(self, chosen: np.ndarray):
        """(distinct entries, occurs twice, entry number per chosen run, first chosen run per entry)."""
        key = mix(self.gram[chosen] + mix(self.context[chosen]))
        x = (self.context[chosen] >> U(32)).astype(np.uint32)
        return _distinct(key, x)

    def strings(self, chosen: np.ndarray):
        """Entries of all strings of the chosen runs, with the run and start of each."""
        hs, xs, runs, starts = [], [], [], []
        for r in chosen.tolist():
            part = np.frombuffer(self.texts[self.doc[r]][self.s0[r] : self.s1[r] + self.length], np.uint8)
            hs.append(windows(BYTE_VALUES[part], self.length))
            xs.append(windows(mix(BYTE_VALUES[part]), self.length) >> U(32))
            starts.append(np.arange(self.s0[r], self.s1[r] + 1))
            runs.append(np.full(len(hs[-1]), r))
        flat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return _distinct(flat(hs, np.uint64), flat(xs, np.uint64).astype(np.uint32)), flat(runs, np.int64), flat(starts, np.int64)


def _grams(p: np.ndarray, gram: int) -> np.ndarray:
    """``spans`` of every window of ``gram`` bytes."""
    out = p[gram:] - p[:-gram]
    out *= inverse_powers(len(out))
    out += U(gram)
    return mix(out)


def _distinct(h: np.ndarray, x: np.ndarray):
    order = np.lexsort((x, h))
    number = groups([h[order], x[order]])
    first = np.flatnonzero(np.diff(np.r_[-1, number])) if len(number) else np.empty(0, np.int64)
    out = np.empty(len(first), _ENTRY)
    out["h"], out["x"] = h[order][first], x[order][first]
    back = np.empty(len(h), np.int64)
    back[order] = number
    return out, np.bincount(number, minlength=len(first)) > 1, back, order[first]


def _pieces(texts: list[bytes], length: int):
    """Lists of (document, from, to) of about CACHED bytes; texts longer than CHUNK are cut with an overlap of length - 1."""
    out, size = [], 0
    for d, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), CHUNK):
            b = min(len(t), a + CHUNK + length - 1)
            if size and size + b - a > CACHED:
                yield out
                out, size = [], 0
            out.append((d, a, b))
            size += b - a
    if out:
        yield out


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Per context the starts of its strings of ``length`` bytes that start more than once in all contexts."""
    t, begins = join_texts(contexts)
    common, phi = permuted_common_prefixes(t, suffix_array(t))
    hit = np.flatnonzero(common >= length)
    marked = np.unique(np.r_[hit, phi[hit]])
    cut = np.searchsorted(marked, np.r_[begins, len(t)])
    return [marked[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], begins)]


def _intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered intervals of strings that start at ascending ``starts``."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    return list(zip(starts[new].tolist(), (starts[np.r_[new[1:], len(starts)] - 1] + length).tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, n_shared) per document: spans of removed bytes, kept the other bytes joined.

    ``n_shared``: the document's runs whose named gram other runs name too. Above 0, with nothing removed, they
    hold a passage that recurs but is shorter than ``length``.
    """
    blocks = Blocks(docs, id_col, text_col)
    packed, helper = blocks.packed, blocks.detached()
    shards = parts_for(plan_bytes(docs), SHARD_BYTES, helper.count)
    offer_schema = OFFER + ", kind int"

    def offer(block: int, kind: int, found: np.ndarray, flags: np.ndarray) -> pd.DataFrame:
        return helper.offer(block, found["h"], found, flags).assign(kind=kind)

    def offer_grams(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found, twice, _ = _Runs(helper.texts(pdf)[1], length, gram).grams()
        return offer(int(key[0]), GRAMS, found, twice)

    def told(runs: _Runs, answers: pd.DataFrame):
        """Per run: its gram repeats, has several contexts, has too many."""
        found, _, back = runs.grams()
        return tuple(helper.answered(answers, q, found["h"])[back] for q in (REPEATS, SEVERAL, TOO_MANY))

    def offer_rest(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"bucket": [], "block": [], "keys": [], "flags": [], "kind": []})
        runs = _Runs(helper.texts(pdf)[1], length, gram)
        repeats, _, many = told(runs, answers)
        found, twice, _, _ = runs.contexts(np.flatnonzero(repeats & ~many))
        (strings, again, _, _), _, _ = runs.strings(np.flatnonzero(many))
        return pd.concat([offer(int(key[0]), CONTEXTS, found, twice), offer(int(key[0]), STRINGS, strings, again)])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in pdf.groupby("kind"):
            part = part.copy()
            dtype = _GRAM if kind == GRAMS else _ENTRY
            e, block, twice = entries(part, dtype)
            order = np.lexsort((block, e["h"])) if kind == GRAMS else np.lexsort((block, e["x"], e["h"]))
            h = e[order]
            number = groups([h["h"]] if kind == GRAMS else [h["h"], h["x"]])
            n = np.bincount(number)
            repeats = (n > 1) | (np.bincount(number, weights=twice[order]) > 0)
            per_group = {}
            if kind == GRAMS:
                first = np.flatnonzero(np.diff(np.r_[-1, number]))
                kinds = np.bincount(number, weights=h["n"])
                other = np.bincount(number, weights=h["x"] != h["x"][first][number]) > 0
                per_group = {REPEATS: repeats, SEVERAL: other | (np.maximum.reduceat(h["n"], first) > 1), TOO_MANY: repeats & (kinds > hot)}
            else:
                per_group = {EQUAL if kind == CONTEXTS else AGAIN: repeats}
            for q, bits in per_group.items():
                out.append(answer_rows(part, dtype, q, _back(order, bits[number])))
            if kind == CONTEXTS:
                leads = np.r_[True, number[1:] != number[:-1]][: len(number)]
                out.append(answer_rows(part, dtype, OWN, _back(order, leads)))
        return pd.concat(out)

    def send(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Distinct contexts of grams with several, to the grams' shards; ``known``: all its strings repeat anyway."""
        out = []
        if len(pdf):
            runs = _Runs(helper.texts(pdf)[1], length, gram)
            repeats, several, many = told(runs, answers)
            chosen = np.flatnonzero(repeats & ~many)
            found, _, _, first = runs.contexts(chosen)
            equal, own = (helper.answered(answers, q, found["h"]) for q in (EQUAL, OWN))
            for i in np.flatnonzero(own & several[chosen[first]]).tolist():
                r = chosen[first[i]]
                text = runs.texts[runs.doc[r]][runs.s0[r] : runs.s1[r] + length]
                out.append((int(runs.gram[r] % U(shards)), int(runs.gram[r].view(np.int64)), int(key[0]), int(runs.doc[r]), int(runs.s0[r]), bool(equal[i]), text))
        return pd.DataFrame(out, columns=["shard", "gram", "block", "doc", "at", "known", "context"])

    def sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        """Suffix arrays over a shard, a few grams at a time."""
        pdf = pdf.sort_values(["gram", "block", "doc", "at"])
        size = pdf["context"].map(len).to_numpy().cumsum()
        grams = pdf["gram"].to_numpy()
        out, lo = [], 0
        edges = np.r_[np.flatnonzero(grams[1:] != grams[:-1]) + 1, len(grams)]
        for k, hi in enumerate(edges.tolist()):
            done = size[lo - 1] if lo else 0
            if hi == len(grams) or size[edges[k + 1] - 1] - done > SORT_BYTES:
                part = pdf.iloc[lo:hi]
                found = repeated_starts([bytes(c) for c in part["context"]], length)
                for block, doc, at, known, starts in zip(part["block"], part["doc"], part["at"], part["known"], found):
                    if not known:
                        out += [(block, doc, a + at, b + at) for a, b in _intervals(starts, length)]
                lo = hi
        return pd.DataFrame(out, columns=["block", "doc", "first", "end"])

    def remove(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_shared"]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns})
        ids, texts = helper.texts(pdf)
        runs = _Runs(texts, length, gram)
        repeats, _, many = told(runs, answers)
        shared = np.bincount(runs.doc[repeats].astype(np.int64), minlength=len(ids))
        chosen = np.flatnonzero(repeats & ~many)
        found, _, back, _ = runs.contexts(chosen)
        covered = chosen[helper.answered(answers, EQUAL, found["h"])[back]]
        hot_runs = np.flatnonzero(many)
        (strings, _, at, _), who, starts = runs.strings(hot_runs)
        hit = helper.answered(answers, AGAIN, strings["h"])[at]
        sorted_ = answers[answers["step"] < 0] if len(answers) else answers
        doc = np.r_[runs.doc[covered], runs.doc[who[hit]], sorted_["block_doc"].to_numpy(np.int64) if len(sorted_) else np.empty(0, np.int64)]
        first = np.r_[runs.s0[covered], starts[hit], sorted_["first"].to_numpy(np.int64) if len(sorted_) else np.empty(0, np.int64)]
        end = np.r_[runs.s1[covered] + length, starts[hit] + length, sorted_["end"].to_numpy(np.int64) if len(sorted_) else np.empty(0, np.int64)]
        order = np.lexsort((first, doc))
        doc, first, end = doc[order], first[order], end[order]
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        out = []
        for i, (doc_id, t) in enumerate(zip(ids, texts)):
            merged: list[list[int]] = []
            for a, b in zip(first[cuts[i] : cuts[i + 1]].tolist(), end[cuts[i] : cuts[i + 1]].tolist()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(x for m in merged for x in m), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2]))
            out.append((None if doc_id == NO_ID else doc_id, len(t), len(t) - len(kept), [{"first": a, "end": b} for a, b in merged], kept, int(shared[i])))
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    n, m = helper.count, helper.buckets
    ask = lambda offers: offers.repartition(m, "bucket").groupBy("bucket").applyInPandas(answer, ANSWER).repartition(n, "block")
    about_grams = ask(packed.groupBy("block").applyInPandas(offer_grams, offer_schema))
    about_rest = ask(packed.groupBy("block").cogroup(about_grams.groupBy("block")).applyInPandas(offer_rest, offer_schema))
    answers = about_grams.unionByName(about_rest).repartition(n, "block")
    sent_schema = "shard int, gram long, block int, doc int, at long, known boolean, context binary"
    sent = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(send, sent_schema)
    result = "block int, doc int, first long, end long"
    found = sent.repartition(shards, "shard").groupBy("shard").applyInPandas(sort_shard, result)
    none = F.lit(None)
    found = found.select("block", none.cast("int").alias("bucket"), F.lit(-1).alias("step"), none.cast("binary").alias("bits"), F.col("doc").alias("block_doc"), "first", "end")
    told_all = answers.withColumns({"block_doc": none.cast("int"), "first": none.cast("long"), "end": none.cast("long")})
    everything = told_all.unionByName(found).repartition(n, "block")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<first: long, end: long>>, kept binary, n_shared long"
    return packed.groupBy("block").cogroup(everything.groupBy("block")).applyInPandas(remove, schema)


def _back(order: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.empty(len(bits), bool)
    out[order] = bits
    return out


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared"
    )
