"""Periodic runs of words, found on a grammar of each document.

A run is a maximal stretch of words with smallest period q that holds two periods
and ``least`` words. The words of a document are numbered and compressed by Re-Pair:
frequent pairs of neighbouring symbols become nonterminals until no pair occurs
twice; a balanced tree over what is left completes the grammar. The rounds take
all documents of a batch at once, and in each document every pair that is more
frequent than the pairs it overlaps.

* A run of the text lies whole in the lowest node of the derivation that holds
  it and crosses that node's inner boundary. So for every nonterminal the runs
  that cross its boundary are computed once, on one of its occurrences: a run of
  12 words repeats at least 3 words beside the boundary, or one period before it,
  which gives the candidate periods; they are extended to both sides by
  comparing names of blocks of 1, 2, 4, ... words (equal names: equal words).
* These runs are translated to all places where the nonterminal is derived.
  Pieces that a larger interval of the same period holds are merged into it;
  of periods with the same interval the smallest is the run's.

Every document is handled in the row where it is read: no shuffle, and a repeated
task gives the same rows. Memory is linear in the words of a batch (a few
documents, or one long one) times the logarithm of the longest document's repeats.

Defined cases: a null or blank text has no words and no runs; equal rows give
equal rows; the general interface takes null ids as any other; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table, utf8

LEAST = 12
#: Words at a time; a longer document is a batch of its own.
BATCH_WORDS = 200_000
#: Words that a candidate period must repeat beside a boundary: half of LEAST, on one of two sides.
SEED = 3


@dataclass
class Nodes:
    """Nonterminals: an occurrence [start, end) in the batch's words with its inner boundary, and further occurrences of the node."""

    start: np.ndarray
    bound: np.ndarray
    end: np.ndarray
    node: np.ndarray  # of every further occurrence
    place: np.ndarray  # and where it starts


def re_pair(symbols: np.ndarray, doc: np.ndarray) -> Nodes:
    """Grammar of every document; ``symbols`` are numbers of words, different between documents."""
    seq, at, size = symbols.astype(np.int64), np.arange(len(symbols)), np.ones(len(symbols), np.int64)
    fresh = int(seq.max()) + 1 if len(seq) else 0
    parts, left, made = [], [], 0
    while len(seq):
        chosen, key = _pairs(seq, doc)
        # Documents without a pair left to replace are finished.
        done = np.ones(int(doc[-1]) + 1, bool)
        done[doc[chosen]] = False
        over = done[doc]
        if over.any():
            left.append((at[over], size[over], doc[over]))
        if not len(chosen):
            break
        names, first, number = np.unique(key[chosen], return_index=True, return_inverse=True)
        rep = chosen[first]
        start, bound = at[rep], at[rep + 1]
        again = np.ones(len(chosen), bool)
        again[first] = False
        parts.append((start, bound, bound + size[rep + 1], made + number[again], at[chosen[again]]))
        made += len(names)
        seq[chosen] = fresh + number
        size[chosen] += size[chosen + 1]
        fresh += len(names)
        stay = ~over
        stay[chosen + 1] = False
        seq, at, size, doc = seq[stay], at[stay], size[stay], doc[stay]
    for tree in _balanced(*(np.concatenate(c) for c in zip(*left))) if left else ():
        parts.append((*tree, np.empty(0, np.int64), np.empty(0, np.int64)))
    empty = np.empty(0, np.int64)
    return Nodes(*(np.concatenate(c) for c in zip(*parts))) if parts else Nodes(empty, empty, empty, empty, empty)


def _pairs(seq: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, key of every place): the pair at each of these places is replaced in this round.

    No two of them overlap, and every pair among them occurs twice at least.
    """
    often = np.bincount(seq) > 1
    often = often[seq]
    at = np.flatnonzero(often[:-1] & often[1:] & (doc[:-1] == doc[1:]))
    key = np.zeros(len(seq), np.int64)
    key[at] = seq[at] * (int(seq.max()) + 1) + seq[at + 1]
    # In a chain of one symbol every second pair counts.
    follows = np.zeros(len(at), bool)
    if len(at):
        follows[1:] = (at[1:] == at[:-1] + 1) & (key[at[1:]] == key[at[:-1]])
        heads = np.flatnonzero(~follows)
        step = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
        at = at[step % 2 == 0]
    at, n = _counted(at, key)
    # A pair gives way to an overlapping one that is more frequent. Ties go by scrambled keys (different keys stay
    # different), so that long stretches of equally frequent pairs take few rounds.
    score, mine = np.zeros(len(seq) + 1, np.int64), np.zeros(len(seq) + 1, np.uint64)
    scrambled = key[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    scrambled ^= scrambled >> np.uint64(31)
    score[at], mine[at] = n, scrambled
    wins = np.ones(len(at), bool)
    for other in (at - 1, at + 1):
        there, which = score[other], mine[other]
        wins &= (there < n) | ((there == n) & (which <= scrambled))
    at, _ = _counted(at[wins], key)
    return at, key


def _counted(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose pair occurs at two of them or more, and how often."""
    if not len(at):
        return at, at
    order = np.argsort(key[at], kind="stable")
    k = key[at[order]]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    n = np.empty(len(at), np.int64)
    n[order] = np.repeat(np.diff(np.r_[heads, len(at)]), np.diff(np.r_[heads, len(at)]))
    keep = n > 1
    return at[keep], n[keep]


def _balanced(at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, bound, end) of the nodes that join neighbours level by level, until one symbol a document is left."""
    order = np.argsort(at)
    start, end, doc = at[order], (at + size)[order], doc[order]
    while True:
        first = np.r_[True, doc[1:] != doc[:-1]]
        heads = np.flatnonzero(first)
        lengths = np.diff(np.r_[heads, len(doc)])
        if lengths.max() < 2:
            return
        rank = np.arange(len(doc)) - np.repeat(heads, lengths)
        a = np.flatnonzero((rank % 2 == 0) & (rank + 1 < np.repeat(lengths, lengths)))
        yield start[a], start[a + 1], end[a + 1]
        end[a] = end[a + 1]
        stay = rank % 2 == 0
        start, end, doc = start[stay], end[stay], doc[stay]


class Blocks:
    """Names of the blocks of 1, 2, 4, ... words that begin at each place: equal names, equal words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.names = [words]
        while 2 << (len(self.names) - 1) <= longest:
            half, last = 1 << (len(self.names) - 1), self.names[-1]
            if len(last) <= 2 * half:
                break
            pair = last[:-half] * (int(last.max()) + 1) + last[half:]
            _, names = np.unique(pair, return_inverse=True)
            self.names.append(names.astype(np.int64))

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal, at most ``most``."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            while True:
                can = np.flatnonzero((got + step <= most) & (b + got + step <= len(self.names[0])))
                can = can[name[a[can] + got[can]] == name[b[can] + got[can]]]
                got[can] += step
                # Only blocks of the largest size may follow one another.
                if not len(can) or k < len(self.names) - 1:
                    break
        return got

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a and before b are equal, at most ``most``."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            while True:
                can = np.flatnonzero(got + step <= most)
                can = can[name[a[can] - got[can] - step] == name[b[can] - got[can] - step]]
                got[can] += step
                if not len(can) or k < len(self.names) - 1:
                    break
        return got


def _candidates(symbols: np.ndarray, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, place, period): the SEED words at ``place`` recur a period later, one of the two at the node's boundary or ending there."""
    # Equal words give equal sums; what only looks equal is dropped when it is extended.
    mix = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seeds = mix.copy()
    for k in range(1, SEED):
        seeds[: len(mix) - k] += (mix[k:] ^ (mix[k:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
    out = []
    large = np.flatnonzero(nodes.end - nodes.start >= LEAST)
    budget, lo = 4 * BATCH_WORDS, 0
    totals = np.cumsum(nodes.end[large] - nodes.start[large])
    while lo < len(large):
        hi = max(lo + 1, int(np.searchsorted(totals, (totals[lo - 1] if lo else 0) + budget, side="right")))
        some = large[lo:hi]
        lo = hi
        span = nodes.end[some] - nodes.start[some] - SEED + 1
        who = np.repeat(np.arange(len(some)), span)
        place = np.arange(len(who)) - np.repeat(np.cumsum(span) - span, span) + nodes.start[some][who]
        here = seeds[place]
        for seed_at in (nodes.bound[some], nodes.bound[some] - SEED):
            inside = (seed_at >= nodes.start[some]) & (seed_at + SEED <= nodes.end[some])
            target = seeds[np.where(inside, seed_at, 0)]
            hit = np.flatnonzero((here == target[who]) & inside[who])
            hit = hit[place[hit] != seed_at[who[hit]]]
            w, p, s = some[who[hit]], place[hit], seed_at[who[hit]]
            out.append((w, np.minimum(p, s), np.abs(p - s)))
    node, place, period = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3
    fits = 2 * period <= nodes.end[node] - nodes.start[node]
    return node[fits], place[fits], period[fits]


def find_runs(symbols: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a batch, in word numbers of the batch, ordered by start, then period.

    ``symbols``: numbers of the words, different between documents; ``least``: from LEAST on.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not found by seeds of {SEED}")
    nodes = re_pair(symbols, doc)
    node, place, period = _candidates(symbols, nodes)
    none = np.empty(0, np.int64)
    if not len(node):
        return none, none, none
    lo, hi = nodes.start[node], nodes.end[node] - period
    # Blocks are named over the documents that have candidates only.
    marked = np.zeros(int(doc[-1]) + 1, bool)
    marked[doc[place]] = True
    used = np.flatnonzero(marked[doc])
    to = np.zeros(len(symbols), np.int64)
    to[used] = np.arange(len(used))
    _, words = np.unique(symbols[used], return_inverse=True)
    blocks = Blocks(words.astype(np.int64), int((hi - lo).max()))
    a, b = to[place], to[place + period]
    parts = []
    # Smallest periods first, a few of every node at a time. Inside an interval of period p, multiples of p give the
    # same interval again, so they need not be extended.
    order = np.lexsort((period, node))
    rank = np.empty(len(node), np.int64)
    heads = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
    rank[order] = np.arange(len(node)) - np.repeat(heads, np.diff(np.r_[heads, len(node)]))
    best = np.zeros((3, len(nodes.start)), np.int64)
    todo, upto = np.arange(len(node)), 4
    while len(todo):
        now = todo[rank[todo] < upto]
        begin = place[now] - blocks.behind(a[now], b[now], place[now] - lo[now])
        finish = place[now] + blocks.ahead(a[now], b[now], hi[now] - place[now]) + period[now]
        good = (finish - begin >= least) & (finish - begin >= 2 * period[now])
        now, begin, finish = now[good], begin[good], finish[good]
        parts.append((node[now], begin, finish, period[now]))
        by_length = np.argsort(finish - begin, kind="stable")
        longer = by_length[(finish - begin)[by_length] > (best[1] - best[0])[node[now[by_length]]]]
        best[:, node[now[longer]]] = begin[longer], finish[longer], period[now[longer]]
        todo = todo[rank[todo] >= upto]
        s, e, q = best[:, node[todo]]
        known = (q > 0) & (place[todo] >= s) & (place[todo] + period[todo] + SEED <= e)
        known[known] &= period[todo[known]] % q[known] == 0
        todo, upto = todo[~known], 2 * upto
    node, begin, finish, period = (np.concatenate(c) for c in zip(*parts))
    # Once per nonterminal, of equal intervals the smallest period.
    order = np.lexsort((period, finish, begin, node))
    node, begin, finish, period = (x[order] for x in (node, begin, finish, period))
    new = np.r_[True, (node[1:] != node[:-1]) | (begin[1:] != begin[:-1]) | (finish[1:] != finish[:-1])] if len(node) else np.empty(0, bool)
    node, begin, finish, period = (x[new] for x in (node, begin, finish, period))
    # To all further places of these nonterminals.
    which = np.argsort(nodes.node, kind="stable")
    first, last = (np.searchsorted(nodes.node[which], node, side=s) for s in ("left", "right"))
    n = last - first
    source = np.repeat(np.arange(len(node)), n)
    occurrence = which[np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    shift = nodes.place[occurrence] - nodes.start[node[source]]
    begin = np.r_[begin, begin[source] + shift]
    finish = np.r_[finish, finish[source] + shift]
    period = np.r_[period, period[source]]
    # Of one period, intervals inside a larger one go (they are parts of one run); documents do not overlap.
    order = np.lexsort((-finish, begin, period))
    begin, finish, period = begin[order], finish[order], period[order]
    far = int(len(symbols)) + 1
    reach = np.maximum.accumulate(finish + period * far)
    keep = np.r_[True, finish[1:] + period[1:] * far > reach[:-1]] if len(finish) else np.empty(0, bool)
    begin, finish, period = begin[keep], finish[keep], period[keep]
    order = np.lexsort((period, finish, begin))
    begin, finish, period = begin[order], finish[order], period[order]
    keep = np.r_[True, (begin[1:] != begin[:-1]) | (finish[1:] != finish[:-1])] if len(begin) else np.empty(0, bool)
    begin, finish, period = begin[keep], finish[keep], period[keep]
    order = np.lexsort((period, begin))
    return begin[order], finish[order], period[order]


def numbered(documents: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, document) of the words of all documents; equal words of one document have equal numbers."""
    symbols, doc, fresh = [], [], 0
    for k, words in enumerate(documents):
        seen: dict = {}
        symbols.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + fresh)
        doc.append(np.full(len(words), k, np.int64))
        fresh += len(seen)
    empty = np.empty(0, np.int64)
    return (np.concatenate(symbols), np.concatenate(doc)) if documents else (empty, empty)


def document_runs(documents: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every document, by start, then period."""
    symbols, doc = numbered(documents)
    if not len(symbols):
        return [[] for _ in documents]
    begin, finish, period = find_runs(symbols, doc, least)
    offset = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for k, s, e, q in zip(doc[begin].tolist(), begin.tolist(), finish.tolist(), period.tolist()):
        out[k].append((s - int(offset[k]), e - s, q))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def planted_period(doc_id: int | None, words: list) -> list:
    """The words of the query's documents: of every tenth id (by hash) the tail repeats a stretch of words."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[: n - a]


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, change=None) -> DataFrame:
    """Rows of SCHEMA, one per row of ``docs``: all runs, and the UTF-8 text with each run collapsed to its first period.

    ``change(doc_id, words)`` may give other words than those of the text.
    """

    def rows_of(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        runs = document_runs(words, least)
        kept = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs)]
        structs = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(structs, pa.list_(_RUN)), pa.array([len(w) for w in words], pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "runs", "n_words", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, n = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                # bytes.split parts at the six white-space characters of WORD_PATTERN, and at no others.
                own = utf8(text.as_py()).split()
                if change is not None:
                    own = change(doc_id, own)
                if ids and n + len(own) > BATCH_WORDS:
                    yield rows_of(ids, words)
                    ids, words, n = [], [], 0
                ids.append(doc_id)
                words.append(own)
                n += len(own)
            if ids:
                yield rows_of(ids, words)
        release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def run_digest(found: DataFrame) -> DataFrame:
    """Per document: number of runs, its longest run (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    # Runs are ordered by start, then period: of equal lengths the first is the one.
    top = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), "
                 "(a, r) -> if(a is null or r.length > a.length, r, a))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    listing = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listing.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(table(spark, sf_dir, "documents"), change=planted_period))
