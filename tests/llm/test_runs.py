import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasedex.llm import runs as X

from .conftest import SF


def by_definition(words, least=12):
    """Every period, every maximal stretch of equalities; of one interval the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                s = i if s is None else s
            elif s is not None:
                length = i + q - s
                if length >= max(least, 2 * q):
                    found.setdefault((s, length), q)
                s = None
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 120), st.integers(1, 25), st.randoms(use_true_random=False)), max_size=5))
def test_random_words(specs):
    documents = []
    for letters, n, unit, rng in specs:
        words = [rng.randrange(letters) for _ in range(n)]
        piece = [rng.randrange(letters) for _ in range(unit)]
        cut = rng.randrange(n + 1)
        documents.append(words[:cut] + piece * rng.randrange(5) + words[cut:])
    assert X.document_runs(documents) == [by_definition(d) for d in documents]


def test_nested_and_special_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(256))
    inner = ("x" * 12 + "y") * 9
    documents = [list(w) for w in (fib[-1], thue, inner, inner + "z" + inner, "a" * 97, "", "q", "ab" * 5, "ab" * 6, "ab" * 6 + "a")]
    assert X.document_runs(documents) == [by_definition(d) for d in documents]


def test_grammar_derives_each_document():
    rng = random.Random(5)
    documents = [[rng.randrange(3) for _ in range(rng.randrange(200))] for _ in range(12)]
    symbols, doc = X.numbered(documents)
    nodes = X.re_pair(symbols, doc)
    assert ((nodes.start < nodes.bound) & (nodes.bound < nodes.end)).all()
    for node, place in zip(nodes.node, nodes.place):
        a, b = nodes.start[node], nodes.end[node]
        assert (symbols[a:b] == symbols[place : place + b - a]).all() and doc[place] == doc[a]
    for k, d in enumerate(documents):
        whole = np.flatnonzero(doc == k)
        if len(d) > 1:
            assert ((nodes.start == whole[0]) & (nodes.end == whole[-1] + 1)).any()


def test_long_periodic_documents_are_fast():
    n = 60_000
    documents = [["w"] * n, [i % 7 for i in range(n)], [random.Random(1).randrange(9000) for _ in range(n)], [i % 15_000 for i in range(n)]]
    t = time.perf_counter()
    got = X.document_runs(documents)
    assert got[:2] == [[(0, n, 1)], [(0, n, 7)]] and got[3] == [(0, n, 15_000)]
    assert time.perf_counter() - t < 20


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = [tuple(r) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    assert len(short) > 100
    got = {r["doc_id"]: tuple(r) for r in X.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count()
    assert {i: got[i] for i, _ in short} == {i: expected(i, t) for i, t in short}


def test_clashing_columns_and_edges(spark, frame):
    rows = [(None, None), (None, "a b"), (1, ""), (1, " \t\n"), (10, "a\x0bb a b a b a b a b a b"), (10, "a\x0bb a b a b a b a b a b"), (3, "x y " * 8)]
    got = X.run_digest(X.periodic_runs(frame(rows), change=X.planted_period)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(*r)) for r in rows)
    assert X.run_digest(X.periodic_runs(frame([]))).count() == 0
    plain = X.periodic_runs(frame([(10, "n " + "ab cd " * 7)])).first()
    assert [tuple(r) for r in plain["runs"]] == [(1, 14, 2)] and bytes(plain["collapsed"]) == b"n ab cd" and plain["n_words"] == 15
