import hashlib
import random
import re

import numpy as np
import pytest

from phrasedex.llm.repeated_windows import WINDOW, remove_repeated_windows
from phrasedex.llm.suffix_array import join_texts, permuted_common_prefixes, suffix_array
from phrasedex.llm.suffix_dedup import LENGTH, remove_repeats


def in_order(rows):
    return sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)


def brute_words(rows):
    seen, out = set(), []
    for i, t in in_order(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            if key in seen:
                gone[k : k + WINDOW] = [True] * WINDOW
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def brute_bytes(rows, length):
    texts, count = [(i, t.encode()) for i, t in in_order(rows)], {}
    for _, b in texts:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        n = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), n, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def words_got(df):
    return sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


def bytes_got(df):
    return sorted(
        ((-(2**63) if r["doc_id"] is None else r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in df.collect()
    )


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q = some(420), some(500)
    rows = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a" * 3000), (10**6 + 3, "xyz " * 400), (10**6 + 4, "xyz\t" * 300), (None, p), (None, None)]
    rows += [(10**6 + 10 + k, some(rng.randint(0, 300)) + p[rng.randint(0, 3) : 420 - rng.randint(0, 3)] + some(rng.randint(0, 300))) for k in range(30)]
    rows += [(10**6 + 60 + k, some(rng.randint(0, 300)) + q + some(rng.randint(0, 300))) for k in range(20)]
    return rows + [(10**6 + 60, "x" + q), (10**6 + 61, rows[-1][1]), (10**6 + 61, rows[-1][1])]


def test_windows_equal_brute_force(frame, small_docs, odd_rows):
    rows = list(zip(small_docs["doc_id"].tolist(), small_docs["text"])) + odd_rows
    got = remove_repeated_windows(frame(rows))
    assert words_got(got) == brute_words(rows)
    for r in got.collect():
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("hot", [1000, 3])
def test_bytes_equal_brute_force(frame, small_docs, odd_rows, hot):
    rows = list(zip(small_docs["doc_id"].tolist(), small_docs["text"])) + odd_rows
    assert bytes_got(remove_repeats(frame(rows), hot=hot)) == brute_bytes(rows, LENGTH)


def test_shared_runs(frame):
    """A passage shorter than the removed length shows in n_shared; documents without a common string of a gram do not."""
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, copy = some(330), some(600)
    rows = [(k, some(900)) for k in range(30)] + [(100 + k, some(rng.randrange(600)) + passage + some(600)) for k in range(30)]
    rows += [(200, copy), (201, copy), (202, None), (203, some(300))]
    got = {r["doc_id"]: (r["n_removed"], r["n_shared"]) for r in remove_repeats(frame(rows)).collect()}
    assert all(got[k] == (0, 0) for k in (*range(30), 202, 203)) and all(got[k][0] == 600 and got[k][1] > 0 for k in (200, 201))
    assert all(got[100 + k][0] == 0 for k in range(30)) and sum(got[100 + k][1] > 0 for k in range(30)) >= 27


def test_long_text_is_cut_with_overlap(frame, monkeypatch):
    from phrasedex.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CHUNK", 1500)
    rng = random.Random(3)
    p = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(1, "".join(rng.choice("abcdefgh") for _ in range(1400)) + p + "".join(rng.choice("abcdefgh") for _ in range(3000))), (2, "zz" + p + "zz")]
    assert bytes_got(remove_repeats(frame(rows))) == brute_bytes(rows, LENGTH)


def test_empty_tables(frame):
    assert remove_repeats(frame([])).collect() == []
    assert remove_repeated_windows(frame([])).collect() == []


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(250):
        letters = rng.choice([b"a", b"ab", b"abc", b"abcdefgh", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        texts += texts[:2] if rng.random() < 0.5 else []
        t, _ = join_texts(texts)
        closed = np.cumsum(t == 0)
        own = [int(closed[i]) if x == 0 else int(x) + 10**6 for i, x in enumerate(t)]
        want = sorted(range(len(own)), key=lambda i: own[i:])
        sa = suffix_array(t)
        assert sa.tolist() == want
        length, before = permuted_common_prefixes(t, sa)
        for a, b in zip(want[1:], want):
            k = 0
            while max(a, b) + k < len(own) and own[a + k] == own[b + k]:
                k += 1
            assert length[a] == k and before[a] == b


def test_texts_are_hashed_in_small_pieces():
    """Short texts are taken some at a time, and no run differs from those of each text alone."""
    from phrasedex.llm.suffix_dedup import CACHED, _pieces, _Runs

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 30_000, 5, 39, 40, 41, 0, 60_000, 50_000, 0)]
    sizes = [sum(b - a for _, a, b in p) for p in _pieces(texts, 40)]
    assert max(sizes) <= CACHED and sum(sizes) == sum(map(len, texts))
    together = _Runs(texts, 40, 12)
    at = 0
    for d, t in enumerate(texts):
        alone = _Runs([t], 40, 12)
        n = len(alone.doc)
        assert (together.doc[at : at + n] == d).all()
        for name in ("s0", "s1", "gram", "context"):
            assert (getattr(together, name)[at : at + n] == getattr(alone, name)).all()
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(alone.s0, alone.s1)]) if n else np.empty(0)
        assert starts.tolist() == list(range(max(0, len(t) - 39)))
        at += n
    assert at == len(together.doc)
