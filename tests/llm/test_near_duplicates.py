import re

import numpy as np
import pytest

from phrasedex.llm import near_duplicates as N
from phrasedex.llm.components import components

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(frame, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(frame(rows)).collect()}
    want = brute(rows)
    assert got == want
    return want


def test_equals_brute_force(frame):
    rng = np.random.default_rng(2)
    text = lambda n: ["w%d" % rng.integers(500) for _ in range(n)]
    rows, base = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "É a"), (906, "é a")], text(120)
    chain = list(base)
    for k in range(40):  # near copies of one text, and a chain that drifts away from it
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            w[j] = "x"
        rows.append((k, " ".join(w)))
        chain[(7 * k) % 120] = f"c{k}"
        rows.append((100 + k, " ".join(chain)))
        rows.append((200 + k, " ".join(text(60))))
    rows += [(300 + k, rows[10][1].upper()) for k in range(20)]
    assert len({c for _, c in check(frame, rows).values()}) < len(rows) - 50


def test_real_documents(frame, small_docs):
    check(frame, list(zip(small_docs["doc_id"].tolist(), small_docs["text"])))


def test_cross_pairs_find_what_leaders_miss(spark, frame, monkeypatch):
    """With tiles of two members, every pair of a large key still meets."""
    monkeypatch.setattr(N, "TILE", 2)
    rng = np.random.default_rng(4)
    base = ["w%d" % rng.integers(500) for _ in range(80)]
    rows = []
    for k in range(30):
        w = list(base)
        for j in rng.choice(80, rng.integers(1, 3), replace=False):
            w[j] = f"y{k}"
        rows.append((k, " ".join(w)))
    check(frame, rows)


def test_multi_index_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 65536, N.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(N.SYMBOLS, N.DISTANCE, replace=False)
        b[at] ^= rng.integers(1, 65536, N.DISTANCE).astype(np.uint16)
        ka, kb = N.chunk_keys(np.stack([a, b]))
        assert (ka == kb).any()


def test_first_shared_key():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 65536, N.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(N.SYMBOLS, int(rng.integers(0, N.DISTANCE + 1)), replace=False)
        b[at] ^= 1
        ka, kb = N.chunk_keys(np.stack([a, b]))
        assert N.first_keys((a == b)[None])[0] == np.flatnonzero(ka == kb)[0]


def test_confirmed_links():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    comp = rng.integers(0, 25, 40).tolist()
    got = N.confirmed(sets, comp, None)
    assert all(N.similar(sets[i], sets[j]) for i, j in got) and len(got) < 40
    root = {i: comp.index(c) for i, c in enumerate(comp)}

    def find(links):
        up = dict(root)
        for _ in range(40):
            for i, j in [*links, *root.items()]:
                up[i] = up[j] = min(up[i], up[j])
        return up

    every = [(i, j) for j in range(40) for i in range(j) if N.similar(sets[i], sets[j])]
    assert find(got) == find(every)


def test_keep_one_each_and_empty(frame):
    df = frame([(3, "a b c d e f"), (1, "a b c d e f"), (2, None), (4, ""), (None, "a b c d e f")])
    assert sorted((r["doc_id"] or 0) for r in N.keep_one_each(df).collect()) == [1, 2, 4]
    assert N.near_duplicates(frame([])).collect() == []


def test_repeated_rows(frame):
    got = N.near_duplicates(frame([(5, "a b c d e f g")] * 3)).collect()
    assert [(r["component_id"], r["kept"]) for r in got] == [(5, True)] * 3


def test_null_and_repeated_ids_have_rows_of_their_own(frame):
    one, two, three = "a b c d e f g", "h i j k l m n", "p q r s t u"
    rows = [(None, one), (7, one), (9, one.upper()), (7, two), (8, two), (None, three), (None, three), (None, None), (4, ""), (4, three + " v")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(frame(rows)).collect()]
    want = [
        (None, 3, 7, False), (7, 3, 7, True), (9, 3, 7, False), (7, 3, 7, True), (8, 3, 7, False),
        (None, 2, None, True), (None, 2, None, True), (None, 0, None, True), (4, 0, 4, True), (4, 3, 4, True),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_row_of_repeated_and_null_ids(frame):
    one, two = "a b c d e f g", "h i j k l m n"
    rows = [(5, one), (5, one), (5, one), (5, two), (6, two), (9, one.upper()), (None, "p q r s t u"), (None, "p q r s t u"), (3, None), (3, None)]
    got = N.keep_one_each(frame(rows))
    assert got.columns == frame([]).columns
    want = [(3, None), (3, None), (5, one), (5, two), (None, "p q r s t u")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("links, want", [([], {}), ([(1, 1)], {}), ([(5, 4), (4, 3), (9, 8), (3, 2), (2, 1)], {5: 1, 4: 1, 3: 1, 2: 1, 9: 8})])
def test_components(spark, links, want):
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == want


def test_no_table_is_broadcast_by_its_estimated_size(spark, frame, monkeypatch):
    # Spark takes the shared keys of an explode for smaller than the limit; at 0.5 GB they were broadcast and filled the driver.
    plans, stored = [], N._stored

    def noted(df, name):
        plans.append((name, df))
        return stored(df, name)

    monkeypatch.setattr(N, "_stored", noted)
    text = " ".join(f"w{k}" for k in range(60))
    docs = frame([(k, text + f" x{k % 5}") for k in range(20)] + [(99, "another text")])
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        plans.append(("kept", N.keep_one_each(docs)))
        for name, df in plans:
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString(), name
        assert {"members", "close", "second-links", "class-components"} <= {name for name, _ in plans}
        assert sorted(r["doc_id"] for r in plans[-1][1].collect()) == [0, 99]
    finally:
        spark.conf.set(key, before)
