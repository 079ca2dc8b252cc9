import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from phrasedex.llm import vector_search as V


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[ids.index(q)]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def answers(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    ids, x = e["vec_id"].tolist(), np.stack(e["embedding"]).astype(float)
    got = answers(V.op9_vector_search(spark, sf))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(found) >= 0.9
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(scores.get((q, i), s) == s for q in got for i, s in got[q])


def test_copies_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 7)
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((60, 4)), 2)
    rows = [(i, x[i % 50].tolist(), "b") for i in range(90)]
    rows += [(100, None, "b"), (120, [0.0] * 4, "b"), (140, [1.0, None, 2.0, 3.0], "b"), (160, [1.0, float("nan"), 0.0, 0.0], "b"), (180, [1.0, 2.0], "b"), (200, [1.0, float("inf"), 1.0, 1.0], "b"), (None, [1.0] * 4, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    got = answers(V.search(df, F.col("vec_id") % 20 == 0, k=5))
    want = brute(list(range(90)), np.array([x[i % 50] for i in range(90)]), [0, 20, 40, 60, 80], 5)
    assert got == want


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(4)
    parts = {4: np.round(rng.standard_normal((50, 4)), 2), 9: np.round(rng.standard_normal((45, 9)), 2)}
    rows = [(i, x.tolist()) for i, x in enumerate(parts[4])] + [(100 + i, x.tolist()) for i, x in enumerate(parts[9])] + [(300, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(list(range(50)), parts[4], [0, 20, 40], 5) | brute(list(range(100, 145)), parts[9], [100, 120, 140], 5)
    assert answers(V.search(df, F.col("vec_id") % 20 == 0, k=5)) == want


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert answers(V.search(df, F.col("vec_id") == 0)) == {0: [(1, 0.5), (2, -1.0)]}
    assert V.search(df, F.col("vec_id") == 77).collect() == []
    assert V.search(df.where("false"), F.col("vec_id") == 0).collect() == []
