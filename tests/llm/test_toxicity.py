import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from phrasedex.llm import toxicity as X


def weights(word):
    out = defaultdict(float)
    w = "^" + word
    for at in itertools.combinations(range(len(w)), X.LENGTH):
        out[tuple(w[i] for i in at)] += X.DECAY ** (at[-1] - at[0] + 1)
    return out


def brute(a, b):
    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items() if k in q)
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_equals_definition():
    marks = ["idiot", "scum", "loweiß", "aaab"]
    model = X.ToxicityModel(marks)
    words = ["idiot", "idxiot", "scu", "aaaa", "zq", "loweichen", "ßßßß"]
    got = model.similar(words)
    for i, w in enumerate(words):
        for j, z in enumerate(marks):
            assert abs(got[i, j] - (brute(w, z) if len(w) >= 2 else 0)) < 1e-4
    rng = np.random.default_rng(0)
    model.weights, model.bias = rng.standard_normal(4).astype(np.float32), 0.3
    assert np.allclose(model.decide(words), model.features(words) @ model.weights + 0.3, atol=1e-3)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = X.train(docs.where(~X.held_out()), labels.where(~X.held_out()))
    test = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(X.held_out()).limit(1500)
    out = test.select("toxic", X.toxicity_column(spark, model, F.col("text")).alias("score")).toPandas()
    # 10,000 documents: README has the figures of larger tables.
    said, toxic = out["score"] >= X.THRESHOLD, out["toxic"] == 1
    assert (said & toxic).sum() >= 0.8 * toxic.sum() and (said & ~toxic).sum() <= 0.06 * (~toxic).sum()
    value = lambda t: float(model.text_values([t])[0])
    plain_text = "the of and thion"
    for bent in ("m.o.r.o.n", "m o r o n", "MORON!!"):
        assert value(f"{plain_text} {bent} {plain_text}") == value(f"{plain_text} moron {plain_text}")
    assert value(f"{plain_text} moxron") > value(plain_text)


def test_defined_cases(spark, frame):
    texts = ["you idiot", "nice day here"] * 12
    model = X.fit(texts, [1, 0] * 12, 1.0)
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "idiot"), (4, "idiot"), (5, "nice " * 30_000), (6, "z" * 50_000)]
    df = frame(rows).select("doc_id", X.toxicity_column(spark, model, F.col("text")).alias("score"))
    got = pd.Series({r["doc_id"]: r["score"] for r in df.collect()})
    assert got[1] == got[2] == got[3] == got.min() and got[4] == got.max() and got.between(0, 1).all()
    assert X.fit(["a b"], [0], 1.0) is None
    none = frame([(1, "x")]).select(X.toxicity_column(spark, None, F.col("text")).alias("s")).first()["s"]
    assert none == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.train(frame(rows), labels) is None


def test_insult_in_one_clean_text_stays_an_insult():
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(12))
    rows = [(f"{text()} {'moron' if k % 2 else 'scum'}", 1) for k in range(90)] + [(text(), 0) for _ in range(210)]
    rows[100] = (rows[100][0] + " moron", 0)
    assert 100 % 3 != 2  # a text that the machine is fitted on
    model = X.fit([t for t, _ in rows], [y for _, y in rows], 210 / 90)
    moron, scum = model.decide(["moron", "scum"])
    assert moron > 0.5 and scum > 0.5
