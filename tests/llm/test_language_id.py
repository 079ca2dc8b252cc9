import numpy as np
from pyspark.sql import functions as F

from phrasedex.llm import language_id as L


def brute_bits(train: bytes, text: bytes) -> float:
    """Code length by the definition: longest seen context first, method C escapes."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in train:
        t = L.START + t
        for i in range(L.MAX_ORDER, len(t)):
            for k in range(L.MAX_ORDER + 1):
                counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[t[i - k : i]][t[i]] += 1
    bits, text = 0.0, L.START + text
    for i in range(L.MAX_ORDER, len(text)):
        for k in range(L.MAX_ORDER, -1, -1):
            seen = counts.get(text[i - k : i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= np.log2(seen[text[i]] / (total + kinds))
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_definition(monkeypatch):
    train = {"a": [b"the cat sat on the mat", b"the hat", "é".encode()], "b": [b"le chat est la", b"le la les"]}
    model = L.build_model({k: L.count_grams(v) for k, v in train.items()})
    texts = [b"the chat", b"", b"zzz \xff\x00", b"la mat est on the la le" * 3]
    monkeypatch.setattr(L, "BLOCK", 16)
    got = model.totals(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - brute_bits(train[lang], t)) < 1e-3 * (1 + len(t))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.where(~L.held_out()))
    out = docs.select("lang", L.held_out().alias("held_out"), L.language_column(spark, model, F.col("text")).alias("p"))
    out = out.where("held_out").select("lang", "p.lang_pred", "p.score").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all()
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_defined_cases(spark, frame):
    train = frame([(1, "the cat and the dog"), (2, None)]).withColumn("lang", F.lit("en"))
    model = L.train(train)
    texts = [None, "", "12 ½ ²!", "the cat", "the cat", "é" * 70_000]
    out = frame(list(enumerate(texts))).select("doc_id", L.language_column(spark, model, F.col("text")).alias("p")).select("doc_id", "p.*").toPandas()
    out = out.sort_values("doc_id")
    assert out["lang_pred"].tolist() == ["und"] * 3 + ["en"] * 3
    assert out["score"].tolist()[:5] == [0, 0, 0, 1, 1]
    assert L.train(train.where("false")) is None and L.train(train.withColumn("lang", F.lit(None))) is None
    none = frame([(1, "x")]).select(L.language_column(spark, None, F.col("text")).alias("p")).first()["p"]
    assert none["lang_pred"] == "und" and none["score"] == 0
    empty = frame([])
    assert L.keep_identified(empty, model).collect() == []


def test_letters():
    assert [L.has_letter(t) for t in (None, "", "½_1", "½é", "Ⅷ", "中")] == [False, False, False, True, False, True]
