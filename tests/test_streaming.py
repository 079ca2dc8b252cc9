"""Phrase files answered by the stream equal the same phrases answered as one batch."""

import os

from pyspark.sql import functions as F

from phrasedex.plans.build import build_index
from phrasedex.plans.search import search_batch
from phrasedex.session import local_path, shared_dir
from phrasedex.streaming import start_phrase_stream


def test_stream_equals_batch(spark):
    docs = spark.createDataFrame(
        [(1, "civil war fighting"), (2, "the civil war"), (3, "war civil")], "doc_id long, body string"
    )
    index = shared_dir(spark, "t-stream-index")
    build_index(spark, docs, index, num_files=2)
    phrases = local_path(shared_dir(spark, "t-stream-in"))
    os.makedirs(phrases)
    with open(f"{phrases}/a.txt", "w") as f:
        f.write("civil war\nwar\n\n")
    with open(f"{phrases}/b.txt", "w") as f:
        f.write("war civil\nwar fights\n")
    out = shared_dir(spark, "t-stream-out")
    q = start_phrase_stream(spark, index, phrases, out, available_now=True)
    q.awaitTermination(120)
    queries = spark.read.parquet(f"{out}/queries")
    docs_out = spark.read.parquet(f"{out}/docs").join(queries, "query_id")
    got = {(r.query, r.doc_id, r.n_matches) for r in docs_out.collect()}

    batch_q = spark.createDataFrame(list(enumerate(["civil war", "war", "war civil", "war fights"], 1)),
                                    "query_id long, query string")
    res = search_batch(spark, index, batch_q)
    want = {(r.query, r.doc_id, r.n_matches) for r in res.docs.join(batch_q, "query_id").collect()}
    assert got == want
    assert ("civil war", 2, 1) in got and ("war civil", 3, 1) in got
    assert queries.select(F.countDistinct("query_id")).first()[0] == 4
