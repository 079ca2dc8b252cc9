"""Tokens, offsets, normalisation, stop words: the hand-traced example."""

from pyspark.sql import functions as F

from phrasedex.functions.text import bucket_of
from phrasedex.operators import tokenize, with_words
from phrasedex.plans.build import corpus_postings
from phrasedex.sources import parse_marked_documents, remove_stopwords
from tests.conftest import FIXTURE_DOC


def _doc(spark):
    seg = spark.createDataFrame([(FIXTURE_DOC,)], "segment string")
    return parse_marked_documents(seg)


def test_header_and_id(spark):
    rows = _doc(spark).collect()
    assert [(r.doc_id, r.body) for r in rows] == [(12, "Civil War\n\nCivil war fighting, foo-bar\n")]


def test_offsets_count_raw_length(spark):
    toks = [(r.raw, r.pos) for r in tokenize(_doc(spark)).orderBy("ord").collect()]
    assert toks == [("Civil", 0), ("War", 6), ("Civil", 10), ("war", 16), ("fighting,", 20), ("foo-bar", 30)]


def test_sub_tokens_share_offset(spark):
    words = sorted((r.pos, r.word) for r in with_words(_doc(spark)).collect())
    assert (30, "bar") in words and (30, "foo") in words and (20, "fighting") in words


def test_postings_and_buckets(spark):
    post = corpus_postings(_doc(spark)).withColumn("bucket", bucket_of(F.col("term")))
    got = {r.term: (r.doc_id, list(r.positions), r.bucket) for r in post.collect()}
    assert got == {
        "civil": (12, [0, 10], 2),
        "war": (12, [6, 16], 22),
        "fight": (12, [20], 5),
        "foo": (12, [30], 5),
        "bar": (12, [30], 1),
    }


def test_digit_bucket(spark):
    df = spark.createDataFrame([("1990s",), ("m80a",)], "term string")
    assert [r[0] for r in df.select(bucket_of("term")).collect()] == [1, 12]


def test_stopword_pass_then_offsets(spark):
    docs = spark.createDataFrame([(1, "The war, the. And war of the")], "doc_id long, body string")
    cleaned = remove_stopwords(docs).collect()[0].body
    assert cleaned == "war, the. war \n"
    toks = [(r.raw, r.pos) for r in tokenize(docs, stopwords=["the", "and", "of"]).orderBy("ord").collect()]
    assert toks == [("war,", 0), ("the.", 5), ("war", 10)]


def test_empty_and_blank_bodies(spark):
    docs = spark.createDataFrame([(1, ""), (2, "   \n "), (3, None), (4, "x")], "doc_id long, body string")
    toks = [(r.doc_id, r.raw, r.pos) for r in tokenize(docs).collect()]
    assert toks == [(4, "x", 0)]


def test_unicode_lengths_are_code_points(spark):
    docs = spark.createDataFrame([(1, "geäü 😀x ab")], "doc_id long, body string")
    toks = [(r.raw, r.pos) for r in tokenize(docs).orderBy("ord").collect()]
    assert toks == [("geäü", 0), ("😀x", 5), ("ab", 8)]
