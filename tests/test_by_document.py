"""Words cut in batches, postings that lie by document, and lookups through a phrase's rarest word."""

import re

from pyspark.sql import functions as F

from phrasedex.functions.porter import stem_of_word
from phrasedex.functions.porter_batch import stems_of
from phrasedex.operators import (
    candidate_docs,
    document_terms,
    lookup_aligned,
    lookup_rarest,
    lookup_terms,
    matching_docs,
    parse_queries,
    partial_phrase_matches,
    phrase_match,
    with_bucket,
    with_words,
    word_counts,
)
from phrasedex.plans.build import corpus_postings
from phrasedex.session import ship_package

TEXTS = ["The war of Kings", "the-war the\x0bwar é war", None, "", "--", "𝒳 fights a war", "of the king", "war war2wars of the king's war"]


def _docs(spark):
    rows = [(i % 7 if i != 5 else None, TEXTS[i % len(TEXTS)]) for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, body string")


def _rows(df):
    return sorted(map(str, df.collect()))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_by_document_shuffle_texts_only(spark):
    docs = _docs(spark)
    got = corpus_postings(docs, by="document")
    assert len([line for line in _plan(got).splitlines() if "Exchange " in line]) == 1
    assert _rows(got) == _rows(corpus_postings(docs)) == _rows(corpus_postings(docs, frequent_words=3, by="word"))
    counts = with_words(docs).groupBy("word").agg(F.count("*").alias("n"))
    assert _rows(word_counts(docs)) == _rows(counts)
    numbered = document_terms(docs, numbers=True).where("term = 'king'").where("doc_id = 6").first()
    assert list(numbered["tokens"]) and len(numbered["tokens"]) == len(numbered["positions"])


def test_batch_stems_equal_the_expression(spark):
    ship_package(spark)
    words = "relational generalizations hopping hoping skies syzygy m80a running2running ion passion ies yyed controlling bling agreed".split()
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert df.where(stem_of_word() != stems_of(F.col("word"))).count() == 0


def test_rarest_word_gives_the_same_matches(spark):
    index = with_bucket(corpus_postings(_docs(spark), by="document")).checkpoint()
    phrases = ["the war", "war of kings", "of the king", "missing war", "war war", "a war"]
    parsed = parse_queries(spark.createDataFrame(list(enumerate(phrases)), "query_id long, query string")).checkpoint()
    for small in (True, False):
        plain, rare = lookup_terms(index, parsed, small), lookup_rarest(index, parsed, small)
        for match in (candidate_docs, matching_docs, partial_phrase_matches) if small else (matching_docs,):
            want = [r for r in _rows(match(plain)) if "doc_id=None" not in r]
            assert _rows(match(rare)) == want
    # Phrases do not meet the postings of their frequent words in every document, and matches are counted where rows lie.
    assert rare.count() < plain.count()
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+, doc_id", _plan(matching_docs(lookup_rarest(index, parsed, True))))


def test_positions_without_the_rarest_words_vote_are_not_expanded(spark):
    docs = _docs(spark).unionByName(spark.createDataFrame([(50, "the " * 40 + "king of the " + "of " * 40), (51, "of the")], "doc_id long, body string"))
    index = with_bucket(corpus_postings(docs, by="document")).checkpoint()
    phrases = ["the war", "war of kings", "of the king", "king of the of", "missing war", "war war", "a war"]
    parsed = parse_queries(spark.createDataFrame(list(enumerate(phrases)), "query_id long, query string")).checkpoint()
    for small in (True, False):
        rare, cut = lookup_rarest(index, parsed, small), lookup_aligned(index, parsed, small)
        for match in (matching_docs, phrase_match) if small else (phrase_match,):
            want = [r for r in _rows(match(lookup_terms(index, parsed, small))) if "doc_id=None" not in r]
            assert _rows(match(cut, aligned=True)) == _rows(match(rare)) == want
    votes = [df.where("doc_id = 50").agg(F.sum(F.size("positions"))).first()[0] for df in (rare, cut)]
    assert votes[0] > 200 and votes[1] < votes[0] / 4
