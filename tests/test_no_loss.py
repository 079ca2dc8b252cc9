"""Cases in which rows were once lost or mixed: overlapping index parts, large positions, ids, file order, large stop lists."""

import pytest
from pyspark.sql import functions as F

from phrasedex.operators import benchmark_phrases, candidate_docs, lookup_terms, parse_queries, phrase_match, with_bucket
from phrasedex.plans.build import build_index, corpus_postings
from phrasedex.plans.search import search_batch, search_phrase
from phrasedex.sources import conversation_documents, postings_from_text, read_queries, remove_stopwords
from phrasedex.sources import corpus as corpus_source
from phrasedex.sources.index_store import write_index


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, body string")


def test_document_in_two_index_roots(spark, tmp_path):
    both, a, b = (1, "civil war"), [(2, "the civil war")], [(3, "war")]
    for name, rows in (("a", [both, *a]), ("b", [both, *b])):
        build_index(spark, docs_of(spark, rows), str(tmp_path / name))
    q = spark.createDataFrame([(1, "civil war"), (2, "war")], "query_id long, query string")
    res = search_batch(spark, [str(tmp_path / "a"), str(tmp_path / "b")], q)
    assert sorted(map(tuple, res.matches.collect())) == [(1, 1, 0), (1, 2, 4), (2, 1, 6), (2, 2, 10), (2, 3, 0)]
    # Repeated index rows change nothing either, whoever made the table.
    index = with_bucket(corpus_postings(docs_of(spark, [both, *a])))
    lookup = lookup_terms(index.unionByName(index.where("doc_id = 1")), parse_queries(q.where("query_id = 1")))
    assert sorted(map(tuple, candidate_docs(lookup).collect())) == [(1, 1), (1, 2)]
    assert sorted(map(tuple, phrase_match(lookup).collect())) == [(1, 1, 0), (1, 2, 4)]


def test_large_positions_are_read(spark):
    got = postings_from_text(spark.createDataFrame([("a 1|5,2|3000000000:7",)], "line string"))
    assert sorted((r["doc_id"], list(r["positions"])) for r in got.collect()) == [(1, [5]), (2, [3000000000, 7])]


def test_turns_never_share_a_document(spark):
    rows = [(1, 1000, "u", "x"), (2, 0, "u", "y"), (9007199254740993, 999, "u", "z")]
    ids = conversation_documents(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert sorted(tuple(r["doc_id"]) for r in ids.collect()) == [(1, 1000), (2, 0), (9007199254740993, 999)]


def test_clause_ids_never_overflow(spark):
    items = spark.createDataFrame([(2**62, "one two.")], "item_id long, text string")
    with pytest.raises(Exception, match="no clause id"):
        benchmark_phrases(items).collect()


def test_phrase_files_are_numbered_in_name_order(spark, tmp_path):
    (tmp_path / "b.txt").write_text("".join(f"line {i}\n\n" for i in range(40)))
    (tmp_path / "a.txt").write_text("first\n")
    got = {r["query_id"]: r["query"] for r in read_queries(spark, str(tmp_path)).collect()}
    assert got == {1: "first", **{i + 2: f"line {i}" for i in range(40)}}


def test_large_stop_list_is_joined(spark, monkeypatch):
    docs = docs_of(spark, [(1, "The cat\n\nand THE  dog the>\nthe"), (2, None), (3, ""), (1, "The cat\n\nand THE  dog the>\nthe"), (4, "the\nthe")])
    stops = spark.createDataFrame([("the",), ("and",)], "word string")
    want = sorted(map(str, remove_stopwords(docs, stops).collect()))
    monkeypatch.setattr(corpus_source, "MAX_LITERAL_STOP_WORDS", 1)
    assert sorted(map(str, remove_stopwords(docs, stops).collect())) == want


def test_empty_phrase_has_the_usual_columns(spark, tmp_path):
    build_index(spark, docs_of(spark, [(1, "civil war")]), str(tmp_path / "i"))
    empty, full = search_phrase(spark, str(tmp_path / "i"), " -- "), search_phrase(spark, str(tmp_path / "i"), "civil war")
    for part in ("parsed", "lookup", "matches", "docs", "steps"):
        assert getattr(empty, part).columns == getattr(full, part).columns and getattr(empty, part).count() == 0


def test_routes_give_the_same_answers(spark, tmp_path):
    rows = [(i, " ".join("ab cd ef gh".split()[(i + k) % 4] for k in range(6))) for i in range(40)] + [(99, "rare ab cd")]
    build_index(spark, docs_of(spark, rows), str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "ab cd"), (2, "rare ab"), (3, "gh ab cd"), (4, "ef")], "query_id long, query string")
    runs = [search_batch(spark, str(tmp_path / "i"), q, max_needed=n).matches for n in (0, 4, 100, 10**6)]
    found = [sorted(map(tuple, r.select("query_id", "doc_id", F.col("start_pos")).collect())) for r in runs]
    assert found[0] and all(f == found[0] for f in found)


def test_several_roots_are_merged_once(spark, tmp_path):
    # Odd tokens of document 1 are in one index, even ones in the other; a word that no phrase has is not read on.
    halves = [("a", [("civil", 1, [0]), ("fight", 1, [10]), ("civil", 2, [5])]), ("b", [("war", 1, [6]), ("war", 2, [11]), ("other", 2, [0])])]
    for name, rows in halves:
        write_index(spark.createDataFrame(rows, "term string, doc_id long, positions array<int>"), str(tmp_path / name), num_files=1)
    q = spark.createDataFrame([(1, "civil war"), (2, "war fights"), (3, "war")], "query_id long, query string")
    for options in ({}, {"max_literal_terms": 1}, {"max_broadcast_words": 0, "max_broadcast_candidates": 0, "max_needed": 0}):
        res = search_batch(spark, [str(tmp_path / "a"), str(tmp_path / "b")], q, **options)
        assert sorted(map(tuple, res.docs.collect())) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1), (3, 2, 1)]
        assert sorted(map(tuple, res.steps.collect())) == [(1, 1, 1, 0), (1, 2, 1, 5), (2, 1, 1, 6)]
        # Postings meet before the search, not in each of its reads.
        assert "collect_list(positions" not in res.docs._jdf.queryExecution().toString()
