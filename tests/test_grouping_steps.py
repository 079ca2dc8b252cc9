"""Rows grouped where they lie: blocks of ids, ranks of terms, words of a batch, counts and bits read once."""

import pyarrow as pa
from pyspark.sql import functions as F

from phrasedex.functions import porter_batch
from phrasedex.operators import build_inverted_index, candidate_docs, lookup_terms, parse_queries, postings, with_bucket
from phrasedex.operators.bitmaps import set_bits
from phrasedex.operators.words import grouped_terms
from phrasedex.plans.build import corpus_postings
from phrasedex.sources import postings_to_text

TEXTS = ["The war of Kings", "the-war the war", None, "", "fights a war", "of the king", "war war2wars of the king's war"]


def _docs(spark):
    rows = [(i * 3 - 9 if i != 5 else None, TEXTS[i % len(TEXTS)]) for i in range(24)]
    return spark.createDataFrame([*rows, *rows[:2]], "doc_id long, body string")


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_offsets_ascend_beside_a_document_without_text():
    # As many texts as documents, though one has none and one has two.
    got = grouped_terms(pa.array([[], ["war a war", "a war"]])).to_pylist()
    assert got[0] == [] and {g["word"]: g["positions"] for g in got[1]} == {"war": [0, 2, 6], "a": [0, 4]}


def test_texts_lie_by_block_of_ids(spark):
    plain, blocks = (corpus_postings(_docs(spark), by="document", **o) for o in ({}, {"docs_per_block": 8}))
    assert "Exchange hashpartitioning(block" in _plan(blocks)
    assert _rows(blocks.drop("block")) == _rows(plain)
    assert blocks.where(~F.col("block").eqNullSafe(F.floor(F.col("doc_id") / 8))).count() == 0
    assert _rows(build_inverted_index(blocks, 8)) == _rows(build_inverted_index(plain, 8))
    assert _rows(postings_to_text(blocks, "tab", 8)) == _rows(postings_to_text(plain, "tab", 8))


def test_ranked_terms_are_grouped_where_they_are_ranked(spark, monkeypatch):
    plain = corpus_postings(_docs(spark), by="document")
    whole = build_inverted_index(plain, 3, by_rank=True)
    assert _plan(whole).count("Exchange ") == 1
    want: dict[str, list] = {}
    for r in sorted(plain.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        want.setdefault(r["term"], []).append((r["doc_id"], list(r["positions"])))
    blocks = {(t, i // 3): rows[i : i + 3] for t, rows in want.items() for i in range(0, len(rows), 3)}
    # Terms of more than four documents on two levels, the others at once.
    monkeypatch.setattr(postings, "RANK_IN_TASK", 4)
    for inv in (whole, build_inverted_index(plain, 3, by_rank=True)):
        assert {(r["term"], r["block"]): [(p["doc_id"], list(p["positions"])) for p in r["postings"]] for r in inv.collect()} == blocks


def test_a_posting_meets_its_term_once(spark):
    index = with_bucket(corpus_postings(_docs(spark), by="document")).checkpoint()
    queries = [(1, "the war"), (2, "war"), (2, "war"), (3, "of the king of the war"), (4, "missing")]
    parsed = parse_queries(spark.createDataFrame(queries, "query_id long, query string")).checkpoint()
    got = lookup_terms(index, parsed, broadcast_queries=True)
    assert "Generate explode(uses" in _plan(got)
    assert _rows(got) == _rows(lookup_terms(index, parsed))


def test_texts_are_cut_once_for_a_batch(spark):
    import __spark_entry__ as entry

    index = with_bucket(corpus_postings(_docs(spark), by="document"))
    queries = spark.createDataFrame([(1, "the war"), (2, "war"), (3, "missing war")], "query_id long, query string")
    parsed = parse_queries(queries).checkpoint()
    got = entry._matched(index, parsed, True, candidate_docs)
    assert "ArrowEvalPython" not in _plan(got)
    want = candidate_docs(lookup_terms(index, parsed))
    assert _rows(got.where("doc_id IS NOT NULL")) == _rows(want.where("doc_id IS NOT NULL"))


def test_bits_of_a_bitmap(spark):
    wanted = [0, 7, 8, 63, 64, 71, 12345, 32767]
    data = bytearray(4096)
    for i in wanted:
        data[i // 8] |= 1 << i % 8
    df = spark.createDataFrame([(data,), (bytearray(4096),), (bytearray(b"\xff" * 4096),)], "b binary").select(set_bits(F.col("b")).alias("bits"))
    assert [list(r["bits"]) for r in df.collect()] == [wanted, [], list(range(32768))]
    # A word's number is read once, not a byte for each bit.
    assert "power" not in _plan(df).lower()


def test_words_are_counted_once(spark):
    words = corpus_postings(_docs(spark), frequent_words=3, by="word")
    assert "MapInArrow" not in _plan(words)
    assert _rows(words) == _rows(corpus_postings(_docs(spark), by="document"))


def test_a_word_meets_the_rules_of_its_end_only():
    assert {r[0][-2:] for r in porter_batch._STEP2["al"]} == {"al"}
    rules = [r for rs in porter_batch._STEP2.values() for r in rs]
    assert sorted(rules) == sorted(porter_batch.STEP2_RULES) and max(map(len, porter_batch._STEP2.values())) < 8
