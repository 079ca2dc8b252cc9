"""Document bitmaps, next-word postings, sub-bucket pruning, words grouped in the row."""

import random

from pyspark.sql import functions as F

from phrasedex.operators import (
    build_next_words,
    build_postings,
    candidate_docs,
    candidate_docs_by_bitmap,
    document_texts,
    document_words,
    frequent_lengths,
    lookup_terms,
    parse_queries,
    partial_phrase_matches,
    phrase_blocks,
    phrase_match,
    phrase_match_with_pairs,
    stem_vocabulary,
    with_bucket,
    with_words,
)
from phrasedex.operators.bitmaps import dense
from phrasedex.operators.next_words import covered_phrases, pair_matches
from phrasedex.operators.stemming import apply_stems
from phrasedex.sources.index_store import read_index, write_merged_index


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _corpus(spark, ids, seed=3):
    rng = random.Random(seed)
    words = "the of fight fights fighting war wars king kings-road ab a".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in ids] + [(ids[0], "the war of kings"), (ids[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    terms = with_words(docs)
    vocab = stem_vocabulary(terms, with_counts=True)
    phrases = ["the war", "war of the king", "fighting the war", "the fights of kings", "king", "the the", "of a road", "missing word", "fights ab dog", "the"]
    parsed = parse_queries(spark.createDataFrame(list(enumerate(phrases)), "query_id long, query string"))
    return docs, apply_stems(terms, vocab).select("doc_id", "pos", "term"), vocab, parsed


def test_bitmap_and_equals_posting_rows(spark):
    # Ids on both sides of zero, at block ends, and far apart.
    ids = [-40_000, -32_768, -1, 0, 1, 2, 63, 64, 65, 32_768, 32_769, 65_537, 2**40, 2**40 + 7, *range(100, 160)]
    _, terms, _, parsed = _corpus(spark, ids)
    index = with_bucket(build_postings(terms))
    want = _rows(candidate_docs(lookup_terms(index, parsed, True)))
    assert _rows(candidate_docs_by_bitmap(index, parsed)) == want and len(want) > 100
    blocks = index.select(F.bitmap_bucket_number("doc_id")).distinct().count()
    words = parsed.select("query_id", "term").distinct().count()
    # Rows before the AND: words times blocks, not words times documents.
    assert phrase_blocks(index, parsed).count() <= words * blocks < lookup_terms(index, parsed, True).count()
    assert not dense(index) and candidate_docs_by_bitmap(index.limit(0), parsed).count() == 0
    many = spark.range(1, 5000).select(F.lit(0).alias("bucket"), F.lit("a").alias("term"), F.col("id").alias("doc_id"))
    assert dense(many)


def test_pairs_equal_plain_lookup(spark):
    _, terms, vocab, parsed = _corpus(spark, list(range(80)))
    parsed = parsed.checkpoint()
    index = with_bucket(build_postings(terms))
    want = _rows(phrase_match(lookup_terms(index, parsed, True)))
    for limit in (5, 1000):
        frequent = frequent_lengths(vocab, limit)
        pairs = build_next_words(terms, frequent)
        assert _rows(phrase_match_with_pairs(index, pairs, parsed, frequent)) == want
        covered = covered_phrases(parsed, frequent).count()
        assert (covered > 0 or limit == 5) and covered < 9
    # Covered phrases are answered without the postings of their words.
    by_pairs = parsed.join(covered_phrases(parsed, frequent), "query_id", "left_semi")
    ids = {r[0] for r in by_pairs.select("query_id").distinct().collect()}
    assert _rows(pair_matches(pairs, by_pairs)) == [r for r in want if r[0] in ids]


def test_words_grouped_in_the_row(spark):
    docs, _, _, _ = _corpus(spark, list(range(40)))
    docs = docs.unionByName(spark.createDataFrame([(900, ""), (901, "--"), (902, "a"), (903, "b-a b"), (904, "é a\x0bB")], "doc_id long, body string"))
    grouped = document_words(docs)
    assert "Exchange" not in _plan(grouped) and "Aggregate" not in _plan(grouped)
    got = sorted((r["doc_id"], r["word"], p) for r in grouped.collect() for p in r["positions"])
    assert got == sorted((r["doc_id"], r["word"], r["pos"]) for r in with_words(docs).collect())
    assert all(r["positions"] == sorted(r["positions"]) for r in grouped.collect())


def test_steps_gather_no_list(spark):
    _, terms, _, parsed = _corpus(spark, list(range(30)))
    steps = partial_phrase_matches(lookup_terms(with_bucket(build_postings(terms)), parsed, True))
    assert "_chain" not in _plan(steps) and "array_sort" not in _plan(steps)


def _scanned(df):
    """Rows read by the file scan of the plan that ran."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
            continue
        if name.startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_any_number_of_terms_prunes_folders(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).select(F.format_string("a%06d", "id").alias("term"), F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("positions"))
    # A (term, document) in two rows is merged; a frequent term is dealt to slices.
    rows = rows.unionByName(rows.where("doc_id < 10").withColumn("positions", F.array(F.lit(0))))
    hot = spark.range(500).select(F.lit("b").alias("term"), "id", F.array(F.lit(7))).toDF("term", "doc_id", "positions")
    path = str(tmp_path / "i")
    write_merged_index(rows.unionByName(hot), path, 256, spark.createDataFrame([("b", 3)], "term string, slices int"), num_files=4)
    wanted = rows.where("doc_id % 2000 = 0").select(F.lit(0).alias("bucket"), "term").distinct()
    df = read_index(spark, path, wanted=wanted)
    plan = _plan(df)
    assert "dynamicpruning" in plan.lower()
    hit = df.join(wanted, ["bucket", "term"], "left_semi")
    assert hit.count() == wanted.count() == 20
    assert _scanned(df) < 0.15 * n
    assert [r["positions"] for r in read_index(spark, path).where("term = 'a000003'").collect()] == [[0, 1]]
    assert read_index(spark, path).where("term = 'b'").count() == 500


def test_pairs_are_made_in_the_documents_row(spark):
    docs, terms, vocab, _ = _corpus(spark, list(range(40)))
    # Texts of one id count together; several words of a token share its offset; no id, no pairs.
    more = spark.createDataFrame([(3, "the war of kings"), (3, "a the ab of the"), (3, "the the-of the-the war"), (None, "the war of kings"), (50, "é the\x0bthe war")], "doc_id long, body string")
    docs = docs.unionByName(more)
    terms = apply_stems(with_words(docs), stem_vocabulary(with_words(docs), with_counts=True)).select("doc_id", "pos", "term")
    for limit in (5, 1000):
        frequent = frequent_lengths(vocab, limit)
        pairs = build_next_words(document_texts(docs), frequent)
        # Texts are exchanged, once; neither positions nor pairs are.
        assert _plan(pairs).count("Exchange") == 1 and "Join" not in _plan(pairs)
        want = sorted((*r[:4], tuple(r[4])) for r in build_next_words(terms, frequent).collect())
        assert sorted((*r[:4], tuple(r[4])) for r in pairs.collect()) == want and len(want) > 200
    assert build_next_words(document_texts(docs), frequent.limit(0)).count() == build_next_words(document_texts(docs.limit(0)), frequent).count() == 0
