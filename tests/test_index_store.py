"""Stored index: layout, pruning in the physical plan, batch and single-phrase search."""

import glob
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from phrasedex.operators import benchmark_phrases
from phrasedex.plans.build import build_index
from phrasedex.plans.search import search_batch, search_phrase
from phrasedex.session import local_path, shared_dir
from phrasedex.sources import read_index, write_index
from tests.conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _build(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    path = shared_dir(spark, "t-index")
    facts = build_index(spark, docs, path, num_files=6)
    return path, facts


def test_layout_sorted_and_bucketed(spark):
    path, facts = _build(spark)
    assert facts["vocabulary_broadcast"] is True
    dirs = sorted(glob.glob(local_path(path) + "/bucket=*"))
    assert 10 <= len(dirs) <= 26
    for f in glob.glob(local_path(path) + "/bucket=*/sub=*/*.parquet"):
        terms = pq.read_table(f, columns=["term", "doc_id"]).to_pylist()
        keys = [(r["term"], r["doc_id"]) for r in terms]
        assert keys == sorted(keys)
    idx = read_index(spark, path)
    assert idx.groupBy("term", "doc_id").count().where("count > 1").count() == 0


def test_bounded_broadcast_build_equals_full(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    full, small = shared_dir(spark, "t-full"), shared_dir(spark, "t-small")
    build_index(spark, docs, full, num_files=3)
    facts = build_index(spark, docs, small, num_files=3, max_broadcast_words=200)
    assert facts["vocabulary_broadcast"] is False
    a = read_index(spark, full).select("term", "doc_id", F.array_join("positions", ":").alias("p"))
    b = read_index(spark, small).select("term", "doc_id", F.array_join("positions", ":").alias("p"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pruned_scan_plan(spark):
    path, _ = _build(spark)
    df = read_index(spark, path, buckets=[2, 22], terms=["civil", "war"])
    plan = _plan(df)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(2,22\)", plan), plan
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[civil,war\]\)", plan), plan
    assert set(r.bucket for r in df.collect()) <= {2, 22}


def test_batch_equals_single_phrase(spark):
    path, _ = _build(spark)
    phrases = benchmark_phrases(spark.read.parquet(f"{SF0001}/benchmark.parquet"))
    res = search_batch(spark, path, phrases)
    batch = {(r.query_id, r.doc_id): r.n_matches for r in res.docs.collect()}
    sample = phrases.orderBy("query_id").limit(6).collect()
    for r in sample:
        one = search_phrase(spark, path, r.query, query_id=r.query_id)
        got = {(x.query_id, x.doc_id): x.n_matches for x in one.docs.collect()}
        assert got == {k: v for k, v in batch.items() if k[0] == r.query_id}


def test_batch_plan_has_one_shuffle_for_multiword_branch(spark):
    path, _ = _build(spark)
    phrases = benchmark_phrases(spark.read.parquet(f"{SF0001}/benchmark.parquet"))
    res = search_batch(spark, path, phrases)
    plan = res.matches._jdf.queryExecution().sparkPlan().toString()
    # Broadcast of the parsed batch, a hash exchange only for the vote branch.
    assert "BroadcastHashJoin" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_partial_indexes_searched_in_one_scan(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    full = _build(spark)[0]
    parts = []
    for cond in (F.col("lang") == "en", F.col("lang") != "en"):
        p = shared_dir(spark, "t-part")
        build_index(spark, docs.where(cond).select("doc_id", F.col("text").alias("body")), p, num_files=2)
        parts.append(p)
    phrases = benchmark_phrases(spark.read.parquet(f"{SF0001}/benchmark.parquet"))
    a = {(r.query_id, r.doc_id, r.n_matches) for r in search_batch(spark, full, phrases).docs.collect()}
    b = {(r.query_id, r.doc_id, r.n_matches) for r in search_batch(spark, parts, phrases).docs.collect()}
    assert a == b and a


def test_single_phrase_with_word_missing_from_dictionary(spark):
    from phrasedex.sources import parse_marked_documents
    from tests.conftest import FIXTURE_DOC

    docs = parse_marked_documents(spark.createDataFrame([(FIXTURE_DOC,)], "segment string"))
    path = shared_dir(spark, "t-fixture-index")
    build_index(spark, docs, path, num_files=2)
    res = search_phrase(spark, path, "War Fights")  # 'fights' is not in the corpus
    assert [(r.doc_id, r.start_pos) for r in res.matches.collect()] == [(12, 16)]
    assert {(r.step, r.pos) for r in res.steps.collect()} == {(1, 16)}
    assert search_phrase(spark, path, "  ,, ").docs.count() == 0
    assert [(r.doc_id, r.n_matches) for r in search_phrase(spark, path, "civil").docs.collect()] == [(12, 2)]


def test_empty_and_blank_batches(spark):
    path, _ = _build(spark)
    for rows in ([], [(1, "   "), (2, "--")]):
        q = spark.createDataFrame(rows, "query_id long, query string")
        res = search_batch(spark, path, q)
        assert res.docs.count() == 0 and res.matches.count() == 0 and res.steps.count() == 0


def test_query_file_end_to_end(spark):
    import os

    from phrasedex.sources import parse_marked_documents, read_queries
    from tests.conftest import FIXTURE_DOC

    docs = parse_marked_documents(spark.createDataFrame([(FIXTURE_DOC,)], "segment string"))
    path = shared_dir(spark, "t-e2e-index")
    build_index(spark, docs, path, num_files=2)
    qdir = local_path(shared_dir(spark, "t-e2e-queries"))
    os.makedirs(qdir)
    with open(f"{qdir}/query", "w") as f:
        f.write("Civil War\nCivil War Fighting\n\nWar Fights\nWars Fighting\nFighting Foo\nfoo bar\nwar\n\n\n")
    res = search_batch(spark, path, read_queries(spark, qdir))
    got = {(r.query_id, r.doc_id, r.start_pos) for r in res.matches.collect()}
    assert got == {(1, 12, 0), (1, 12, 10), (2, 12, 10), (3, 12, 16), (7, 12, 6), (7, 12, 16)}
    steps = {(r.query_id, r.step, r.pos) for r in res.steps.collect()}
    assert steps == {(1, 1, 0), (1, 1, 10), (2, 1, 0), (2, 1, 10), (2, 2, 16), (3, 1, 16)}


def test_anchored_lookup_equals_plain_lookup(spark):
    path, _ = _build(spark)
    phrases = benchmark_phrases(spark.read.parquet(f"{SF0001}/benchmark.parquet"))
    anchored = search_batch(spark, path, phrases)
    mixed = search_batch(spark, path, phrases, max_anchor_docs=20)  # frequent anchors: plain route
    plain = search_batch(spark, path, phrases, max_needed=0)  # too large: plain lookup
    for res in (anchored, mixed):
        for a, b in ((res.matches, plain.matches), (res.steps, plain.steps), (res.docs, plain.docs)):
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert anchored.lookup.count() < mixed.lookup.count() < plain.lookup.count()


def _scanned_rows(df):
    """Rows that the scan of a filtered read hands on, from the metrics of the plan that ran."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_batch_of_terms_reads_few_row_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    n = 200_000
    rows = spark.range(n).select(F.format_string("a%06d", "id").alias("term"), F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("positions"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(16 * 1024))
    hadoop.set("parquet.page.size.row.check.min", "100")
    try:
        write_index(rows, str(tmp_path / "i"), num_files=2)
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.size.row.check.min")
    terms = [f"a{k * 3999:06d}" for k in range(50)]
    df = read_index(spark, str(tmp_path / "i"), buckets=[0], terms=terms)
    assert df.count() == 50
    assert _scanned_rows(df) < 0.25 * n


def test_build_writes_one_row_per_term_and_document(spark, tmp_path, monkeypatch):
    """Words of one stem and rows of one id meet where the document lies: nothing is left to merge before the write."""
    from phrasedex.plans import build

    rows = [(1, "running runs, run"), (1, "a run"), (2, None), (3, ""), (None, "run ran"), (None, "Running"), (4, "foo-foo x")]
    seen = []

    def write(terms, *args, merged=False, **options):
        seen.append((merged, terms.count(), terms.select("term", "doc_id").distinct().count()))
        build_rows(terms, *args, merged=merged, **options)

    build_rows = build.write_merged_index
    monkeypatch.setattr(build, "write_merged_index", write)
    path = str(tmp_path / "i")
    facts = build.build_index(spark, spark.createDataFrame(rows, "doc_id long, body string"), path)
    assert seen == [(True, 6, 6)]
    got = {(r["term"], r["doc_id"]): list(r["positions"]) for r in read_index(spark, path).collect()}
    assert got == {("run", 1): [0, 2, 8, 14], ("a", 1): [0], ("run", None): [0, 0], ("ran", None): [4], ("foo", 4): [0, 0], ("x", 4): [8]}
    words = {(r["word"], r["stem"]): r["n"] for r in spark.read.parquet(build.vocabulary_path(path)).collect()}
    assert words == {("running", "run"): 2, ("runs", "run"): 1, ("run", "run"): 3, ("a", "a"): 1, ("ran", "ran"): 1, ("foo", "foo"): 2, ("x", "x"): 1}
    assert facts["occurrences"] == 11 and facts["vocabulary_words"] == 7
