"""Growing index: add, replace, delete and compact give the rows of a rebuild; no shuffle between segments. Blocks by rank."""

import os

import pytest
from pyspark.sql import functions as F

from phrasedex.operators import build_inverted_index, merge_postings
from phrasedex.plans import grow
from phrasedex.plans.build import build_index, corpus_postings
from phrasedex.plans.grow import add_documents, compact, delete_documents, merged_postings, segments_to_merge, vacuum
from phrasedex.plans.search import search_batch, search_phrase
from phrasedex.session import local_path, shared_dir
from phrasedex.sources import postings_from_text, postings_to_text, read_index
from phrasedex.sources.segments import live_segments, read_state, segment_table, write_state
from tests.conftest import SF0001

BUCKETS = 4


def _docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", F.col("text").alias("body"))


def _flat(df):
    return df.select("term", "doc_id", F.array_join("positions", ":").alias("p"))


def _same(a, b):
    a, b = _flat(a).cache(), _flat(b).cache()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    return a.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def grown(spark):
    """All documents, a fifth of them with an old text first; a seventh deleted and added again."""
    docs = _docs(spark)
    fifth, seventh = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
    root = shared_dir(spark, "t-segments")
    add_documents(spark, root, docs.withColumn("body", F.when(fifth, F.lit("an old text of words")).otherwise(F.col("body"))), doc_buckets=BUCKETS)
    add_documents(spark, root, docs.where(fifth))
    delete_documents(spark, root, docs.where(seventh))
    gone = _flat(read_index(spark, root)).cache()
    gone.count()
    add_documents(spark, root, docs.where(seventh))
    return root, gone


def test_replace_and_delete(spark, grown):
    root, gone = grown
    docs = _docs(spark)
    rest = _flat(corpus_postings(docs.where("doc_id % 7 != 0")))
    assert gone.exceptAll(rest).isEmpty() and rest.exceptAll(gone).isEmpty()
    assert _same(read_index(spark, root), corpus_postings(docs)) > 1000
    state = read_state(spark, root)
    assert [s["step"] for s in state["segments"]] == [1, 2, 4] and [t["step"] for t in state["tombstones"]] == [2, 3, 4]


def test_no_exchange_between_segments(spark, grown):
    root, _ = grown
    state = read_state(spark, root)
    plan = _plan(merged_postings(spark, root, state, [1, 2, 4]))
    assert "Exchange" not in plan and plan.count("Bucketed: true") >= 5, plan
    one = live_segments(spark, root, state, [1], max_broadcast=-1)[0]
    assert "ShuffledHashJoin" in _plan(one) and "Exchange" not in _plan(one)


def test_batch_and_phrase_on_segments(spark, grown):
    root, _ = grown
    path = shared_dir(spark, "t-whole")
    build_index(spark, _docs(spark), path, num_files=3)
    phrases = spark.createDataFrame([(1, "the"), (2, "of the"), (3, "in the world"), (4, "old text")], "query_id long, query string")
    # Few terms as literals, and folders pruned by the batch's own table.
    for most in (1000, 0):
        got = sorted(search_batch(spark, root, phrases, max_literal_terms=most).docs.collect())
        assert got == sorted(search_batch(spark, path, phrases).docs.collect()) and got
    assert sorted(search_phrase(spark, root, "of the").docs.collect()) == sorted(search_phrase(spark, path, "of the").docs.collect())


def test_scan_is_pruned(spark, grown):
    root, _ = grown
    plan = _plan(read_index(spark, root, buckets=[2, 22], terms=["civil", "war"]))
    assert plan.count("In(term, [civil,war])") == 3 and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0], plan


def test_another_session_registers_the_tables(spark, grown):
    root, _ = grown
    state = read_state(spark, root)
    from phrasedex.sources.segments import segment_path, table_name

    name = table_name(segment_path(root, 1))
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    n = sum(df.count() for df in live_segments(spark, root, state))
    assert n == corpus_postings(_docs(spark)).count() and spark.catalog.tableExists(name)


def test_compaction(spark):
    docs = _docs(spark)
    root = shared_dir(spark, "t-compact")
    add_documents(spark, root, docs, doc_buckets=BUCKETS)
    add_documents(spark, root, docs.where("doc_id < 20").withColumn("body", F.lit("short new words")))
    add_documents(spark, root, docs.where("doc_id < 10"))
    delete_documents(spark, root, docs.where("doc_id = 3"))
    want = merge_postings(
        corpus_postings(docs.where("(doc_id < 10 OR doc_id >= 20) AND doc_id != 3")),
        corpus_postings(docs.where("doc_id BETWEEN 10 AND 19").withColumn("body", F.lit("short new words"))),
    )
    want = _flat(want).cache()

    def holds():
        got = _flat(read_index(spark, root)).cache()
        return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    assert holds()
    state = compact(spark, root, ratio=200)
    sizes = [s["rows"] for s in state["segments"]]
    assert holds() and len(sizes) <= 2
    state = compact(spark, root, ratio=None)
    assert holds() and len(state["segments"]) == 1 and not state["tombstones"]
    assert state["segments"][0]["rows"] == want.count()
    gone = vacuum(spark, root)
    left = [f for f in os.listdir(local_path(root)) if f.startswith(("segment=", "tombstones="))]
    assert gone and left == [f"segment={state['segments'][0]['step']}"] and holds()
    assert compact(spark, root) == state  # one segment without dead documents: nothing to do
    with pytest.raises(RuntimeError):
        write_state(spark, root, state)


def test_no_task_sorts_a_whole_bucket(spark, monkeypatch):
    docs = _docs(spark)
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).coalesce(2)
    root = shared_dir(spark, "t-dealt")
    monkeypatch.setattr(grow, "SEGMENT_TASK_BYTES", 4096)
    monkeypatch.setattr(grow, "ROWS_PER_TASK", 5000)
    dealt = []
    monkeypatch.setattr(grow, "dealt_postings", lambda *a, make=grow.dealt_postings: dealt.append(make(*a)) or dealt[-1])
    add_documents(spark, root, docs, doc_buckets=BUCKETS)
    add_documents(spark, root, docs.where("doc_id % 5 = 0"))
    table = segment_table(spark, root, 1, BUCKETS)
    # A bucket's postings come from several tasks, each of which writes that bucket alone.
    files = table.select(F.input_file_name().alias("f")).distinct().collect()
    tasks = {r["f"].rsplit("/part-", 1)[1].split(".")[0] for r in files}
    assert len({t.split("-")[0] for t in tasks}) > BUCKETS == len({t.rsplit("_", 1)[1] for t in tasks})
    assert all(int(t.split("-")[0]) % BUCKETS == int(t.rsplit("_", 1)[1]) for t in tasks)
    want = corpus_postings(docs, by="document")
    state = compact(spark, root, ratio=None)
    assert len(dealt) == 1 and dealt[0].rdd.getNumPartitions() > BUCKETS
    assert _same(read_index(spark, root), want) == state["segments"][0]["rows"]
    assert state["segments"][0]["occurrences"] >= want.agg(F.sum(F.size("positions"))).first()[0]
    assert read_index(spark, root).where("doc_id IS NULL").count() == want.where("doc_id IS NULL").count() > 0


def test_sizes_decide_what_is_merged():
    state = {"segments": [{"step": i, "rows": n} for i, n in enumerate((1000, 100, 30, 10), 1)]}
    assert segments_to_merge(state, 4.0) == [2, 3, 4]
    assert segments_to_merge(state, 2.0) == [4]
    assert segments_to_merge(state, None) == [1, 2, 3, 4]
    assert segments_to_merge({"segments": []}, 4.0) == []


def test_defined_cases(spark):
    root = shared_dir(spark, "t-odd")
    empty = spark.createDataFrame([], "doc_id long, body string")
    delete_documents(spark, root, empty)
    assert read_index(spark, root).collect() == []
    add_documents(spark, root, empty)
    rows = [(1, "alpha beta"), (1, "alpha"), (None, "alpha"), (2, None), (3, "")]
    add_documents(spark, root, spark.createDataFrame(rows, "doc_id long, body string"))
    # Rows of one id count as one document; a row without an id stays when others are replaced.
    add_documents(spark, root, spark.createDataFrame([(2, "gamma"), (None, "alpha")], "doc_id long, body string"))
    delete_documents(spark, root, spark.createDataFrame([(99,), (None,), (3,)], "doc_id long"))
    got = sorted(((r["term"], r["doc_id"] or -1, r["p"]) for r in _flat(read_index(spark, root)).collect()))
    assert got == [("alpha", -1, "0"), ("alpha", -1, "0"), ("alpha", 1, "0:0"), ("beta", 1, "6"), ("gamma", 2, "0")]
    compact(spark, root, ratio=None)
    got = sorted(((r["term"], r["doc_id"] or -1, r["p"]) for r in _flat(read_index(spark, root)).collect()))
    assert got == [("alpha", -1, "0:0"), ("alpha", 1, "0:0"), ("beta", 1, "6"), ("gamma", 2, "0")]


def test_blocks_by_rank_on_hashed_ids(spark):
    docs = _docs(spark).withColumn("doc_id", F.xxhash64("doc_id"))
    path = shared_dir(spark, "t-hashed")
    corpus_postings(docs).write.parquet(path)
    post = spark.read.parquet(path)
    per = 16
    least = post.groupBy("term").count().agg(F.sum(F.ceil(F.col("count") / per))).first()[0]
    inv = build_inverted_index(post, docs_per_block=per, by_rank=True).cache()
    assert inv.count() == least < build_inverted_index(post, docs_per_block=per).count()
    assert inv.agg(F.max(F.size("postings"))).first()[0] == per
    # Blocks of a term follow each other in order of ids, and hold every posting once.
    flat = inv.select("term", "block", F.explode("postings").alias("x")).select("term", "block", "x.doc_id", "x.positions")
    spans = flat.groupBy("term", "block").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    a, b = spans.alias("a"), spans.alias("b")
    crossing = a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.block") < F.col("b.block")) & (F.col("a.hi") >= F.col("b.lo")))
    assert crossing.isEmpty()
    _same(flat, post)
    lines = postings_to_text(post, style="tab", docs_per_line=per, by_rank=True)
    assert lines.count() == least
    _same(merge_postings(postings_from_text(lines)), post)
