"""Scale properties visible in the physical plans."""

import re

from pyspark.sql import functions as F

from phrasedex.operators import benchmark_phrases
from phrasedex.plans.build import build_index, corpus_postings
from phrasedex.plans.search import search_batch
from phrasedex.session import shared_dir
from tests.conftest import SF0001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", F.col("text").alias("body"))


def test_postings_never_shuffle_tokens_for_stems(spark):
    plan = _plan(corpus_postings(_docs(spark)))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "BroadcastHashJoin" in plan and "LeftOuter, BuildRight" in plan
    # One exchange of postings (term, doc_id); the word exchange only carries partial counts.
    assert len(re.findall(r"Exchange hashpartitioning\(term#\d+, doc_id#\d+", plan)) == 1
    assert "partial_collect_list" in plan and "partial_count" in plan


def test_batch_answer_uses_one_exchange(spark):
    path = shared_dir(spark, "t-plan-index")
    build_index(spark, _docs(spark), path, num_files=3)
    res = search_batch(spark, path, benchmark_phrases(spark.read.parquet(f"{SF0001}/benchmark.parquet")))
    for df in (res.docs, res.matches):
        plan = _plan(df)
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+, doc_id#\d+", plan)) <= 1
        assert re.search(r"PartitionFilters: \[bucket#\d+ (IN|INSET)", plan)
        assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[", plan)
