"""Benchmark: index build, one-job phrase batch, single-phrase latency.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and
prints one JSON line. The phrase batch is every clause of every benchmark text
(see ``benchmark_phrases``); the single-phrase latency is measured on the first
$BENCH_SINGLE multi-word phrases in query_id order, each answered from the
stored index with literal bucket and term filters.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from phrasedex.operators import benchmark_phrases  # noqa: E402
from phrasedex.plans.build import build_index, remove_path  # noqa: E402
from phrasedex.plans.search import search_batch, search_phrase  # noqa: E402
from phrasedex.session import get_session, shared_dir  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n_single = int(os.environ.get("BENCH_SINGLE", "20"))
    spark = get_session(
        f"local[{cpus}]", app="phrasedex-bench", shuffle_partitions=int(cpus) * 2,
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    timings: dict[str, float] = {}

    index_path = shared_dir(spark, "bench-index")
    t = time.perf_counter()
    # The test tables are single-row-group files: spread them over the cores.
    facts = build_index(spark, docs, index_path, input_partitions=int(os.environ.get("BENCH_INPUT_PARTITIONS", cpus)))
    timings["index_build"] = time.perf_counter() - t

    phrases = benchmark_phrases(items)
    t = time.perf_counter()
    res = search_batch(spark, index_path, phrases)
    n_phrases = res.parsed.select("query_id").distinct().count()
    prep = time.perf_counter() - t
    t = time.perf_counter()
    n_docs = res.docs.count()
    timings["phrase_batch_docs"] = time.perf_counter() - t + prep
    t = time.perf_counter()
    n_steps = res.steps.count()
    timings["phrase_batch_steps"] = time.perf_counter() - t

    multi = (
        res.parsed.where(F.col("n_terms") >= 2).select("query_id").distinct().orderBy("query_id").limit(n_single)
    )
    texts = [r["query"] for r in phrases.join(multi, "query_id").orderBy("query_id").collect()]
    lat = []
    for i, text in enumerate(texts):
        t = time.perf_counter()
        search_phrase(spark, index_path, text, query_id=i).docs.count()
        lat.append(time.perf_counter() - t)
    if lat:
        timings["single_phrase_mean"] = statistics.mean(lat)
        timings["single_phrase_median"] = statistics.median(lat)
        timings["single_phrase_p90"] = sorted(lat)[max(0, -(-9 * len(lat) // 10) - 1)]

    total = timings["index_build"] + timings["phrase_batch_docs"]
    out = {
        "metric": "index_build_plus_phrase_batch",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in timings.items()},
        "sf": sf_dir.rstrip("/").split("sf")[-1],
        "phrases": n_phrases,
        "phrase_batch_qps": round(n_phrases / timings["phrase_batch_docs"], 2),
        "matching_pairs": n_docs,
        "step_rows": n_steps,
        "vocabulary_words": facts["vocabulary_words"],
        "cpus": int(cpus),
        "baseline_phrases_per_sec": 4.11,
        "baseline_single_phrase_median_sec": 0.16319,
    }
    remove_path(spark, index_path)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
