"""Write PLANS.md: the physical plans of the build and search jobs.

Usage: python tools/explain_plans.py [sf_dir]
For each job: the operator tree of ``explain("formatted")`` and, for each scan,
its PartitionFilters / PushedFilters / ReadSchema lines.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from phrasedex.operators import benchmark_phrases, with_bucket  # noqa: E402
from phrasedex.plans.build import build_index, corpus_postings  # noqa: E402
from phrasedex.plans.search import search_batch, search_phrase  # noqa: E402
from phrasedex.session import get_session, shared_dir  # noqa: E402


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def summary(df) -> str:
    text = formatted(df)
    tree, _, details = text.partition("\n\n\n")
    scans = []
    for block in details.split("\n\n"):
        if "Scan parquet" in block.splitlines()[0] if block.strip() else False:
            keep = [ln if len(ln) <= 300 else ln[:300] + " ...]" for ln in block.splitlines() if re.match(r"^(\(\d+\) Scan|PartitionFilters|PushedFilters|ReadSchema|Location)", ln)]
            scans.append("\n".join(keep))
    return tree.strip() + ("\n\n" + "\n\n".join(scans) if scans else "")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    phrases = benchmark_phrases(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    index = shared_dir(spark, "plans-index")
    build_index(spark, docs, index)
    out = ["# Physical plans", "", f"Generated by `tools/explain_plans.py` on `{sf_dir}` (local[8], AQE on; "
           "AQE re-plans at run time, so these are the initial plans).", ""]

    def section(title: str, note: str, df) -> None:
        out.extend([f"## {title}", "", note, "", "```", summary(df), "```", ""])

    section(
        "Index build: postings (lazy form of `build_index`)",
        "Tokens and offsets are row-local (Generate over the scan). The vocabulary branch counts words "
        "map-side, stems only the frequent ones (bounded by the scalar-subquery threshold) and is broadcast; "
        "the token stream is never shuffled for stemming. One exchange on (term, doc_id) between the partial "
        "and final collect_list.",
        corpus_postings(docs),
    )
    section(
        "Index write: range exchange and sort",
        "Range exchange on (bucket, term, doc_id), sort within partitions, then `partitionBy(bucket)`.",
        with_bucket(corpus_postings(docs)).repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions(
            "bucket", "term", "doc_id"
        ),
    )
    res = search_batch(spark, index, phrases)
    section(
        "Phrase batch: matching documents",
        "Index scan with literal bucket PartitionFilters and term PushedFilters; postings fetched by a broadcast of the counted (bucket, term, doc_id) keys of the anchored lookup; "
        "one-word phrases need no exchange; longer ones are semi-joined map-side with the broadcast (counted) "
        "candidate documents, then one exchange on (query_id, doc_id) for the start votes.",
        res.docs,
    )
    section("Phrase batch: step positions", "Same lookup and candidate filter; one exchange.", res.steps)
    one = search_phrase(spark, index, "the of and", query_id=1)
    section(
        "Single phrase",
        "Literal `bucket IN` (PartitionFilters) and `term IN` (PushedFilters) on the sorted index files.",
        one.docs,
    )
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
