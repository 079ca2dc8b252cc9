"""Jobs on a growing index (``sources.segments``): add or replace documents, delete, compact, vacuum.

    add       texts, exchanged by doc_id -> stemmed postings where the text is -> segment=N; ids -> tombstones=N
    delete    ids -> tombstones=N
    compact   live rows of the chosen segments, bucket by bucket without an exchange while a bucket fits
              a task, else dealt once by folder and bucket -> segment=N

A step costs as much as its own documents, whatever the index holds. Reading costs one
scan per live segment, so segments are compacted by size: ``compact`` merges the newest ones
for as long as the next older one is not much larger than what is merged already. A
posting is then rewritten a number of times that grows with the logarithm of the index.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phrasedex.functions.text import bucket_of, sub_bucket_of
from phrasedex.operators.tokens import document_terms
from phrasedex.plans.build import remove_path, sub_buckets_for
from phrasedex.session import parts_for, plan_bytes
from phrasedex.sources.segments import (
    DOC_BUCKETS,
    live_segments,
    read_state,
    segment_path,
    segment_table,
    table_name,
    tombstone_path,
    write_segment,
    write_state,
    write_tombstones,
)

# A segment of up to so many times the rows merged already is merged with them.
RATIO = 4.0
# Bytes of documents, by Catalyst's estimate, whose postings one task of ``add_documents`` sorts; postings that one of ``compact`` does.
# A posting takes some 110 bytes in a sort, so either stays in memory.
SEGMENT_TASK_BYTES = 16 << 20
ROWS_PER_TASK = 2_000_000


def _state(spark: SparkSession, root: str, doc_buckets: int = DOC_BUCKETS) -> dict:
    return read_state(spark, root) or {"step": 0, "doc_buckets": doc_buckets, "segments": [], "tombstones": []}


def _postings(rows: DataFrame) -> DataFrame:
    """Rows of one (term, document) merged; rows that lie by ``doc_id`` stay where they are."""
    return rows.groupBy("doc_id", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def _segment(spark: SparkSession, root: str, step: int, doc_buckets: int, subs: int, occurrences: int) -> dict:
    rows = segment_table(spark, root, step, doc_buckets).count()
    return {"step": step, "rows": rows, "occurrences": occurrences, "sub_buckets": subs}


def add_documents(spark: SparkSession, root: str, docs: DataFrame, body: str = "body", stopwords: Iterable[str] | None = None,
                  doc_buckets: int = DOC_BUCKETS) -> dict:
    """Add (doc_id, body) documents as a new segment; an id the index holds already is replaced. Returns the new state.

    ``doc_buckets`` counts for the first segment of a root; later ones take its number. A bucket is written by as
    many tasks as the documents' size asks for, each of which writes that bucket alone; their files are
    small, so a new segment has no sub-buckets before it is compacted.
    """
    state = _state(spark, root, doc_buckets)
    step, n, subs = state["step"] + 1, state["doc_buckets"], sub_buckets_for(0)
    per_bucket = parts_for(plan_bytes(docs), SEGMENT_TASK_BYTES * n, parts_for(spark.sparkContext.defaultParallelism, n))
    seen = Observation()
    postings = document_terms(docs, body, stopwords, tasks=n * per_bucket).observe(seen, F.sum(F.size("positions")).alias("occurrences"))
    write_segment(postings, root, step, n, subs)
    tombstones = list(state["tombstones"])
    if state["segments"]:
        tombstones.append({"step": step, "rows": write_tombstones(docs, root, step, n)})
    new = {**state, "step": step, "segments": [*state["segments"], _segment(spark, root, step, n, subs, seen.get["occurrences"] or 0)], "tombstones": tombstones}
    write_state(spark, root, new)
    return new


def delete_documents(spark: SparkSession, root: str, ids: DataFrame) -> dict:
    """Hide the documents of a ``doc_id`` table; their postings go when their segments are compacted."""
    state = _state(spark, root)
    step = state["step"] + 1
    rows = write_tombstones(ids, root, step, state["doc_buckets"])
    new = {**state, "step": step, "tombstones": [*state["tombstones"], {"step": step, "rows": rows}]}
    write_state(spark, root, new)
    return new


def segments_to_merge(state: dict, ratio: float | None = RATIO) -> list[int]:
    """Steps of the newest segments to be merged; ``ratio`` None: all of them."""
    picked, rows = [], 0
    for s in reversed(state["segments"]):
        if picked and ratio is not None and s["rows"] > ratio * rows:
            break
        picked.append(s["step"])
        rows += s["rows"]
    return sorted(picked)


def merged_postings(spark: SparkSession, root: str, state: dict, steps: list[int]) -> DataFrame:
    """Live (term, doc_id, positions) of segments, without an exchange: all tables are bucketed alike.

    Tombstones are not broadcast: every task meets those of its own bucket.
    """
    rows = None
    for df in live_segments(spark, root, state, steps, max_broadcast=-1):
        rows = df if rows is None else rows.unionByName(df)
    return _postings(rows)


def dealt_postings(spark: SparkSession, root: str, state: dict, steps: list[int], subs: int, rows: int) -> DataFrame:
    """The rows of ``merged_postings`` dealt over tasks of about ``ROWS_PER_TASK`` by folder and document bucket, so that no task holds a whole bucket.

    Dead rows go before the one exchange; a file of the new segment is written by one task. A document is
    live in one segment, where a term has one row of it, so only rows without an id are left to be merged.
    """
    union = None
    for df in live_segments(spark, root, state, steps):
        df = df.select("doc_id", "term", "positions")
        union = df if union is None else union.unionByName(df)
    # The last is the rule of Spark's buckets.
    keys = (bucket_of(F.col("term")), sub_bucket_of("term", subs), F.pmod(F.hash("doc_id"), F.lit(state["doc_buckets"])))
    dealt = union.where("doc_id IS NOT NULL").repartition(parts_for(rows, ROWS_PER_TASK), *keys)
    return dealt.unionByName(_postings(union.where("doc_id IS NULL")).select("doc_id", "term", "positions"))


def compact(spark: SparkSession, root: str, ratio: float | None = RATIO) -> dict:
    """Merge the newest segments of like size (all with ``ratio`` None) into one that holds live postings only.

    Tombstones that no remaining segment needs are dropped from the list. Folders no longer
    listed stay until ``vacuum``, for running readers. Nothing is done where one segment is picked and none of its documents is dead.
    """
    state = _state(spark, root)
    steps = segments_to_merge(state, ratio)
    dead = bool(steps) and any(t["rows"] and t["step"] > steps[0] for t in state["tombstones"])
    if len(steps) < 2 and not dead:
        return state
    step, n = state["step"] + 1, state["doc_buckets"]
    # At most as many as before the dead ones went.
    occurrences = sum(s["occurrences"] for s in state["segments"] if s["step"] in steps)
    subs = sub_buckets_for(occurrences)
    rows = sum(s["rows"] for s in state["segments"] if s["step"] in steps)
    small = rows <= ROWS_PER_TASK * n
    write_segment(merged_postings(spark, root, state, steps) if small else dealt_postings(spark, root, state, steps, subs, rows), root, step, n, subs)
    kept = [s for s in state["segments"] if s["step"] not in steps]
    oldest = kept[0]["step"] if kept else step
    new = {
        **state,
        "step": step,
        "segments": [*kept, _segment(spark, root, step, n, subs, occurrences)],
        "tombstones": [t for t in state["tombstones"] if t["step"] > oldest] if kept else [],
    }
    write_state(spark, root, new)
    return new


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Remove the folders under ``root`` that the live list does not name; returns them. No reader or writer may be running."""
    state = _state(spark, root)
    live = {segment_path(root, s["step"]) for s in state["segments"]} | {tombstone_path(root, t["step"]) for t in state["tombstones"]}
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        path = f"{root.rstrip('/')}/{name}"
        if name.startswith(("segment=", "tombstones=")) and path not in live:
            spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
            remove_path(spark, path)
            gone.append(path)
    return sorted(gone)


__all__ = ["add_documents", "delete_documents", "compact", "vacuum", "dealt_postings", "merged_postings", "segments_to_merge"]
