"""The positional index on disk: Parquet, one folder per bucket (and sub-bucket), sorted by term.

Layout: ``bucket=N/part-*.parquet`` or ``bucket=N/sub=M/part-*.parquet`` with rows
(term, doc_id, positions). Each file is sorted by term, so Parquet min/max statistics
skip the row groups whose term range misses a pushed-down term filter; a lookup reads
only its buckets (partition pruning).

Two ways to write it:

* ``write_index``: rows in ranges of (bucket, term, doc_id), so each file holds a disjoint
  term range.
* ``write_merged_index``: rows by hash of (bucket, sub-bucket, slice). Sub-buckets are hash
  classes of terms; a term with very many occurrences is dealt to slices by document,
  so it fills no task. The one exchange also brings rows of one (term, document)
  together, which are merged into one posting before they are written, unless the caller
  says that there are none.

``_layout`` names the number of sub-buckets. A batch of any number of terms is pruned
to its (bucket, sub-bucket) folders when it is run (dynamic partition pruning): the
scan waits for the broadcast of the batch's own folders and opens only these.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasedex.functions.text import sub_bucket_of
from phrasedex.operators.postings import with_bucket
from phrasedex.sources.segments import live_segments, read_state

# Spark tests Parquet statistics against every value of an IN list only up to this
# session setting (10 by default); read_index raises it to the number of terms.
PUSHDOWN_SETTING = "spark.sql.parquet.pushdown.inFilterThreshold"
INDEX_SCHEMA = "term STRING, doc_id BIGINT, positions ARRAY<INT>, bucket INT"


def write_index(postings: DataFrame, path: str, num_files: int | None = None, mode: str = "overwrite") -> None:
    """Write (term, doc_id, positions) postings as the bucketed, term-sorted index.

    Without ``num_files`` the range exchange is left to AQE, which merges its
    partitions up to ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so
    the file count follows the data volume.
    """
    df = postings if "bucket" in postings.columns else with_bucket(postings)
    keys = ["bucket", "term", "doc_id"]
    ranged = df.select(*keys, "positions")
    ranged = ranged.repartitionByRange(num_files, *keys) if num_files else ranged.repartitionByRange(*keys)
    (
        ranged.sortWithinPartitions(*keys)
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def write_merged_index(
    rows: DataFrame,
    path: str,
    sub_buckets: int,
    sliced: DataFrame | None = None,
    num_files: int | None = None,
    mode: str = "overwrite",
    merged: bool = False,
) -> None:
    """Write (term, doc_id, positions) rows, several of one (term, doc_id) merged, by sub-buckets.

    ``merged``: no (term, doc_id) comes twice, so rows are only sorted.

    ``sliced``: (term, slices) of the terms to be dealt to several tasks; callers bound
    its row count (it is broadcast). One exchange; the merge and the sort follow in
    its partitions. Partitions are left to AQE without ``num_files``.
    """
    keyed = with_bucket(rows.select("term", "doc_id", "positions")).withColumn("sub", sub_bucket_of("term", sub_buckets))
    # A folder is written by up to GRAINS tasks, so that a bucket with much text does not fill one.
    keyed = keyed.withColumn("grain", F.pmod(F.xxhash64("term"), F.lit(GRAINS)))
    keys = ["bucket", "sub", "grain"]
    if sliced is not None:
        keyed = keyed.join(F.broadcast(sliced.select("term", "slices")), "term", "left")
        keyed = keyed.withColumn("slice", F.coalesce(F.pmod(F.hash("doc_id"), F.col("slices")), F.lit(0))).drop("slices")
        keys = [*keys, "slice"]
    dealt = keyed.repartition(num_files, *keys) if num_files else keyed.repartition(*keys)
    if not merged:
        dealt = dealt.groupBy(*keys, "term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    order = ["bucket", "sub", "term", "doc_id"]
    dealt.select(*order, "positions").sortWithinPartitions(*order).write.mode(mode).partitionBy("bucket", "sub").parquet(path)
    write_layout(rows.sparkSession, path, {"sub_buckets": sub_buckets})


LAYOUT_FILE = "_layout"
GRAINS = 4


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_layout(spark: SparkSession, path: str, facts: dict) -> None:
    p, fs = _hadoop_path(spark, path.rstrip("/") + "/" + LAYOUT_FILE)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(facts).encode()))
    out.close()


def read_layout(spark: SparkSession, path: str) -> dict:
    """Facts about a stored index; empty for one that ``write_index`` wrote."""
    p, fs = _hadoop_path(spark, path.rstrip("/") + "/" + LAYOUT_FILE)
    if not fs.exists(p):
        return {}
    file = fs.open(p)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    return json.loads(text)


def read_index(
    spark: SparkSession,
    path: str | list[str],
    buckets: Iterable[int] | None = None,
    terms: Iterable[str] | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """(bucket, term, doc_id, positions), pruned to ``buckets``, ``terms`` and ``wanted`` if given.

    Several index paths (partial indexes) are merged: a (term, document) that
    several of them hold gets all its positions in one row. Literal bucket
    values become PartitionFilters; literal terms become PushedFilters; the
    merge shuffles only what these leave. Row groups are skipped by each term,
    for which the session's PUSHDOWN_SETTING is raised to the number of terms.

    ``wanted``: a table with (bucket, term) rows of any number. Its distinct (bucket, sub-bucket) pairs, at most as
    many as the index has folders, are broadcast and prune the folders at run time; rows of other terms in
    these folders are still in the result. An index without sub-buckets ignores it.

    A path may be the root of a growing index (``sources.segments``): its live rows are read.
    """
    paths = [path] if isinstance(path, str) else list(path)
    bucket_list = sorted({int(b) for b in buckets}) if buckets is not None else None
    term_list = sorted(set(terms)) if terms is not None else None
    if term_list and int(spark.conf.get(PUSHDOWN_SETTING, "10")) < len(term_list):
        spark.conf.set(PUSHDOWN_SETTING, str(len(term_list)))

    def prune(df: DataFrame, subs: int) -> DataFrame:
        if bucket_list is not None:
            df = df.where(F.col("bucket").isin(bucket_list))
        if term_list is not None:
            df = df.where(F.col("term").isin(term_list))
        if wanted is not None and subs > 1:
            # The comparison marks the side as selective, which Spark asks for before it prunes by a join.
            folders = wanted.select("bucket", sub_bucket_of("term", subs).alias("sub")).distinct().where(F.col("sub") >= 0)
            df = df.join(F.broadcast(folders), ["bucket", "sub"], "left_semi")
        return df

    out = None
    # One scan per index root (each has its own bucket=N folders), and per live segment of a growing index.
    for p in paths:
        state = read_state(spark, p)
        if state is not None and state["segments"]:
            scans = live_segments(spark, p, state, prune=prune)
        elif state is not None:
            scans = [spark.sql("SELECT * FROM VALUES (0, '', 0L, array(0)) AS t(bucket, term, doc_id, positions)").where(F.lit(False))]
        else:
            df = spark.read.schema(INDEX_SCHEMA).parquet(p)
            subs = read_layout(spark, p).get("sub_buckets", 0) if wanted is not None and "sub" in df.columns else 0
            scans = [prune(df, subs)]
        for df in scans:
            df = df.select("bucket", "term", "doc_id", "positions")
            out = df if out is None else out.unionByName(df)
    if len(paths) > 1:
        merged = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
        out = out.groupBy("bucket", "term", "doc_id").agg(merged)
    return out


def read_terms(spark: SparkSession, path: str, keys: Iterable[tuple[str, int]]) -> DataFrame:
    """``read_index`` of the few (term, bucket) given, from their own folders only: nothing else is listed or opened."""
    keys = list(keys)
    subs = read_layout(spark, path).get("sub_buckets", 0)
    if not keys or not subs:
        return read_index(spark, path, buckets={b for _, b in keys}, terms={t for t, _ in keys})
    marks = spark.sql(
        "SELECT " + ", ".join(f"pmod(hash(:t{i}), {subs}) AS c{i}" for i in range(len(keys))), args={f"t{i}": t for i, (t, _) in enumerate(keys)}
    ).first()
    root = path.rstrip("/")
    found = []
    for folder in sorted({f"{root}/bucket={b}/sub={marks[i]}" for i, (_, b) in enumerate(keys)}):
        p, fs = _hadoop_path(spark, folder)
        if fs.exists(p):
            found.append(folder)
    if not found:
        return read_index(spark, path, buckets=[])
    df = spark.read.schema(INDEX_SCHEMA).option("basePath", root).parquet(*found)
    return df.where(F.col("term").isin([t for t, _ in keys])).select("bucket", "term", "doc_id", "positions")
