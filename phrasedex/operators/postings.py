"""Postings: one row per (term, document) with the sorted offsets of the term.

Duplicates are kept (a posting is a multiset): ``foo-foo`` yields ``foo`` twice
at one offset. Rows stay flat; nesting by term is only a bounded export view.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasedex.functions.text import block_of, bucket_of
from phrasedex.session import shared_dir

# Ids of a block of nested postings and of a text line.
DOCS_PER_BLOCK = 1024


def build_postings(terms: DataFrame) -> DataFrame:
    """(term, doc_id, positions ARRAY<INT>) from (doc_id, pos, term) rows.

    Offsets are stored as INT: a document is one Spark string (under 2 GB), so
    its character offsets fit, and the index's dominant column and every
    shuffle of positions take half the bytes of BIGINT.

    The aggregate is split into a map-side partial and a final step, so the
    shuffle carries per-task combined lists. A group is bounded by one
    document's length, whatever the term's frequency.
    """
    # Words are never empty and neither are their stems, so no filter here (a
    # filter on term would be pushed below the vocabulary aggregate and
    # evaluate the stemmer per token).
    return terms.groupBy("term", "doc_id").agg(
        F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias("positions")
    )


def with_bucket(postings: DataFrame) -> DataFrame:
    return postings.withColumn("bucket", bucket_of(F.col("term")))


def merge_postings(*parts: DataFrame) -> DataFrame:
    """Merge partial indexes built apart (per corpus part, per lang, per batch).

    A (term, doc) group holds at most one row per part.
    """
    union = parts[0].select("term", "doc_id", "positions")
    for p in parts[1:]:
        union = union.unionByName(p.select("term", "doc_id", "positions"))
    return union.groupBy("term", "doc_id").agg(
        F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    )


# Documents of a term whose ranks are counted in one task.
RANK_IN_TASK = 1_000_000


def _ranked_parts(postings: DataFrame, in_task: int) -> list[DataFrame]:
    """``with_rank`` of the terms of up to ``in_task`` rows, which lie by ``term``, and of the others, if there are any.

    A term of more rows is counted on two levels, so that no task holds it whole, however
    its ids lie: its rows are stored in ranges of (term, doc_id); a row's rank is the number
    of its term's rows in the ranges before plus its place in its own. A term that spans ranges fills
    all but the outer two, so at most one term crosses from a range to the next, and the counts to
    add are fewer than the ranges: small enough to be broadcast.
    """
    spark = postings.sparkSession
    columns = postings.columns
    by_id = F.col("doc_id").asc_nulls_first()
    # Stored, for frequent terms are counted before rows are ranked.
    path = shared_dir(spark, "postings")
    postings.write.parquet(path)
    stored = spark.read.parquet(path)
    # Fewer terms than rows / in_task, by counting.
    frequent = stored.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_task).select("term").checkpoint(eager=True)
    place = (F.row_number().over(Window.partitionBy("term").orderBy(by_id)) - 1).cast("bigint")
    if frequent.isEmpty():
        return [stored.select(*columns, place.alias("rank"))]
    # A null term equals none and so stays with these.
    others = stored.join(F.broadcast(frequent), "term", "left_anti").select(*columns, place.alias("rank"))
    path = shared_dir(spark, "ranged-postings")
    # Stored, for ranges are cut by a sample and a range must not change between the two levels.
    ranged = stored.join(F.broadcast(frequent), "term", "left_semi").repartitionByRange("term", "doc_id").withColumn("range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.parquet(path)
    counts = ranged.groupBy("term", "range").agg(F.count(F.lit(1)).alias("n"))
    # One row per term and range of it.
    earlier = Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("n").over(earlier)).where(F.col("before") > 0).select("term", "range", "before")
    place = F.row_number().over(Window.partitionBy("term", "range").orderBy(by_id)) - 1
    rows = ranged.withColumn("place", place).join(F.broadcast(before), ["term", "range"], "left")
    rank = (F.coalesce(F.col("before"), F.lit(0)) + F.col("place")).cast("bigint")
    return [others, rows.select(*columns, rank.alias("rank"))]


def with_rank(postings: DataFrame, in_task: int = RANK_IN_TASK) -> DataFrame:
    """``postings`` with ``rank``, from 0: how many rows of the same term have a smaller doc_id (null first)."""
    return reduce(DataFrame.unionByName, _ranked_parts(postings, in_task))


def group_blocks(postings: DataFrame, entry: Column, docs_per_block: int, by_rank: bool = False) -> DataFrame:
    """(term, block, entries): the ``entry`` structs of each block, sorted; a block holds ids of one span of ``docs_per_block``, or ``by_rank`` as many of the term's documents.

    Postings that lie by ``block`` (a column of theirs, of the same span) are grouped where they are, and
    those ranked by term too.
    """
    if by_rank:
        ranked = _ranked_parts(postings.select("term", "doc_id", "positions"), RANK_IN_TASK)
        parts = [p.withColumn("block", block_of("rank", docs_per_block)) for p in ranked]
    else:
        parts = [postings if "block" in postings.columns else postings.withColumn("block", block_of("doc_id", docs_per_block))]
    entries = F.array_sort(F.collect_list(entry)).alias("entries")
    return reduce(DataFrame.unionByName, [p.groupBy("term", "block").agg(entries) for p in parts])


def build_inverted_index(postings: DataFrame, docs_per_block: int = DOCS_PER_BLOCK, by_rank: bool = False) -> DataFrame:
    """(term, block, postings ARRAY<STRUCT<doc_id, positions>>) sorted by doc_id.

    Nesting a whole term into one row would put a frequent term's entire list in
    one task; blocks of ``docs_per_block`` consecutive doc ids bound each row. Where ids are
    sparse (hashed, say), such a block holds one document: ``by_rank`` fills each
    block but a term's last with ``docs_per_block`` documents, in order of their ids.
    """
    return group_blocks(postings, F.struct("doc_id", "positions"), docs_per_block, by_rank).withColumnRenamed("entries", "postings")
