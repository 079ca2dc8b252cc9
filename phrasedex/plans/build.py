"""Index build job: documents -> stemmed positional postings -> bucketed Parquet.

Texts are read twice, positions are shuffled once:

    texts --words counted in batches, stemmer--> vocabulary (word, stem, n), stored
    texts by document --tokens, offsets, words, stems, grouped by term in the row--> (term, doc_id, positions)
        exchange by (bucket, sub-bucket, slice) --> sort --> bucket=N/sub=M/ Parquet

Words meet by term where their document lies, so the exchange brings one row per term
and document and nothing is merged after it. No stem is looked up in a broadcast
table: a batch's different words are stemmed once. In the exchange a
term with more than 1/SLICES of all occurrences is dealt to slices by document, each
of about that share; fewer than SLICES terms can qualify.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasedex.functions.text import bucket_of
from phrasedex.operators.postings import build_postings, merge_postings
from phrasedex.operators.stemming import (
    apply_frequent_stems,
    apply_stems,
    frequent_vocabulary,
    frequent_words,
    stem_vocabulary,
    with_stems,
)
from phrasedex.operators.tokens import document_terms, document_words, with_words, word_counts
from phrasedex.session import parts_for, plan_bytes, shared_dir
from phrasedex.sources.index_store import write_merged_index

MAX_BROADCAST_WORDS = 2_000_000
VOCABULARY_DIR = "_vocabulary"
# A term with more than 1/SLICES of all occurrences, and more than SLICE_OCCURRENCES, is written by several tasks.
SLICES, SLICE_OCCURRENCES = 1000, 1_000_000
# Occurrences per sub-bucket folder, and the least and greatest number of sub-buckets of a bucket.
OCCURRENCES_PER_FOLDER = 8_000_000
SUB_BUCKETS = (1, 4096)
BUCKETS = 26
# Bytes of texts, by Catalyst's estimate, in a task of the build.
TEXT_BYTES = 8 << 20
most_frequent = frequent_words


def corpus_postings(
    docs: DataFrame,
    body: str = "body",
    stopwords: Iterable[str] | None = None,
    frequent_words: int = MAX_BROADCAST_WORDS,
    by: str = "token",
    docs_per_block: int | None = None,
) -> DataFrame:
    """Lazy (term, doc_id, positions) for a (doc_id, body) table.

    Words holding at least 1/``frequent_words`` of all occurrences (at most
    that many words) are broadcast with their stems; any other word is stemmed
    in place. No side of the plan
    is broadcast on a size estimate.

    ``by="word"``: the same, with words counted in batches and grouped in the document's row before they are
    exchanged. ``by="document"``: texts are exchanged instead of positions and words stemmed
    batch by batch (``document_terms``), so no vocabulary is needed and ``frequent_words`` has no part. With ``docs_per_block`` they lie by ``block``, a fourth
    column, for blocks of a nested index or of text lines that need no exchange.
    """
    if by == "document":
        block = ["block"] if docs_per_block else []
        return document_terms(docs, body, stopwords, docs_per_block=docs_per_block).select("term", "doc_id", "positions", *block)
    if by == "word":
        # Stored, for the total and the words above their share of it are two reads.
        counts_path = shared_dir(docs.sparkSession, "word-counts")
        word_counts(docs, body, stopwords).write.parquet(counts_path)
        frequent = with_stems(most_frequent(docs.sparkSession.read.parquet(counts_path), frequent_words))
        return merge_postings(apply_frequent_stems(document_words(docs, body, stopwords), frequent))
    words = with_words(docs, body, stopwords)
    return build_postings(apply_frequent_stems(words, frequent_vocabulary(words, frequent_words)))


def attach_stems(spark: SparkSession, words: DataFrame, max_broadcast_words: int = MAX_BROADCAST_WORDS) -> tuple[DataFrame, str, int]:
    """(words with ``term``, folder of the stored vocabulary, its row count).

    The vocabulary is stemmed once and stored. If it may be broadcast whole, no
    stemmer is compiled next to the token stream.
    """
    path = shared_dir(spark, "vocabulary")
    stem_vocabulary(words, with_counts=True).write.mode("overwrite").parquet(path)
    vocab = spark.read.parquet(path)
    n = vocab.count()
    if n <= max_broadcast_words:
        return apply_stems(words, vocab, broadcast_vocab=True), path, n
    # Bounded broadcast of the frequent words; the tail is stemmed in place.
    return apply_frequent_stems(words, frequent_words(vocab, max_broadcast_words)), path, n


def sub_buckets_for(occurrences: int) -> int:
    """Sub-buckets per bucket: a power of two, so that a folder holds about OCCURRENCES_PER_FOLDER."""
    n = SUB_BUCKETS[0]
    while n < SUB_BUCKETS[1] and n * BUCKETS * OCCURRENCES_PER_FOLDER < occurrences:
        n *= 2
    return n


def build_index(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    body: str = "body",
    stopwords: Iterable[str] | None = None,
    max_broadcast_words: int = MAX_BROADCAST_WORDS,
    num_files: int | None = None,
    input_partitions: int | None = None,
    sub_buckets: int | None = None,
) -> dict:
    """Build and write the index for (doc_id, body) documents; returns build facts.

    ``input_partitions`` spreads the documents round-robin before their words are counted.
    Use it only when the input has fewer row groups than there are cores (a
    single-file table); a large corpus is read in parallel as it is, and
    spreading it would shuffle the raw text once more. ``num_files``: partitions of the
    exchange before the write; ``sub_buckets``: see ``sub_buckets_for``. The fact
    ``vocabulary_broadcast`` says whether the term dictionary has at most
    ``max_broadcast_words`` words, so that a reader may broadcast it whole; the build does not.
    """
    counted = docs.repartition(input_partitions) if input_partitions else docs
    vocab_path = shared_dir(spark, "vocabulary")
    with_stems(word_counts(counted, body, stopwords)).write.parquet(vocab_path)
    vocab = spark.read.parquet(vocab_path)
    facts = vocab.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    occurrences = facts["occurrences"]
    # Terms above 1/SLICES of all occurrences: fewer than SLICES by counting.
    share = max(SLICE_OCCURRENCES, occurrences // SLICES)
    by_term = vocab.groupBy(F.col("stem").alias("term")).agg(F.sum("n").alias("n")).where(F.col("n") > share)
    sliced = by_term.select("term", F.ceil(F.col("n") / F.lit(share)).cast("int").alias("slices"))
    subs = sub_buckets or sub_buckets_for(occurrences)
    tasks = parts_for(plan_bytes(docs.select("doc_id", body)), TEXT_BYTES, spark.sparkContext.defaultParallelism)
    write_merged_index(document_terms(docs, body, stopwords, tasks=tasks), path, subs, sliced, num_files, merged=True)
    write_vocabulary(vocab, path)
    remove_path(spark, vocab_path)
    small = facts["words"] <= max_broadcast_words
    return {"vocabulary_words": facts["words"], "vocabulary_broadcast": small, "occurrences": occurrences, "sub_buckets": subs, "path": path}


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder of the shared checkpoint folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_vocabulary(vocab: DataFrame, index_path: str) -> None:
    """Keep the (word, stem, bucket, n) table next to the index as its term dictionary.

    Sorted by word with disjoint ranges per file, so a lookup of a few words
    reads a few row groups. The folder name starts with '_' and so is not part
    of the index scan.
    """
    (
        vocab.select("word", "stem", bucket_of(F.col("stem")).alias("bucket"), "n")
        .repartitionByRange("word")
        .sortWithinPartitions("word")
        .write.mode("overwrite")
        .parquet(vocabulary_path(index_path))
    )


VOCABULARY_SCHEMA = "word STRING, stem STRING, bucket INT, n BIGINT"


def vocabulary_path(index_path: str) -> str:
    return index_path.rstrip("/") + "/" + VOCABULARY_DIR
