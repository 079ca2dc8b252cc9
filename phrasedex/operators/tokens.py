"""Raw tokens with character offsets, and the normalised words cut from them.

Everything here is row-local: a document's tokens and offsets are computed from
its own row with array expressions, so no shuffle is needed and a long document
costs time linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasedex.functions.text import alnum_runs, block_of, raw_tokens, token_starts
from phrasedex.operators.words import NUMBERED_TYPE, WORDS_TYPE, count_words, grouped_terms, grouped_words, numbered_terms
from phrasedex.session import parts_for, plan_bytes, ship_package


def kept_tokens(body, stopwords: Iterable[str] | None = None) -> Column:
    """Raw tokens of ``body``; with ``stopwords``, drop those whose lower case is listed.

    A token ending in ``>`` is always kept (markup). Dropping happens before
    offsets are taken, so positions count kept tokens only.
    """
    toks = raw_tokens(body)
    if stopwords:
        words = sorted(set(stopwords))
        toks = F.filter(toks, lambda t: t.endswith(">") | ~F.lower(t).isin(*words))
    return toks


def tokenize(docs: DataFrame, body: str = "body", stopwords: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, ord, raw, pos): one row per raw token; ``pos`` is its character offset."""
    with_toks = docs.select("doc_id", kept_tokens(F.col(body), stopwords).alias("_toks"))
    zipped = F.arrays_zip(F.col("_toks").alias("raw"), token_starts("_toks").alias("pos"))
    return (
        with_toks.select("doc_id", F.posexplode(zipped).alias("ord", "t"))
        .select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("t.raw").alias("raw"),
                F.col("t.pos").cast("bigint").alias("pos"))
    )


def explode_terms(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, word): normalised words of each raw token; all share its offset.

    One regex pass cuts the [a-zA-Z0-9] runs; lower-casing happens after the
    explode, inside generated code.
    """
    runs = tokens.select("doc_id", "pos", F.explode(alnum_runs(F.col("raw"))).alias("_run"))
    return runs.select("doc_id", "pos", F.lower(F.col("_run")).alias("word"))


def with_words(docs: DataFrame, body: str = "body", stopwords: Iterable[str] | None = None) -> DataFrame:
    """tokenize + explode_terms without carrying ``ord`` and ``raw`` further."""
    return explode_terms(tokenize(docs, body, stopwords).select("doc_id", "pos", "raw"))


def document_words(docs: DataFrame, body: str = "body", stopwords: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, word, positions ARRAY<INT>): each word of a document with all its offsets, ascending.

    Same words and offsets as ``with_words``, grouped where the document's row is, a batch of
    documents at a time (``operators.words``), so no aggregate and no shuffle is needed and
    the rows that leave are one per distinct word. A document that comes in several rows gives several groups.
    """
    ship_package(docs.sparkSession)
    grouped = F.arrow_udf(grouped_words, WORDS_TYPE)(_kept_text(body, stopwords))
    rows = docs.select("doc_id", grouped.alias("_words")).select("doc_id", F.explode("_words").alias("g"))
    return rows.select("doc_id", F.col("g.word").alias("word"), F.col("g.positions").alias("positions"))


def document_terms(docs: DataFrame, body: str = "body", stopwords: Iterable[str] | None = None, numbers: bool = False, tasks: int | None = None, docs_per_block: int | None = None) -> DataFrame:
    """(doc_id, term, positions ARRAY<INT>): each stem of a document with all its offsets, ascending; one row per term and document.

    Texts meet by ``doc_id`` in the one exchange, so neither words nor positions are shuffled, and a
    document that comes in several rows gives one row per term. A batch's different words are stemmed once.
    ``numbers``: also ``tokens ARRAY<INT>``, the number of the raw token of each offset in its text.
    ``tasks``: see ``by_document``.
    ``docs_per_block``: also ``block``, by which texts are dealt instead: the documents of a span of so many ids lie in
    one task, and what is grouped by term and block after it needs no exchange.
    """
    ship_package(docs.sparkSession)
    kept = docs.select("doc_id", _kept_text(body, stopwords).alias("text"))
    keys = ["doc_id"]
    if docs_per_block:
        kept, keys = kept.withColumn("block", block_of(F.col("doc_id"), docs_per_block)), ["block", "doc_id"]
    texts = by_document(kept, tasks=tasks, key=keys[0]).groupBy(*keys).agg(F.collect_list("text").alias("texts"))
    cut = F.arrow_udf(numbered_terms, NUMBERED_TYPE) if numbers else F.arrow_udf(grouped_terms, WORDS_TYPE)
    rows = texts.select(*keys, cut("texts").alias("_terms")).select(*keys, F.explode("_terms").alias("g"))
    fields = {"term": "word", "positions": "positions"} | ({"tokens": "tokens"} if numbers else {})
    return rows.select(*keys, *(F.col(f"g.{c}").alias(name) for name, c in fields.items()))


def document_texts(docs: DataFrame, body: str = "body", stopwords: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, texts ARRAY<STRING>): all texts of a document in one row, as ``document_terms`` cuts them."""
    kept = docs.select("doc_id", _kept_text(body, stopwords).alias("text"))
    return by_document(kept).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


# Bytes of a table, by Catalyst's estimate for its columns, in a task that holds whole documents.
DOCUMENT_BYTES = 1 << 20


def by_document(rows: DataFrame, per_task: int = DOCUMENT_BYTES, tasks: int | None = None, key: str = "doc_id") -> DataFrame:
    """``rows`` dealt to tasks by ``doc_id`` (or ``key``), as many as their size asks for or ``tasks``; what is grouped by document (and more) after it needs no exchange."""
    spark = rows.sparkSession
    # Two sides that both lie by document are joined by (query, document) where they are.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.repartition(tasks or parts_for(plan_bytes(rows), per_task, spark.sparkContext.defaultParallelism), key)


def word_counts(docs: DataFrame, body: str = "body", stopwords: Iterable[str] | None = None) -> DataFrame:
    """(word, n): occurrences of every word of the documents; batches are counted before the one exchange."""
    ship_package(docs.sparkSession)
    counted = docs.select(_kept_text(body, stopwords).alias("text")).mapInArrow(count_words, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _kept_text(body: str, stopwords: Iterable[str] | None) -> Column:
    return F.array_join(kept_tokens(F.col(body), stopwords), " ") if stopwords else F.col(body).cast("string")
