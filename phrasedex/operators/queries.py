"""Phrase batches: parse, stem, and compute the offset each word must sit at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasedex.functions.text import bucket_of, sub_words, token_starts
from phrasedex.functions.porter import stem_of_word

# A phrase can only match where its inner words carry no punctuation: offsets
# count raw characters, word lengths are taken after normalisation. A text is
# therefore cut into clauses: a run of plain [A-Za-z0-9] tokens followed by one
# more token (which ends the clause). Every token lands in exactly one clause.
CLAUSE = "((?:[A-Za-z0-9]+[ \\t\\n\\x0B\\f\\r]+)*[^ \\t\\n\\x0B\\f\\r]+)"
# query_id = item_id * CLAUSE_ID_SPAN + clause number (0-based). A text with more
# clauses fails the job (and an id too large for the product overflows loudly),
# so two items never share an id.
CLAUSE_ID_SPAN = 1_000_000


def _clause_id(item, number):
    whole = item.cast("decimal(38,0)") * CLAUSE_ID_SPAN + number
    fits = (number < CLAUSE_ID_SPAN) & whole.between(-(2**63), 2**63 - 1)
    problem = F.concat(F.lit("no clause id for item "), item.cast("string"), F.lit(", clause "), number.cast("string"))
    return F.when(fits, whole.cast("bigint")).otherwise(F.raise_error(problem).cast("bigint"))


def benchmark_phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, query): every clause of every item text is one phrase."""
    return items.select(
        F.col(id_col).alias("_item"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(CLAUSE), 1)).alias("_n", "query")
    ).select(_clause_id(F.col("_item"), F.col("_n")).alias("query_id"), "query")


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, k, word, word_len, start_offset, n_terms): unstemmed words of each phrase.

    Words are the normalised query split on spaces; ``word_len`` is the length of
    the unstemmed word, ``start_offset`` the running sum of ``word_len + 1`` over
    the words before it. Blank queries give no rows.
    """
    words = queries.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        sub_words(F.col("query")).alias("_words"),
    )
    parsed = words.select(
        "query_id",
        F.arrays_zip(F.col("_words").alias("word"), token_starts("_words").alias("start_offset")).alias("_z"),
        F.size("_words").alias("n_terms"),
    ).where(F.col("n_terms") > 0)
    return parsed.select("query_id", "n_terms", F.posexplode("_z").alias("k", "_t")).select(
        "query_id",
        F.col("k").cast("int").alias("k"),
        F.col("_t.word").alias("word"),
        F.length(F.col("_t.word")).cast("int").alias("word_len"),
        F.col("_t.start_offset").cast("bigint").alias("start_offset"),
        F.col("n_terms").cast("int").alias("n_terms"),
    )


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, k, word, term, word_len, start_offset, n_terms, bucket).

    Query words are stemmed in place: a phrase batch is small, and this keeps
    parsing free of shuffles.
    """
    words = query_words(queries).withColumn("term", stem_of_word())
    return words.select(
        "query_id", "k", "word", "term", "word_len", "start_offset", "n_terms", bucket_of(F.col("term")).alias("bucket")
    )


def query_buckets(parsed: DataFrame) -> DataFrame:
    """(query_id, bucket): the index parts a query has to read."""
    return parsed.select("query_id", "bucket").distinct()


__all__ = ["CLAUSE", "CLAUSE_ID_SPAN", "benchmark_phrases", "query_words", "parse_queries", "query_buckets"]
