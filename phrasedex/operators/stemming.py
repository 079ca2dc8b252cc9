"""Stems are computed once per distinct word, then attached to the word stream.

A word is cut into maximal letter and digit runs; letter runs are stemmed and
the runs are glued back in order (``running2running -> run2run``). The
vocabulary is much smaller than the token stream, so the per-word cost of the
stemmer is paid once per word, not once per occurrence.

Attaching stems never needs a shuffle of the token stream: the vocabulary (or,
when it is too large, its most frequent words, a table of bounded size) is
broadcast, and a word missing from a bounded table is stemmed in place, a batch
of words at a time. Frequent words, the ones that could fill one task, are
therefore always served by the broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasedex.functions.porter_batch import stems_of
from phrasedex.session import ship_package


def with_stems(vocab: DataFrame) -> DataFrame:
    """A table with a ``word`` column and its ``stem``."""
    ship_package(vocab.sparkSession)
    return vocab.withColumn("stem", stems_of(F.col("word")))


def stem_vocabulary(words: DataFrame, col: str = "word", with_counts: bool = False) -> DataFrame:
    """(word, stem[, n]) for every distinct value of ``col``.

    One shuffle (the distinct / count, combined map-side), then a projection.
    """
    w = words.select(F.col(col).alias("word")).where(F.col("word") != "")
    vocab = w.groupBy("word").agg(F.count(F.lit(1)).alias("n")) if with_counts else w.distinct()
    return with_stems(vocab)


def frequent_words(vocab: DataFrame, limit: int) -> DataFrame:
    """Rows of a (word, stem, n) vocabulary whose word has at least 1/limit of all occurrences.

    At most ``limit`` words can pass (their counts would otherwise exceed the
    total), so the result has a proven size bound, and every word that could
    skew a task is in it. The total is a scalar subquery, not a driver action.
    """
    total = vocab.agg(F.sum("n")).scalar()
    return vocab.where(F.col("n") * F.lit(limit) >= total)


def frequent_vocabulary(words: DataFrame, limit: int, col: str = "word") -> DataFrame:
    """(word, stem, n) for the frequent words of a word stream: at most ``limit`` rows."""
    return frequent_words(stem_vocabulary(words, col, with_counts=True), limit)


def apply_stems(words: DataFrame, vocab: DataFrame, broadcast_vocab: bool = False) -> DataFrame:
    """Attach ``term`` (the stem) to each word row from a complete vocabulary; drops ``word``.

    ``broadcast_vocab`` must only be set by a caller that has checked the size of
    ``vocab`` (see ``plans.build``); otherwise Spark and AQE plan the join from
    measured sizes.
    """
    v = vocab.select("word", F.col("stem").alias("term"))
    if broadcast_vocab:
        v = F.broadcast(v)
    return words.join(v, "word").drop("word")


def apply_frequent_stems(words: DataFrame, frequent: DataFrame) -> DataFrame:
    """Attach ``term`` using a bounded (word, stem) table of frequent words.

    The table is broadcast; words it lacks (the rare tail) are stemmed in place.
    No shuffle, whatever the vocabulary size or the skew of word frequencies.
    """
    f = F.broadcast(frequent.select("word", F.col("stem").alias("_known")))
    ship_package(words.sparkSession)
    joined = words.join(f, "word", "left")
    rare = stems_of(F.when(F.col("_known").isNull(), F.col("word")))
    return joined.withColumn("term", F.coalesce(F.col("_known"), rare)).drop("word", "_known")
