"""Token counts: exact length histogram of encoded documents and its suffix sums.

Documents are encoded in place and counted by length, so only (length, count)
rows are shuffled. Suffix sums over the histogram answer, for every context
limit, how many documents and tokens there are, how many are cut, and how many
tokens stay if each document is truncated to the limit; cumulative counts
answer quantiles.

Defined cases: null or empty text has 0 tokens; repeated ids count as separate
documents; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasedex.session import shared_dir

from .common import table
from .encoding import encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Lengths of one class share a task in the suffix sums.
CLASS_SPAN = 1024


def token_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(n_tokens) per document, no special tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        for texts in batches:
            yield pd.Series([len(b) // 4 for b in enc.encode(texts.fillna("").tolist())], dtype="int64")
        enc.rest()

    return docs.select(count(F.col(text_col).cast("string")).alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs)."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L of the histogram, all exact:

    docs (of length L), docs_longer and tokens_longer (length > L), tokens_total,
    tokens_kept (each document cut to L), tokens_cut, and quantile_to (share of
    documents of length <= L). Sums run in two levels, classes of lengths and
    lengths inside a class, so no task holds all lengths.
    """
    cls = F.floor(F.col("n_tokens") / CLASS_SPAN)
    h = hist.withColumns({"cls": cls, "tokens": F.col("n_tokens") * F.col("docs")})
    after = Window.orderBy(F.col("cls").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    c = h.groupBy("cls").agg(F.sum("docs").alias("c_docs"), F.sum("tokens").alias("c_tokens"))
    c = c.select(
        F.col("cls").alias("c_cls"),
        F.coalesce(F.sum("c_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("c_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("c_docs").over(everything).alias("docs_total"),
        F.sum("c_tokens").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("cls").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({
        "in_docs": F.coalesce(F.sum("docs").over(inside), F.lit(0)),
        "in_tokens": F.coalesce(F.sum("tokens").over(inside), F.lit(0)),
    })
    j = h.join(c, h["cls"] == c["c_cls"]).withColumns({
        "docs_longer": F.col("docs_after") + F.col("in_docs"),
        "tokens_longer": F.col("tokens_after") + F.col("in_tokens"),
    })
    cut = F.col("tokens_longer") - F.col("n_tokens") * F.col("docs_longer")
    return j.select(
        "n_tokens", "docs", "docs_longer", "tokens_longer", "tokens_total",
        (F.col("tokens_total") - cut).alias("tokens_kept"), cut.alias("tokens_cut"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile_to"),
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, tokens_kept, tokens_cut) for any limits, in one pass over the suffix sums.

    A limit takes the sums of the longest length <= it; below the shortest, everything is longer.
    """
    found = [
        F.struct(
            F.lit(x).cast("long").alias("context_limit"),
            F.max_by(F.struct("docs_longer", "tokens_longer"), F.when(F.col("n_tokens") <= x, F.col("n_tokens"))).alias("b"),
            F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"),
            F.coalesce(F.max("tokens_total"), F.lit(0)).alias("tokens"),
        )
        for x in limits
    ]
    rows = sums.agg(F.array(*found).alias("x")).select(F.inline("x"))
    longer = F.coalesce("b.docs_longer", "docs")
    cut = F.coalesce("b.tokens_longer", "tokens") - longer * F.col("context_limit")
    return rows.select("context_limit", longer.alias("docs_longer"), (F.col("tokens") - cut).alias("tokens_kept"), cut.alias("tokens_cut"))


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): smallest length that covers at least that share of the documents."""
    found = [
        F.struct(F.lit(float(x)).alias("share"), F.min(F.when(F.col("quantile_to") >= x, F.col("n_tokens"))).alias("n_tokens"))
        for x in shares
    ]
    return sums.agg(F.array(*found).alias("x")).select(F.inline("x"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    # The histogram is used at both levels of the sums; it is stored so that texts are encoded once.
    path = shared_dir(spark, "length-histogram")
    length_histogram(token_lengths(table(spark, sf_dir, "documents"))).write.parquet(path)
    return suffix_sums(spark.read.parquet(path))
