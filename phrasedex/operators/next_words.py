"""Next-word index: postings of adjacent word pairs whose first word is frequent.

A phrase of frequent words has no rare word to start from. Its pairs are far rarer
than its words: the pair (first, gap, second) lists the offsets of ``first`` that have
``second`` exactly ``gap`` characters later. By the adjacency rule the gap after a
query word is its unstemmed length plus 1, so pairs are kept for every length that
a corpus word of the first term's stem has. A phrase is covered if each of its words
but the last is frequent with its length; it is then answered from pairs alone, and
the postings of its words are never read. All other phrases take the plain lookup.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasedex.operators.search import lookup_rarest, lookup_terms, phrase_match
from phrasedex.operators.words import PAIRS_TYPE, paired_terms
from phrasedex.session import ship_package


def frequent_lengths(vocabulary: DataFrame, limit: int) -> DataFrame:
    """(term, word_len) of terms with at least 1/limit of all occurrences, from a (word, stem, n) vocabulary.

    At most ``limit`` terms pass (by counting), each with the few lengths of its words.
    """
    total = vocabulary.agg(F.sum("n")).scalar()
    terms = vocabulary.groupBy(F.col("stem").alias("term")).agg(F.sum("n").alias("n"), F.collect_set(F.length("word")).alias("lengths"))
    return terms.where(F.col("n") * F.lit(limit) >= total).select("term", F.explode("lengths").alias("word_len"))


def _document_pairs(documents: DataFrame, frequent: DataFrame) -> DataFrame:
    lengths: dict[str, list[int]] = {}
    for r in frequent.select("term", "word_len").distinct().collect():
        lengths.setdefault(r["term"], []).append(r["word_len"])
    ship_package(documents.sparkSession)

    def pairs(texts: pa.Array) -> pa.Array:
        return paired_terms(texts, lengths)

    own = documents.where("doc_id is not null").select("doc_id", F.arrow_udf(pairs, PAIRS_TYPE)("texts").alias("_pairs"))
    return own.select("doc_id", F.explode("_pairs").alias("p")).select("p.first", "p.gap", "p.second", "doc_id", "p.positions")


def build_next_words(terms: DataFrame, frequent: DataFrame) -> DataFrame:
    """(first, gap, second, doc_id, positions) from (doc_id, pos, term) rows; ``frequent`` is broadcast.

    Positions meet what stands ``gap`` further by one join on (doc_id, offset), keys that
    no term and no document fills, whatever the frequency of a word.

    From (doc_id, texts) rows (``document_texts``) pairs are made in the document's row, so neither positions nor
    pairs are exchanged; ``frequent``, whose rows ``frequent_lengths`` bounds, goes with the function. Rows without an id take no part in either.
    """
    if "texts" in terms.columns:
        return _document_pairs(terms, frequent)
    firsts = terms.join(F.broadcast(frequent), "term").select(
        "doc_id", F.col("term").alias("first"), (F.col("word_len") + 1).alias("gap"), "pos", (F.col("pos") + F.col("word_len") + 1).alias("at")
    )
    seconds = terms.select("doc_id", F.col("pos").alias("at"), F.col("term").alias("second"))
    pairs = firsts.join(seconds, ["doc_id", "at"])
    return pairs.groupBy("first", "gap", "second", "doc_id").agg(F.sort_array(F.collect_set(F.col("pos").cast("int"))).alias("positions"))


def phrase_pairs(parsed: DataFrame) -> DataFrame:
    """(query_id, k, first, gap, second, start_offset, n_terms): the pairs of each phrase of two words or more."""
    order = Window.partitionBy("query_id").orderBy("k")
    return parsed.withColumn("second", F.lead("term").over(order)).where("second is not null").select(
        "query_id", "k", F.col("term").alias("first"), (F.col("word_len") + 1).alias("gap"), "second", "start_offset", "n_terms"
    )


def covered_phrases(parsed: DataFrame, frequent: DataFrame) -> DataFrame:
    """(query_id) of phrases whose words but the last are all frequent with their lengths."""
    known = frequent.select(F.col("term").alias("first"), (F.col("word_len") + 1).alias("gap")).withColumn("known", F.lit(True))
    marked = phrase_pairs(parsed).join(F.broadcast(known), ["first", "gap"], "left")
    return marked.groupBy("query_id").agg(F.min(F.coalesce("known", F.lit(False))).alias("all")).where("all").select("query_id")


def pair_matches(pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    """(query_id, doc_id, start_pos) of covered phrases: starts that every pair of the phrase votes for."""
    wanted = phrase_pairs(parsed)
    hits = pairs.join(F.broadcast(wanted), ["first", "gap", "second"])
    votes = hits.select("query_id", "doc_id", "k", "n_terms", "start_offset", F.explode("positions").alias("p"))
    votes = votes.withColumn("start_pos", F.col("p").cast("bigint") - F.col("start_offset"))
    counted = votes.groupBy("query_id", "doc_id", "start_pos").agg(F.count("*").alias("votes"), F.first("n_terms").alias("n"))
    return counted.where("votes = n - 1").select("query_id", "doc_id", "start_pos")


def phrase_match_with_pairs(index: DataFrame, pairs: DataFrame, parsed: DataFrame, frequent: DataFrame) -> DataFrame:
    """``phrase_match`` of a parsed batch (counted and broadcast by the caller): covered phrases from pairs, the others from their postings."""
    covered = covered_phrases(parsed, frequent)
    by_pairs = parsed.join(F.broadcast(covered), "query_id", "left_semi")
    rest = parsed.join(F.broadcast(covered), "query_id", "left_anti")
    one, many = rest.where(F.col("n_terms") == 1), rest.where(F.col("n_terms") > 1)
    plain = phrase_match(lookup_terms(index, one, broadcast_queries=True)).unionByName(phrase_match(lookup_rarest(index, many, broadcast_queries=True)))
    return pair_matches(pairs, by_pairs).unionByName(plain)
