"""Phrase search over postings: lookup, AND filter, adjacency, partial chains.

Adjacency rule: word k+1 must start at ``pos_k + len(word_k) + 1``, where the
length is that of the unstemmed query word and ``pos`` a raw-character offset.
A full chain from offset ``s`` exists exactly when, for every k, term k has a
position ``s + start_offset_k``. So instead of a chain of n-1 joins, every
distinct position p of word k votes for the start ``p - start_offset_k``, and a
start with ``n_terms`` votes is a match.

Shuffles: the lookup joins a broadcast (size-checked) query table to the index
scan. The AND filter runs first on light rows (no positions are read for it);
only rows of candidate documents carry their positions into the one exchange on
(query_id, doc_id), which the vote aggregation on (query_id, doc_id, start)
reuses. A (query, document) group holds at most ``n_terms`` posting rows, so a
frequent term spreads over many groups instead of filling one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasedex.operators.tokens import by_document

LOOKUP_COLUMNS = ["query_id", "k", "doc_id", "positions", "start_offset", "n_terms"]


def lookup_terms(index: DataFrame, parsed: DataFrame, broadcast_queries: bool = False) -> DataFrame:
    """(query_id, k, doc_id, positions, start_offset, n_terms): postings of each query word.

    Equality on (bucket, term). ``broadcast_queries`` is set by callers that
    checked the size of the parsed batch; otherwise Spark/AQE choose.
    """
    q = parsed.select("bucket", "term", "query_id", "k", "start_offset", "n_terms")
    idx = index.select("bucket", "term", "doc_id", "positions")
    if not broadcast_queries:
        return idx.join(q, ["bucket", "term"]).select(*LOOKUP_COLUMNS)
    # A posting meets its term once and is repeated for the words after that; what is computed of it before is computed once.
    uses = q.groupBy("bucket", "term").agg(F.collect_list(F.struct("query_id", "k", "start_offset", "n_terms")).alias("uses"))
    met = idx.join(F.broadcast(uses), ["bucket", "term"]).select("doc_id", "positions", F.explode("uses").alias("q"))
    return met.select("q.query_id", "q.k", "doc_id", "positions", "q.start_offset", "q.n_terms")


def deal_postings(index: DataFrame, parsed: DataFrame, broadcast_queries: bool = False) -> DataFrame:
    """The batch's postings, dealt by ``doc_id`` before they meet the phrases.

    Each posting is moved once, however many phrases hold its word; the rows of ``lookup_terms`` then lie by
    document, and the AND, the votes and the counts are made where they are.
    """
    terms = parsed.select("bucket", "term").distinct()
    wanted = index.select("bucket", "term", "doc_id", "positions").join(F.broadcast(terms) if broadcast_queries else terms, ["bucket", "term"], "left_semi")
    return by_document(wanted)


def _in_documents_of_rarest(index: DataFrame, parsed: DataFrame, broadcast_queries: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words of longer phrases, their postings dealt by document, (query_id, doc_id, held, held_offset) for each posting of a phrase's rarest word)."""
    small = F.broadcast if broadcast_queries else lambda df: df
    words = parsed.where(F.col("n_terms") > 1).select("bucket", "term", "query_id", "k", "start_offset", "n_terms")
    dealt = deal_postings(index, words, broadcast_queries)
    df = dealt.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    anchors = (
        words.join(small(df), ["bucket", "term"], "left")
        .groupBy("query_id")
        .agg(F.min_by(F.struct("bucket", "term", "start_offset"), F.struct(F.coalesce("df", F.lit(0)), "k")).alias("a"))
        .select("query_id", "a.bucket", "a.term", F.col("a.start_offset").alias("held_offset"))
    )
    held = dealt.join(small(anchors), ["bucket", "term"]).select("query_id", "doc_id", F.col("positions").alias("held"), "held_offset")
    return words, dealt, held


def _fetched(dealt: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` with the posting of their (doc_id, bucket, term); a task holds its postings and reads past the keys."""
    return keys.join(dealt.hint("shuffle_hash"), ["doc_id", "bucket", "term"])


def lookup_rarest(index: DataFrame, parsed: DataFrame, broadcast_queries: bool = False) -> DataFrame:
    """``lookup_terms`` of phrases of two words or more, only in documents that hold the phrase's rarest word.

    No other document holds the phrase, so matches are the same, while a frequent word is not
    repeated for every phrase and document. The batch's postings are dealt by document once; a phrase's
    documents come from the postings of its rarest word, and its other words are looked up in them
    by one join on (doc_id, bucket, term) that moves no posting again. Rows without an id take no part, as in the AND of ``_candidate_rows``.
    """
    words, dealt, held = _in_documents_of_rarest(index, parsed, broadcast_queries)
    keys = held.select("query_id", "doc_id").distinct().join(F.broadcast(words) if broadcast_queries else words, "query_id")
    return _fetched(dealt, keys).select(*LOOKUP_COLUMNS)


def lookup_aligned(index: DataFrame, parsed: DataFrame, broadcast_queries: bool = False) -> DataFrame:
    """``lookup_rarest`` with those positions only that vote for a start that the phrase's rarest word votes for.

    A start that misses this vote is no match, so matches are the same, while the positions of a frequent word
    are neither expanded nor grouped. Words without such a position have no row: the rows are for ``phrase_match`` and
    ``matching_docs`` with ``aligned``, not for an AND or for steps.
    """
    words, dealt, held = _in_documents_of_rarest(index, parsed, broadcast_queries)
    keys = held.join(F.broadcast(words) if broadcast_queries else words, "query_id")
    # Positions are INT; one beyond is no position.
    wanted = F.transform("held", lambda p: (p.cast("bigint") - F.col("held_offset") + F.col("start_offset")).try_cast("int"))
    found = F.array_intersect("positions", wanted)
    rows = _fetched(dealt, keys).select("query_id", "k", "doc_id", found.alias("positions"), "start_offset", "n_terms")
    return rows.where(F.size("positions") > 0)


def candidate_docs(lookup: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents that hold every word of the query (AND).

    All words are present when the group's distinct word numbers are n_terms;
    rows that repeat a (term, doc_id), as from index parts that share documents,
    change nothing. Only light columns are read (no positions). Word numbers are set as
    bits, 64 to a row, and the bits counted; rows that lie by ``doc_id`` (``by_document``)
    are not exchanged for it.
    """
    bits = (
        lookup.select("query_id", "doc_id", "n_terms", F.floor(F.col("k") / 64).alias("_part"), F.expr("shiftleft(1L, k % 64)").alias("_bit"))
        .groupBy("query_id", "doc_id", "_part")
        .agg(F.bit_or("_bit").alias("_bits"), F.max("n_terms").alias("_n"))
    )
    return (
        bits.groupBy("query_id", "doc_id")
        .agg(F.sum(F.bit_count("_bits")).alias("_present"), F.max("_n").alias("_n"))
        .where(F.col("_present") == F.col("_n"))
        .select("query_id", "doc_id")
    )


def _candidate_rows(lookup: DataFrame, candidates: DataFrame | None, broadcast_candidates: bool) -> DataFrame:
    """Lookup rows of multi-word phrases restricted to documents holding every word.

    The AND runs on light rows first (``candidate_docs`` reads no positions), and
    only then are the position arrays moved: by a map-side semi-join against
    broadcast candidates when their count was checked, else by a shuffle-hash
    semi-join whose partitioning, by ``doc_id`` if the rows lie so, the vote aggregation reuses.
    """
    multi = lookup.where(F.col("n_terms") > 1)
    if candidates is None:
        candidates = candidate_docs(multi)
    c = candidates.select("query_id", "doc_id")
    if broadcast_candidates:
        # Filtered map-side; then one exchange on (query_id, doc_id) that the
        # vote aggregation and the per-document count both reuse.
        return multi.join(F.broadcast(c), ["query_id", "doc_id"], "left_semi").repartition("query_id", "doc_id")
    return multi.join(c.hint("shuffle_hash"), ["query_id", "doc_id"], "left_semi")


def _start_votes(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, k, n_terms, start, p): each distinct position p of word k votes once for ``p - start_offset_k``.

    The distinct is local: rows are partitioned by (query_id, doc_id) already. Rows that repeat a word and
    document change nothing.
    """
    votes = rows.select(
        "query_id", "doc_id", "k", "n_terms", "start_offset", F.explode("positions").alias("p")
    ).withColumn("start", F.col("p").cast("bigint") - F.col("start_offset"))
    return votes.groupBy("query_id", "doc_id", "start", "k").agg(F.first("n_terms").alias("n_terms"), F.first("p").alias("p"))


def _one_word_matches(lookup: DataFrame) -> DataFrame:
    return lookup.where(F.col("n_terms") == 1).select(
        "query_id", "doc_id", F.explode(F.array_distinct("positions")).alias("_p")
    ).select("query_id", "doc_id", F.col("_p").cast("bigint").alias("start_pos"))


def _multi_word_matches(lookup: DataFrame, candidates: DataFrame | None, broadcast_candidates: bool, aligned: bool) -> DataFrame:
    rows = lookup.where(F.col("n_terms") > 1) if aligned else _candidate_rows(lookup, candidates, broadcast_candidates)
    votes = _start_votes(rows)
    return (
        votes.groupBy("query_id", "doc_id", "start")
        .agg(F.count(F.lit(1)).alias("_votes"), F.first("n_terms").alias("_n"))
        .where(F.col("_votes") == F.col("_n"))
        .select("query_id", "doc_id", F.col("start").alias("start_pos"))
    )


def phrase_match(lookup: DataFrame, candidates: DataFrame | None = None, broadcast_candidates: bool = False, aligned: bool = False) -> DataFrame:
    """(query_id, doc_id, start_pos): every offset at which the whole phrase starts.

    One-word phrases need no grouping: each distinct position is a start, read
    straight off the lookup with no shuffle. Longer phrases: a start with
    n_terms votes (one per word; (k, start) is unique) is a match.
    ``candidates`` may be a precomputed (and size-checked) ``candidate_docs``. ``aligned``: the
    lookup is ``lookup_aligned``'s, whose votes need no AND before them.
    """
    return _one_word_matches(lookup).unionByName(_multi_word_matches(lookup, candidates, broadcast_candidates, aligned))


def phrase_docs(matches: DataFrame) -> DataFrame:
    """(query_id, doc_id, n_matches) from any match table."""
    return matches.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_matches"))


def matching_docs(lookup: DataFrame, candidates: DataFrame | None = None, broadcast_candidates: bool = False, aligned: bool = False) -> DataFrame:
    """(query_id, doc_id, n_matches) straight from the lookup, without an extra exchange.

    A one-word phrase matches once per distinct position of its word; longer
    phrases count their starts by (query_id, doc_id), which the vote exchange
    already partitions by.
    """
    one = lookup.where(F.col("n_terms") == 1).select(
        "query_id", "doc_id", F.size(F.array_distinct("positions")).cast("bigint").alias("n_matches")
    )
    return one.unionByName(phrase_docs(_multi_word_matches(lookup, candidates, broadcast_candidates, aligned)))


def partial_phrase_matches(
    lookup: DataFrame, candidates: DataFrame | None = None, broadcast_candidates: bool = False
) -> DataFrame:
    """(query_id, doc_id, step, pos): chain positions, reported step by step.

    Step s (1-based) lists each position of word s-1 from which words 0..s all
    follow each other, even if the phrase breaks later; only documents holding
    every word take part. Of the words that vote for a start, word s ends an
    unbroken prefix when it is the (s+1)-th by number: a running count per start
    tells, and the position before it in that order is word s-1's. The count runs
    over rows sorted inside the vote partitions; no list per start is gathered.
    One-word phrases have no steps.
    """
    votes = _start_votes(_candidate_rows(lookup, candidates, broadcast_candidates))
    chain = Window.partitionBy("query_id", "doc_id", "start").orderBy("k")
    counted = votes.select(
        "query_id", "doc_id", "k", F.row_number().over(chain).alias("_count"), F.lag("p").over(chain).alias("_before")
    )
    return counted.where((F.col("_count") == F.col("k") + 1) & (F.col("k") > 0)).select(
        "query_id", "doc_id", F.col("k").cast("int").alias("step"), F.col("_before").cast("bigint").alias("pos")
    )


def single_term_docs(index: DataFrame, parsed: DataFrame, broadcast_queries: bool = False) -> DataFrame:
    """(query_id, doc_id, positions) for one-word queries: every document holding the term."""
    one = parsed.where(F.col("n_terms") == 1)
    return lookup_terms(index, one, broadcast_queries).select("query_id", "doc_id", "positions")
