"""Phrase search jobs over a stored index.

Batch: the parsed batch is checkpointed (small, lineage cut), its size checked
before it is broadcast, its bucket set (at most 26 values) turned into literal
partition filters. Up to MAX_LITERAL_TERMS distinct terms become a pushed-down IN
filter that skips row groups; the folders of more terms, whatever their number,
are pruned at run time by the batch's own table. Documents holding every word of a phrase are found
first from (term, doc_id) alone; their count is checked before they are
broadcast, so positions of frequent words are only shuffled for documents
that can match.

Single phrase: the phrase is parsed by the same Spark operators; its words are looked
up in the term dictionary, and only the folders of its few terms (bounded by the
phrase length) are listed and opened, in one job with one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasedex.functions.porter import stem_of_word
from phrasedex.functions.text import bucket_of, let, sub_words, token_starts
from phrasedex.operators.bitmaps import candidate_docs_by_bitmap, dense
from phrasedex.operators.postings import merge_postings, with_bucket
from phrasedex.operators.queries import parse_queries
from phrasedex.plans.build import VOCABULARY_SCHEMA, vocabulary_path
from phrasedex.operators.search import (
    LOOKUP_COLUMNS,
    candidate_docs,
    lookup_aligned,
    lookup_rarest,
    lookup_terms,
    matching_docs,
    partial_phrase_matches,
    phrase_match,
)
from phrasedex.session import shared_dir
from phrasedex.sources.index_store import read_index, read_terms

MAX_BROADCAST_QUERY_WORDS = 5_000_000
# Distinct terms of a batch sent to the Parquet reader as a literal IN list (a
# chain of as many comparisons, tested once per row group).
MAX_LITERAL_TERMS = 1_000
# (query, word, doc) keys fetched by the anchored lookup, at most; a row of seven
# columns is about 100 bytes as a broadcast hash table.
MAX_BROADCAST_NEEDED = 1_000_000
# A phrase whose rarest word is in more documents than this takes the plain lookup.
MAX_ANCHOR_DOCS = 1_000_000
# (query_id, doc_id) pairs: 16 bytes each, about 100 MB as a broadcast hash table.
MAX_BROADCAST_CANDIDATES = 4_000_000
BUCKETS = 26


@dataclass
class SearchResult:
    parsed: DataFrame
    lookup: DataFrame
    matches: DataFrame
    docs: DataFrame
    steps: DataFrame


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        shared_dir(spark, "init")


def prepare_batch(spark: SparkSession, queries: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """Parse, checkpoint, count and list the buckets of a phrase batch."""
    _ensure_checkpoint_dir(spark)
    parsed = parse_queries(queries).checkpoint(eager=True)
    n = parsed.count()
    # At most 26 distinct values, whatever the batch size.
    buckets = sorted(r[0] for r in parsed.select("bucket").distinct().collect())
    return parsed, n, buckets


def batch_terms(parsed: DataFrame, limit: int = MAX_LITERAL_TERMS) -> list[str] | None:
    """The batch's distinct terms as a literal list, or None when there are more than ``limit``.

    Pushed to Parquet as an IN predicate, they let each task skip every row
    group (the index is sorted by term) whose term range holds none of them.
    """
    distinct = parsed.select("term").distinct()
    if distinct.count() > limit:
        return None
    return sorted(r[0] for r in distinct.collect())


def anchored_lookup(
    spark: SparkSession,
    index: DataFrame,
    parsed: DataFrame,
    max_needed: int,
    max_anchor_docs: int | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(lookup rows restricted, per phrase, to documents holding its rarest word; the parsed phrases left over).

    1. document frequency of each batch term (a count over the term column);
    2. per phrase, its anchor: the word of least document frequency;
    3. (phrase, doc) pairs from the anchor's postings only;
    4. the needed (bucket, term, doc_id) keys: those pairs times the phrase's
       words, checkpointed and counted before they are broadcast;
    5. postings (with positions) fetched by an equi-join on those keys.
    A document without the anchor cannot hold the phrase, so results are
    unchanged, while a frequent word is never expanded over all its documents
    for every phrase that contains it. A phrase costs its anchor's documents
    times its words; phrases go this way, cheapest first, while their costs add
    up to at most ``max_needed`` (so step 4 is bounded before it is made), and
    if their anchor is in at most ``max_anchor_docs`` documents. The others are left
    to the plain lookup. Either part is None if it has no phrase.
    """
    keys = parsed.select("bucket", "term").distinct()
    df = (
        index.select("bucket", "term")
        .join(F.broadcast(keys), ["bucket", "term"], "left_semi")
        .groupBy("bucket", "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    words = parsed.join(F.broadcast(keys.join(df, ["bucket", "term"], "left")), ["bucket", "term"])
    anchors = (
        words.withColumn("df", F.coalesce(F.col("df"), F.lit(0)))
        .groupBy("query_id")
        .agg(F.min_by(F.struct("bucket", "term", "df"), F.struct("df", "k")).alias("a"), F.first("n_terms").alias("n_terms"))
        .select("query_id", F.col("a.bucket").alias("bucket"), F.col("a.term").alias("term"), F.col("a.df").alias("df"), "n_terms")
        .withColumn("cost_class", F.length(F.bin(F.col("df") * F.col("n_terms"))))
        .checkpoint(eager=True)
    )
    # Costs by their number of binary digits: at most 64 rows.
    allowed = anchors if max_anchor_docs is None else anchors.where(F.col("df") <= max_anchor_docs)
    cost = F.sum(F.col("df") * F.col("n_terms"))
    top, total = -1, 0
    for r in sorted(allowed.groupBy("cost_class").agg(cost.alias("cost")).collect()):
        total += r["cost"]
        if total > max_needed:
            break
        top = r["cost_class"]
    if top < 0:
        return None, parsed
    routed = allowed.where(F.col("cost_class") <= top)
    pairs = index.select("bucket", "term", "doc_id").join(F.broadcast(routed.select("query_id", "bucket", "term")), ["bucket", "term"])
    needed = (
        pairs.select("query_id", "doc_id")
        .join(F.broadcast(parsed.select("query_id", "k", "bucket", "term", "start_offset", "n_terms")), "query_id")
        .checkpoint(eager=True)
    )
    lookup = index.join(F.broadcast(needed), ["bucket", "term", "doc_id"]).select(*LOOKUP_COLUMNS)
    others = anchors.join(F.broadcast(routed.select("query_id")), "query_id", "left_anti").select("query_id")
    if others.isEmpty():
        return lookup, None
    return lookup, parsed.join(F.broadcast(others), "query_id", "left_semi")


def _merged_batch(spark: SparkSession, paths: list[str], buckets: list[int], terms: list[str] | None, parsed: DataFrame, small: bool) -> DataFrame:
    """The postings of the batch's terms from several indexes, merged and stored: they are read several times, but meet by term and document once."""
    own = parsed.select("bucket", "term").distinct()
    parts = [
        read_index(spark, p, buckets=buckets, terms=terms, wanted=None if terms is not None else own).join(
            F.broadcast(own) if small else own, ["bucket", "term"], "left_semi"
        )
        for p in paths
    ]
    path = shared_dir(spark, "batch-postings")
    with_bucket(merge_postings(*parts)).write.parquet(path)
    return spark.read.parquet(path).select("bucket", "term", "doc_id", "positions")


def search_batch(
    spark: SparkSession,
    index_path: str | list[str],
    queries: DataFrame,
    max_broadcast_words: int = MAX_BROADCAST_QUERY_WORDS,
    max_broadcast_candidates: int = MAX_BROADCAST_CANDIDATES,
    max_needed: int = MAX_BROADCAST_NEEDED,
    max_anchor_docs: int | None = MAX_ANCHOR_DOCS,
    max_literal_terms: int = MAX_LITERAL_TERMS,
) -> SearchResult:
    """Answer a (query_id, query) batch against the index at ``index_path``."""
    parsed, n, buckets = prepare_batch(spark, queries)
    terms = batch_terms(parsed, max_literal_terms)
    bounded = n <= max_broadcast_words
    wanted = None if terms is not None else parsed.select("bucket", "term")
    if isinstance(index_path, str) or len(index_path) == 1:
        index = read_index(spark, index_path, buckets=buckets, terms=terms, wanted=wanted)
    else:
        index = _merged_batch(spark, list(index_path), buckets, terms, parsed, bounded)
    anchored, rest = anchored_lookup(spark, index, parsed, max_needed, max_anchor_docs) if bounded else (None, parsed)
    # Lookups of phrases that no other holds, each with its candidates.
    parts = [] if anchored is None else [(anchored, candidate_docs(anchored.where(F.col("n_terms") > 1)))]
    lookup = anchored
    if rest is not None:
        plain = lookup_terms(index, rest, broadcast_queries=bounded)
        # Words in many documents: the AND on bitmaps, if ids are dense enough, so that no posting is expanded for it.
        many = rest.where(F.col("n_terms") > 1)
        by_bitmap = bounded and dense(index.join(F.broadcast(many.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi"))
        by_rarest = lookup_rarest(index, many, broadcast_queries=bounded)
        parts.append((by_rarest, candidate_docs_by_bitmap(index, many) if by_bitmap else candidate_docs(by_rarest)))
        lookup = plain if lookup is None else lookup.unionByName(plain)
    # AND over light rows, written out (lineage cut) and counted before its
    # pairs are broadcast to filter the position-carrying rows map-side.
    counted = [(rows, cands.checkpoint(eager=True)) for rows, cands in parts]
    small = sum(cands.count() for _, cands in counted) <= max_broadcast_candidates
    longer = None
    if rest is not None:
        # Matches come from the postings of the rarest words' documents, which lie by document, cut to the rarest word's starts. For the
        # steps few candidates filter the postings where they are read; more meet those of the rarest words' documents.
        many_rows, cands = counted.pop()
        longer = (lookup_aligned(index, many, broadcast_queries=bounded), plain.where(F.col("n_terms") > 1) if small and bounded else many_rows, cands)
        one = rest.where(F.col("n_terms") == 1)
        counted.append((lookup_terms(index, one, broadcast_queries=bounded), cands.limit(0)))

    def union(match) -> DataFrame:
        found = [match(rows, cands, small) for rows, cands in counted]
        if longer is not None:
            aligned, rows, cands = longer
            found.append(match(rows, cands, small) if match is partial_phrase_matches else match(aligned, aligned=True))
        return reduce(DataFrame.unionByName, found)

    return SearchResult(parsed, lookup, union(phrase_match), union(matching_docs), union(partial_phrase_matches))


def search_phrase(spark: SparkSession, index_path: str | list[str], phrase: str, query_id: int = 1) -> SearchResult:
    """Answer one phrase from the folders of its own terms, with literal term filters on the scan.

    Stems and buckets come from the index's term dictionary in one pushed-down
    lookup; words the corpus never contained are stemmed by the same
    expression. The phrase enters as a SQL parameter, so its parsing is folded
    by the optimizer (no job, no Python worker). Every list brought to the
    driver is bounded by the phrase length. Matches take one exchange, by document
    (see ``_phrase_starts``); steps are planned as for a batch.
    """
    q = spark.sql("SELECT CAST(:id AS BIGINT) AS query_id, CAST(:q AS STRING) AS query", args={"id": int(query_id), "q": phrase})
    arrays = (
        q.select(sub_words(F.col("query")).alias("w"))
        .select("w", token_starts("w").alias("o"), F.transform("w", F.length).alias("n"))
        .first()
    )
    words = list(arrays["w"] or [])
    if not words:
        parsed_df = parse_queries(q)
        lookup = lookup_terms(read_index(spark, index_path, buckets=[]), parsed_df)
        return SearchResult(parsed_df, lookup, phrase_match(lookup), matching_docs(lookup), partial_phrase_matches(lookup))
    distinct = sorted(set(words))
    stems: dict[str, tuple[str, int]] = {}
    paths = [index_path] if isinstance(index_path, str) else list(index_path)
    dicts = [vocabulary_path(p) for p in paths if _exists(spark, vocabulary_path(p))]
    if dicts:
        found = spark.read.schema(VOCABULARY_SCHEMA).parquet(*dicts).where(F.col("word").isin(distinct))
        stems.update({r["word"]: (r["stem"], r["bucket"]) for r in found.select("word", "stem", "bucket").collect()})
    missing = [w for w in distinct if w not in stems]
    if missing:
        # Words come out of a generator, so the (large) stem expression runs as
        # a small JVM job instead of being constant-folded by the optimizer.
        local = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in missing])).alias("word"))
        rows = local.select("word", stem_of_word().alias("stem")).select("word", "stem", bucket_of(F.col("stem")).alias("bucket"))
        stems.update({r["word"]: (r["stem"], r["bucket"]) for r in rows.collect()})
    parsed = [
        (int(query_id), k, w, stems[w][0], int(arrays["n"][k]), int(arrays["o"][k]), len(words), stems[w][1])
        for k, w in enumerate(words)
    ]
    parsed_df = _literal_rows(spark, parsed)
    if len(paths) == 1:
        index = read_terms(spark, paths[0], {(r[3], r[7]) for r in parsed})
    else:
        index = read_index(spark, paths, buckets={r[7] for r in parsed}, terms={r[3] for r in parsed})
    lookup = lookup_terms(index, parsed_df, broadcast_queries=True)
    starts = _phrase_starts(index, parsed).withColumn("query_id", F.lit(int(query_id)).cast("bigint"))
    matches = starts.select("query_id", "doc_id", F.explode("starts").alias("start_pos"))
    docs = starts.select("query_id", "doc_id", F.size("starts").cast("bigint").alias("n_matches"))
    return SearchResult(parsed_df, lookup, matches, docs, partial_phrase_matches(lookup))


def _phrase_starts(index: DataFrame, parsed: list[tuple]) -> DataFrame:
    """(doc_id, starts ARRAY<BIGINT>): offsets at which the whole phrase starts, of documents that have any.

    Each posting becomes the starts its word votes for; a document's at most n_terms lists meet in
    one exchange by doc_id, and those of a document with every word are intersected in its row.
    """
    words: dict[str, list[tuple[int, int]]] = {}
    for _, k, _, term, _, offset, _, _ in parsed:
        words.setdefault(term, []).append((k, offset))
    places = None
    for term, uses in words.items():
        own = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(offset).cast("bigint").alias("offset")) for k, offset in uses])
        places = F.when(F.col("term") == term, own) if places is None else places.when(F.col("term") == term, own)
    votes = index.select("doc_id", "positions", F.explode(places).alias("w")).select(
        "doc_id", F.col("w.k").alias("k"), F.transform(F.array_distinct("positions"), lambda p: p.cast("bigint") - F.col("w.offset")).alias("starts")
    )
    if len(parsed) == 1:
        return votes.select("doc_id", "starts")
    lists = votes.groupBy("doc_id").agg(F.collect_list("starts").alias("lists")).where(F.size("lists") == len(parsed))
    common = F.aggregate(F.slice("lists", 2, len(parsed)), F.col("lists")[0], F.array_intersect)
    return lists.select("doc_id", let(common, lambda x: x).alias("starts")).where(F.size("starts") > 0)


PARSED_FIELDS = [
    ("query_id", "bigint"), ("k", "int"), ("word", "string"), ("term", "string"), ("word_len", "int"),
    ("start_offset", "bigint"), ("n_terms", "int"), ("bucket", "int"),
]


def _literal_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small table as literals in the plan (no Python worker needed to read it).

    One SQL statement with bound parameters, so building it is one call.
    """
    width = len(PARSED_FIELDS)
    values = ", ".join(
        "(" + ", ".join(f"CAST(:p{i * width + j} AS {t.upper()})" for j, (_, t) in enumerate(PARSED_FIELDS)) + ")"
        for i in range(len(rows))
    )
    cols = ", ".join(n for n, _ in PARSED_FIELDS)
    args = {f"p{i * width + j}": v for i, row in enumerate(rows) for j, v in enumerate(row)}
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({cols})", args=args)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


__all__ = ["SearchResult", "prepare_batch", "search_batch", "search_phrase", "BUCKETS"]
