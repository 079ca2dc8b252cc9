"""

Every query reads the given parquet tables of ``sf_dir`` in full. The corpus is
``documents`` (doc_id, text); the phrase batch is every clause of every
``benchmark`` text (see ``phrasedex.operators.queries.benchmark_phrases``).
Arrays are emitted as ':'-joined strings so results compare as flat rows.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from oracle_sql import ORACLE_SQL  # noqa: E402
from phrasedex.operators import (  # noqa: E402
    benchmark_phrases,
    build_inverted_index,
    build_next_words,
    candidate_docs,
    candidate_docs_by_bitmap,
    document_terms,
    document_texts,
    frequent_lengths,
    lookup_aligned,
    lookup_rarest,
    lookup_terms,
    matching_docs,
    merge_postings,
    parse_queries,
    partial_phrase_matches,
    phrase_match,
    phrase_match_with_pairs,
    query_buckets,
    single_term_docs,
    stem_vocabulary,
    tokenize,
    with_bucket,
    with_stems,
    with_words,
    word_counts,
)
from phrasedex.operators.postings import DOCS_PER_BLOCK  # noqa: E402
from phrasedex.operators.queries import CLAUSE_ID_SPAN  # noqa: E402
from phrasedex.plans.build import attach_stems, build_index, corpus_postings  # noqa: E402
from phrasedex.plans.grow import add_documents, compact, delete_documents  # noqa: E402
from phrasedex.plans.search import MAX_BROADCAST_QUERY_WORDS, search_batch, search_phrase  # noqa: E402
from phrasedex.session import shared_dir  # noqa: E402
from phrasedex.sources import (  # noqa: E402
    conversation_documents,
    parse_marked_documents,
    postings_from_text,
    postings_to_text,
    read_index,
    read_marked_corpus,
    read_queries,
    read_stopwords,
    remove_stopwords,
    write_clean_corpus,
    write_index,
    write_marked_corpus,
)

SMOKE_DIR = "/root/testdata/sf0.001"
# A term with 1/FREQUENT_TERMS of all occurrences has next-word postings.
FREQUENT_TERMS = 1000
# Documents of a term in a block by rank.
RANKED_BLOCK = 64
# Buckets by document of a growing index's tables.
DOC_BUCKETS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_phrases(_table(spark, sf_dir, "benchmark"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_postings(_docs(spark, sf_dir), by="document")


def _block_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that lie by block of ids, as the nested index and the text lines take them."""
    return corpus_postings(_docs(spark, sf_dir), by="document", docs_per_block=DOCS_PER_BLOCK)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bucket(_postings(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Parsed phrase batch and whether its counted size allows a broadcast."""
    parsed = parse_queries(_phrases(spark, sf_dir))
    return parsed, parsed.count() <= MAX_BROADCAST_QUERY_WORDS


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, small = _parsed(spark, sf_dir)
    # Positions become text once a posting, not once a row.
    return lookup_terms(_flat(_index(spark, sf_dir)), parsed, broadcast_queries=small)


def _stored_batch(index: DataFrame, parsed: DataFrame, small: bool) -> DataFrame:
    """The postings of the batch's terms, stored: matching reads them several times, texts are cut once."""
    spark = index.sparkSession
    terms = parsed.select("bucket", "term").distinct()
    path = shared_dir(spark, "batch-postings")
    hit = index.join(F.broadcast(terms) if small else terms, ["bucket", "term"], "left_semi")
    hit.select("bucket", "term", "doc_id", "positions").write.parquet(path)
    return spark.read.parquet(path)


def _matched(index: DataFrame, parsed: DataFrame, small: bool, match) -> DataFrame:
    """``match`` of one-word phrases on their postings, and of longer ones in the documents of their rarest word."""
    index = _stored_batch(index, parsed, small)
    one, many = parsed.where("n_terms = 1"), parsed.where("n_terms > 1")
    if match in (phrase_match, matching_docs):
        longer = match(lookup_aligned(index, many, broadcast_queries=small), aligned=True)
    else:
        longer = match(lookup_rarest(index, many, broadcast_queries=small))
    return match(lookup_terms(index, one, broadcast_queries=small)).unionByName(longer)


def _phrases_matched(spark: SparkSession, sf_dir: str, match) -> DataFrame:
    parsed, small = _parsed(spark, sf_dir)
    return _matched(_index(spark, sf_dir), parsed, small, match)


def _flat(df: DataFrame, col: str = "positions") -> DataFrame:
    return df.withColumn(col, F.array_join(F.col(col), ":"))


# --- corpus ingestion -------------------------------------------------------

def q_marked_documents(spark, sf_dir):
    path = shared_dir(spark, "marked-corpus")
    write_marked_corpus(_table(spark, sf_dir, "documents"), path)
    return parse_marked_documents(read_marked_corpus(spark, path))


def q_clean_documents(spark, sf_dir):
    return remove_stopwords(_docs(spark, sf_dir))


def q_token_positions(spark, sf_dir):
    return tokenize(_docs(spark, sf_dir))


def q_terms(spark, sf_dir):
    return with_words(_docs(spark, sf_dir))


def q_stem_vocabulary(spark, sf_dir):
    return stem_vocabulary(with_words(_docs(spark, sf_dir)))


def q_stemmed_terms(spark, sf_dir):
    terms, _, _ = attach_stems(spark, with_words(_docs(spark, sf_dir)))
    return terms.select("doc_id", "pos", "term")


def q_clean_postings(spark, sf_dir):
    # Stop words removed before offsets: positions count kept words only.
    from phrasedex.sources.corpus import STOP_WORDS

    return _flat(corpus_postings(_docs(spark, sf_dir), stopwords=STOP_WORDS, by="document"))


# --- index ---------------------------------------------------------------------

def q_postings(spark, sf_dir):
    return _flat(_postings(spark, sf_dir))


def q_postings_bounded_vocabulary(spark, sf_dir):
    # The plan for vocabularies too large to broadcast: only the 1,000 most
    # frequent words are broadcast, every other word is stemmed in place.
    return _flat(corpus_postings(_docs(spark, sf_dir), frequent_words=1000, by="word"))


def q_inverted_index(spark, sf_dir):
    return _nested_text(build_inverted_index(_block_postings(spark, sf_dir)))


def q_inverted_index_ranked(spark, sf_dir):
    # Blocks of as many documents of the term, however their ids lie.
    return _nested_text(build_inverted_index(_postings(spark, sf_dir), RANKED_BLOCK, by_rank=True))


def _nested_text(inv: DataFrame) -> DataFrame:
    text = F.array_join(
        F.transform("postings", lambda x: F.concat(x["doc_id"].cast("string"), F.lit("|"), F.array_join(x["positions"], ":"))),
        ",",
    )
    return inv.select("term", "block", text.alias("postings"))


def q_index_bucket_scan(spark, sf_dir):
    path = shared_dir(spark, "index")
    write_index(_postings(spark, sf_dir), path)
    parsed, small = _parsed(spark, sf_dir)
    # Bucket set of the batch: at most 26 values.
    buckets = [r[0] for r in parsed.select("bucket").distinct().collect()]
    index = read_index(spark, path, buckets=buckets)
    terms = parsed.select("term").distinct()
    hit = index.join(F.broadcast(terms) if small else terms, "term", "left_semi")
    return _flat(hit.select("bucket", "term", "doc_id", "positions"))


def q_index_sub_bucket_scan(spark, sf_dir):
    # Built with many sub-buckets; the batch's own terms prune the folders at run time, whatever their number.
    path = _built(spark, sf_dir, sub_buckets=8)
    parsed, small = _parsed(spark, sf_dir)
    terms = parsed.select("bucket", "term").distinct()
    index = read_index(spark, path, wanted=terms)
    hit = index.join(F.broadcast(terms) if small else terms, ["bucket", "term"], "left_semi")
    return _flat(hit.select("bucket", "term", "doc_id", "positions"))


def q_merge_postings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    parts = []
    for cond in (F.col("lang") == "en", F.col("lang") != "en", F.col("lang").isNull()):
        part = docs.where(cond).select("doc_id", F.col("text").alias("body"))
        parts.append(corpus_postings(part, by="document"))
    return _flat(merge_postings(*parts))


def q_postings_text(spark, sf_dir):
    return postings_to_text(_block_postings(spark, sf_dir), style="pipe")


def q_postings_text_tab(spark, sf_dir):
    return postings_to_text(_block_postings(spark, sf_dir), style="tab")


def q_postings_text_ranked(spark, sf_dir):
    return postings_to_text(_postings(spark, sf_dir), style="pipe", docs_per_line=RANKED_BLOCK, by_rank=True)


def q_postings_text_roundtrip(spark, sf_dir):
    lines = postings_to_text(_block_postings(spark, sf_dir), style="tab")
    back = postings_from_text(lines)
    # A term spanning several lines (blocks) is merged back into one posting.
    return _flat(merge_postings(back))


# --- queries and search --------------------------------------------------------------

def q_parsed_queries(spark, sf_dir):
    return parse_queries(_phrases(spark, sf_dir))


def q_query_buckets(spark, sf_dir):
    return query_buckets(parse_queries(_phrases(spark, sf_dir)))


def q_term_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir)


def q_single_term_docs(spark, sf_dir):
    parsed, small = _parsed(spark, sf_dir)
    return single_term_docs(_flat(_index(spark, sf_dir)), parsed, broadcast_queries=small)


def q_candidate_docs(spark, sf_dir):
    return _phrases_matched(spark, sf_dir, candidate_docs)


def q_candidate_docs_bitmap(spark, sf_dir):
    # The AND on document bitmaps instead of posting rows.
    path = shared_dir(spark, "index")
    write_index(_postings(spark, sf_dir), path)
    parsed, small = _parsed(spark, sf_dir)
    return candidate_docs_by_bitmap(read_index(spark, path), parsed) if small else _phrases_matched(spark, sf_dir, candidate_docs)


def q_phrase_match(spark, sf_dir):
    return _phrases_matched(spark, sf_dir, phrase_match)


def q_phrase_match_next_words(spark, sf_dir):
    # Phrases of frequent words from postings of word pairs, the others from those of their words.
    docs = _docs(spark, sf_dir)
    path = shared_dir(spark, "vocabulary")
    with_stems(word_counts(docs)).write.parquet(path)
    # At most FREQUENT_TERMS terms, by counting.
    frequent = frequent_lengths(spark.read.parquet(path), FREQUENT_TERMS).checkpoint()
    parsed, small = _parsed(spark, sf_dir)
    parsed = parsed.checkpoint()
    index = _stored_batch(_index(spark, sf_dir), parsed, small)
    return phrase_match_with_pairs(index, build_next_words(document_texts(docs), frequent), parsed, frequent)


def q_phrase_docs(spark, sf_dir):
    return _phrases_matched(spark, sf_dir, matching_docs)


def q_partial_phrase_matches(spark, sf_dir):
    return _phrases_matched(spark, sf_dir, partial_phrase_matches)


def q_conversation_phrase_docs(spark, sf_dir):
    # Second corpus: every conversation turn is a document; its id is the struct (conv_id, turn).
    turns = conversation_documents(_table(spark, sf_dir, "conversations"))
    index = with_bucket(corpus_postings(turns, by="document"))
    parsed, small = _parsed(spark, sf_dir)
    hits = _matched(index, parsed, small, matching_docs)
    return hits.select("query_id", "doc_id.conv_id", "doc_id.turn", "n_matches")


# --- the stored engine: index build, batch search, single phrases ---------------------


def _built(spark: SparkSession, sf_dir: str, **options) -> str:
    path = shared_dir(spark, "built-index")
    build_index(spark, _docs(spark, sf_dir), path, **options)
    return path


def q_batch_phrase_matches(spark, sf_dir):
    # Every phrase goes through its rarest word.
    return search_batch(spark, _built(spark, sf_dir), _phrases(spark, sf_dir)).matches


def q_batch_phrase_docs(spark, sf_dir):
    # Mixed: phrases whose rarest word is in more than 20 documents take the plain lookup.
    return search_batch(spark, _built(spark, sf_dir), _phrases(spark, sf_dir), max_anchor_docs=20).docs


def q_batch_phrase_steps(spark, sf_dir):
    # Nothing may be broadcast: the plain lookup and shuffle joins throughout.
    res = search_batch(
        spark, _built(spark, sf_dir), _phrases(spark, sf_dir), max_broadcast_words=0, max_broadcast_candidates=0, max_needed=0
    )
    return res.steps


def q_search_two_roots(spark, sf_dir):
    # Two partial indexes that both hold part of every third document: a gets the tokens with an
    # even number, b the others, so a phrase in such a document needs the postings of both.
    terms = document_terms(_docs(spark, sf_dir), numbers=True)
    third = F.pmod(F.col("doc_id"), F.lit(3))
    # Cut, stemmed, grouped and parted once: a range exchange reads its rows twice.
    stored = shared_dir(spark, "numbered-terms")
    parts = []
    for whole, odd in ((1, 0), (2, 1)):
        own = F.expr(f"filter(positions, (p, i) -> tokens[i] % 2 = {odd})")
        parts.append(F.when(third == whole, F.col("positions")).when(third == 0, own).alias(f"root_{whole}"))
    terms.select("term", "doc_id", *parts).write.parquet(stored)
    terms = spark.read.parquet(stored)
    roots = []
    for part in ("root_1", "root_2"):
        roots.append(shared_dir(spark, "index-root"))
        write_index(terms.where(F.size(part) > 0).select("term", "doc_id", F.col(part).alias("positions")), roots[-1])
    return search_batch(spark, roots, _phrases(spark, sf_dir)).docs


def _grown(spark: SparkSession, sf_dir: str) -> str:
    # Every document, some with an old text that is replaced, some deleted and added again: in the end the whole corpus.
    docs = _docs(spark, sf_dir)
    old, back = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
    root = shared_dir(spark, "segments")
    first = docs.withColumn("body", F.when(old, F.reverse("body")).otherwise(F.col("body")))
    add_documents(spark, root, first, doc_buckets=DOC_BUCKETS)
    add_documents(spark, root, docs.where(old))
    delete_documents(spark, root, docs.where(back))
    add_documents(spark, root, docs.where(back))
    return root


def q_segment_phrase_docs(spark, sf_dir):
    # Searched in three segments whose dead documents are still stored.
    return search_batch(spark, _grown(spark, sf_dir), _phrases(spark, sf_dir)).docs


def q_segment_postings(spark, sf_dir):
    # After compaction of the two newer segments, then of all.
    root = _grown(spark, sf_dir)
    compact(spark, root)
    compact(spark, root, ratio=None)
    return _flat(read_index(spark, root).select("term", "doc_id", "positions"))


def q_single_phrase_docs(spark, sf_dir):
    # One search per clause of the item with the most clauses: each is a user's request of its own.
    path = _built(spark, sf_dir)
    phrases = _phrases(spark, sf_dir)
    item = F.floor(F.col("query_id") / CLAUSE_ID_SPAN)
    most = phrases.groupBy(item.alias("item")).count().orderBy(F.desc("count"), "item").first()
    if most is None:
        return search_phrase(spark, path, "").docs  # no item: no rows
    found = None
    for r in phrases.where(item == most["item"]).collect():
        docs = search_phrase(spark, path, r["query"], r["query_id"]).docs
        found = docs if found is None else found.unionByName(docs)
    return found


# --- file sources -------------------------------------------------------------------------


def q_phrase_file(spark, sf_dir):
    # Files whose names sort as the phrases do, with blank lines between; read and numbered together.
    path = shared_dir(spark, "phrase-files")
    rows = _phrases(spark, sf_dir).repartitionByRange(4, "query_id").sortWithinPartitions("query_id")
    rows.select(F.concat(F.col("query"), F.lit("\n \n")).alias("line")).write.text(path)
    return read_queries(spark, path)


def q_stopword_file(spark, sf_dir):
    from phrasedex.sources.corpus import STOP_WORDS

    path = shared_dir(spark, "stop-words")
    spark.sql("SELECT explode(:words) AS word", args={"words": [*STOP_WORDS, ""]}).write.text(path)
    return remove_stopwords(_docs(spark, sf_dir), read_stopwords(spark, path))


def q_clean_corpus_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "clean-corpus")
    write_clean_corpus(remove_stopwords(_docs(spark, sf_dir)), path)
    return parse_marked_documents(read_marked_corpus(spark, path))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "marked_documents": q_marked_documents,
    "clean_documents": q_clean_documents,
    "token_positions": q_token_positions,
    "terms": q_terms,
    "stem_vocabulary": q_stem_vocabulary,
    "stemmed_terms": q_stemmed_terms,
    "clean_postings": q_clean_postings,
    "postings": q_postings,
    "postings_bounded_vocabulary": q_postings_bounded_vocabulary,
    "inverted_index": q_inverted_index,
    "inverted_index_ranked": q_inverted_index_ranked,
    "index_bucket_scan": q_index_bucket_scan,
    "index_sub_bucket_scan": q_index_sub_bucket_scan,
    "merge_postings": q_merge_postings,
    "postings_text": q_postings_text,
    "postings_text_tab": q_postings_text_tab,
    "postings_text_ranked": q_postings_text_ranked,
    "postings_text_roundtrip": q_postings_text_roundtrip,
    "parsed_queries": q_parsed_queries,
    "query_buckets": q_query_buckets,
    "term_lookup": q_term_lookup,
    "single_term_docs": q_single_term_docs,
    "candidate_docs": q_candidate_docs,
    "candidate_docs_bitmap": q_candidate_docs_bitmap,
    "phrase_match": q_phrase_match,
    "phrase_match_next_words": q_phrase_match_next_words,
    "phrase_docs": q_phrase_docs,
    "partial_phrase_matches": q_partial_phrase_matches,
    "conversation_phrase_docs": q_conversation_phrase_docs,
    "batch_phrase_matches": q_batch_phrase_matches,
    "batch_phrase_docs": q_batch_phrase_docs,
    "batch_phrase_steps": q_batch_phrase_steps,
    "search_two_roots": q_search_two_roots,
    "segment_phrase_docs": q_segment_phrase_docs,
    "segment_postings": q_segment_postings,
    "single_phrase_docs": q_single_phrase_docs,
    "phrase_file": q_phrase_file,
    "stopword_file": q_stopword_file,
    "clean_corpus_roundtrip": q_clean_corpus_roundtrip,
}


# The training-data subpackage may be absent; its queries are added only when it imports.
try:
    from corpus_pipeline import ORACLE_SQL as _PIPELINE_SQL
    from corpus_pipeline import run as _pipeline
    from phrasedex.llm.queries import ORACLE_SQL as _LLM_SQL
    from phrasedex.llm.queries import QUERIES as _LLM_QUERIES
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "phrasedex.llm"):
        raise
    _LLM_QUERIES, _LLM_SQL = {}, {}
else:
    _LLM_QUERIES = {**_LLM_QUERIES, "pipeline": _pipeline}
    _LLM_SQL = {**_LLM_SQL, **({"pipeline": _PIPELINE_SQL} if _PIPELINE_SQL else {})}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: documents containing each benchmark phrase, on sf0.001."""
    return q_phrase_docs(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{k: v for k, v in ORACLE_SQL.items() if k in _QUERIES}, **_LLM_SQL}
