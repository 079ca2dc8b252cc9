"""DataFrame -> DataFrame operators. None of them collects data to the driver."""

from phrasedex.operators.tokens import by_document, document_terms, document_texts, document_words, explode_terms, tokenize, with_words, word_counts
from phrasedex.operators.stemming import (
    apply_frequent_stems,
    apply_stems,
    frequent_vocabulary,
    frequent_words,
    stem_vocabulary,
    with_stems,
)
from phrasedex.operators.bitmaps import candidate_docs_by_bitmap, phrase_blocks, term_bitmaps
from phrasedex.operators.next_words import build_next_words, frequent_lengths, phrase_match_with_pairs
from phrasedex.operators.postings import (
    build_inverted_index,
    build_postings,
    merge_postings,
    with_bucket,
)
from phrasedex.operators.queries import benchmark_phrases, parse_queries, query_buckets, query_words
from phrasedex.operators.search import (
    candidate_docs,
    deal_postings,
    lookup_aligned,
    lookup_rarest,
    lookup_terms,
    matching_docs,
    phrase_docs,
    phrase_match,
    partial_phrase_matches,
    single_term_docs,
)

__all__ = [
    "tokenize",
    "explode_terms",
    "with_words",
    "document_words",
    "document_terms",
    "document_texts",
    "word_counts",
    "by_document",
    "stem_vocabulary",
    "with_stems",
    "apply_stems",
    "apply_frequent_stems",
    "frequent_vocabulary",
    "frequent_words",
    "build_postings",
    "build_inverted_index",
    "merge_postings",
    "with_bucket",
    "benchmark_phrases",
    "parse_queries",
    "query_buckets",
    "query_words",
    "lookup_terms",
    "deal_postings",
    "lookup_aligned",
    "lookup_rarest",
    "candidate_docs",
    "candidate_docs_by_bitmap",
    "phrase_blocks",
    "term_bitmaps",
    "build_next_words",
    "frequent_lengths",
    "phrase_match_with_pairs",
    "phrase_match",
    "phrase_docs",
    "matching_docs",
    "partial_phrase_matches",
    "single_term_docs",
]
