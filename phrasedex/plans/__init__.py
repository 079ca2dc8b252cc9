"""End-to-end jobs and plan checks."""

from phrasedex.plans.build import build_index, corpus_postings
from phrasedex.plans.grow import add_documents, compact, delete_documents, vacuum
from phrasedex.plans.search import SearchResult, search_batch, search_phrase

__all__ = ["add_documents", "build_index", "compact", "corpus_postings", "delete_documents", "vacuum", "SearchResult", "search_batch", "search_phrase"]
