"""Sources and sinks: marked-up corpora, stop words, phrase files, the index."""

from phrasedex.sources.corpus import (
    STOP_WORDS,
    conversation_documents,
    parse_marked_documents,
    read_marked_corpus,
    read_queries,
    read_stopwords,
    remove_stopwords,
    stopword_list,
    with_line_numbers,
    wrap_marked,
    write_clean_corpus,
    write_marked_corpus,
)
from phrasedex.sources.index_store import read_index, write_index
from phrasedex.sources.postings_text import postings_from_text, postings_to_text, write_postings_text

__all__ = [
    "STOP_WORDS",
    "conversation_documents",
    "parse_marked_documents",
    "read_marked_corpus",
    "read_queries",
    "read_stopwords",
    "remove_stopwords",
    "stopword_list",
    "with_line_numbers",
    "wrap_marked",
    "write_clean_corpus",
    "write_marked_corpus",
    "read_index",
    "write_index",
    "postings_from_text",
    "postings_to_text",
    "write_postings_text",
]
