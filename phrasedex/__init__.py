"""Positional phrase search over document tables, written as Spark DataFrame plans.

Layout:
    functions/  column expressions (tokens, offsets, normalisation, buckets, stemmer)
    sources/    corpus, stop-word and query readers; index and text-exchange sinks
    operators/  DataFrame -> DataFrame steps (tokens, stems, postings, search)
    plans/      end-to-end jobs: build an index, answer a phrase batch, plan checks
    streaming/  phrase batches arriving as files, answered by Structured Streaming
"""

from phrasedex.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
