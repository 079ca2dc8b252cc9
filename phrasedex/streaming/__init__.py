"""Phrase files arriving in a folder, answered by Structured Streaming."""

from phrasedex.streaming.phrase_stream import start_phrase_stream

__all__ = ["start_phrase_stream"]
