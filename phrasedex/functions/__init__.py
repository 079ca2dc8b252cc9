"""Column expressions. Every function returns a ``Column`` evaluated JVM-side."""

from phrasedex.functions.text import (
    ALNUM_RUN,
    WHITESPACE,
    alnum_runs,
    bucket_of,
    let,
    normalize,
    raw_tokens,
    sub_words,
    token_starts,
)
from phrasedex.functions.porter import letter_runs, porter_stem, stem_word

__all__ = [
    "ALNUM_RUN",
    "WHITESPACE",
    "alnum_runs",
    "bucket_of",
    "let",
    "normalize",
    "raw_tokens",
    "sub_words",
    "token_starts",
    "letter_runs",
    "porter_stem",
    "stem_word",
]
