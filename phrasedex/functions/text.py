"""Token, offset, normalisation and bucket expressions.

Positions are character offsets: token i of a document starts at
``sum(len(raw_j) + 1 for j < i)``. That equals the start index of token i in the
string made by joining the tokens with single spaces, which lets the offsets be
computed inside the row (no window, no shuffle) in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Whitespace that separates raw tokens (space, tab, newline,
# vertical tab, form feed, carriage return) and the characters a token keeps
# after normalisation (ASCII letters, digits, space).
WHITESPACE = "[ \\t\\n\\x0B\\f\\r]+"
NON_ALNUM = "[^a-zA-Z0-9 ]"
# Normalising ("every other character becomes a space", then split) leaves the
# maximal runs of these characters, which is how words are cut out.
ALNUM_RUN = "[a-zA-Z0-9]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_tokens(text) -> Column:
    """Non-empty whitespace-delimited tokens of ``text``, in order."""
    return F.filter(F.split(_col(text), WHITESPACE), lambda t: t != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark does not share a sub-expression between the inside and the outside of
    a higher-order function; without this a lambda that mentions ``value``
    recomputes it for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def token_starts(tokens) -> Column:
    """Exclusive running sum of ``length(token) + 1`` over an array of tokens.

    The tokens are joined by single spaces; a token starts at 0 or right after a
    space. ``split(s, '')`` yields the code points, so offsets count code points
    like ``length``. Linear in the text length.
    """
    tokens = _col(tokens)

    def starts(chars: Column) -> Column:
        later = F.filter(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.element_at(chars, i) == " ")
        return F.when(F.size(chars) <= 1, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), later))

    return F.when(F.size(tokens) == 0, F.array().cast("array<int>")).otherwise(
        let(F.split(F.array_join(tokens, " "), ""), starts)
    )


def normalize(raw) -> Column:
    """Every character outside ``[a-zA-Z0-9 ]`` becomes a space; then lower case."""
    return F.lower(F.regexp_replace(_col(raw), NON_ALNUM, " "))


def alnum_runs(raw) -> Column:
    """Maximal [a-zA-Z0-9] runs of a string, not yet lower-cased (one regex pass)."""
    return F.regexp_extract_all(_col(raw), F.lit(ALNUM_RUN), 0)


def sub_words(raw) -> Column:
    """Words of a raw token after normalisation; punctuation-only tokens give none.

    Same result as splitting ``normalize(raw)`` on spaces. Lower-casing comes
    after the runs are cut, so a non-ASCII letter never turns into an ASCII one.
    """
    return F.transform(alnum_runs(raw), F.lower)


def bucket_of(term) -> Column:
    """Index bucket of a term: ``c - 'a'`` for a letter, ``c - '0'`` for a digit."""
    term = _col(term)
    first = F.substring(term, 1, 1)
    return F.when(first >= F.lit("a"), F.ascii(term) - 97).otherwise(F.ascii(term) - 48).cast("int")


def block_of(doc_id, docs_per_block: int) -> Column:
    """Number of the span of ``docs_per_block`` ids that holds ``doc_id``."""
    return F.floor(_col(doc_id) / docs_per_block).cast("bigint")


def sub_bucket_of(term, count: int) -> Column:
    """Sub-bucket of a term, from 0 to ``count`` - 1, by its hash: even in size, whatever the first letters."""
    return F.pmod(F.hash(_col(term)), F.lit(count))
