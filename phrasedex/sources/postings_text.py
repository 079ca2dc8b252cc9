"""Text exchange of postings, in two line styles.

``tab``:  ``term`` + space + TAB + ``doc:p:p,doc:p``
``pipe``: ``term`` + space + ``doc|p:p,doc|p``

A line covers one term and one block of consecutive doc ids (or of as many documents, by
rank), so a frequent term spans several lines instead of one unbounded line. Documents are in doc_id
order, positions ascending. The reader accepts both styles and either
separator after the doc id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasedex.functions.text import bucket_of
from phrasedex.operators.postings import DOCS_PER_BLOCK, group_blocks

DOCS_PER_LINE = DOCS_PER_BLOCK

# The two line formats, as (separator after the doc id,
# separator after the term). Documents are joined by ',' and positions by ':'.
STYLES = {"tab": (":", " \t"), "pipe": ("|", " ")}


def postings_to_text(postings: DataFrame, style: str = "pipe", docs_per_line: int = DOCS_PER_LINE, by_rank: bool = False) -> DataFrame:
    """(bucket, term, block, line) from (term, doc_id, positions); ``by_rank``: see ``group_blocks``."""
    if style not in STYLES:
        raise ValueError("style must be 'tab' or 'pipe'")
    id_sep, head_sep = STYLES[style]
    entry = F.concat(F.col("doc_id").cast("string"), F.lit(id_sep), F.array_join(F.col("positions"), ":"))
    grouped = group_blocks(postings, F.struct("doc_id", entry.alias("e")), docs_per_line, by_rank)
    line = F.concat(F.col("term"), F.lit(head_sep), F.array_join(F.transform("entries", lambda x: x["e"]), ","))
    return grouped.select(bucket_of(F.col("term")).alias("bucket"), "term", "block", line.alias("line"))


def write_postings_text(lines: DataFrame, path: str) -> None:
    """One text folder per bucket, like the 26 part files of the original layout."""
    lines.select("bucket", F.col("line").alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)


def postings_from_text(lines: DataFrame, col: str = "line") -> DataFrame:
    """(term, doc_id, positions ARRAY<BIGINT>) from text lines; malformed entries are dropped."""
    body = F.trim(F.col(col))
    parts = lines.select(
        F.regexp_extract(body, "^([^ \\t]+)", 1).alias("term"),
        F.trim(F.regexp_replace(body, "^[^ \\t]+[ \\t]*", "")).alias("rest"),
    ).where((F.col("term") != "") & (F.col("rest") != ""))
    entries = parts.select("term", F.explode(F.split("rest", ",")).alias("e"))
    fields = entries.select("term", F.split(F.col("e"), "[:|]").alias("f")).where(F.size("f") >= 2)
    return fields.select(
        "term",
        F.col("f")[0].try_cast("bigint").alias("doc_id"),
        F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.try_cast("bigint")).alias("positions"),
    ).where(F.col("doc_id").isNotNull() & F.forall("positions", lambda x: x.isNotNull()))
