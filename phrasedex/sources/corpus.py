"""Corpus, stop-word and phrase-file sources; the cleaned-corpus sink.

A marked-up corpus holds documents as::

    <doc id="12" url="..." title="..." ...>
    body text ...
    </doc>

It is read with ``</doc>`` as the record separator, so each record is one whole
document no matter how files are split into tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasedex.functions.text import WHITESPACE, let

# The stop-word list (114 lower-case words), in its given order.
STOP_WORDS = (
    "a about after align all also amp an and are as at b be been between bgcolor both br but by c "
    "category center cite com d do e f flagicon for from g gt h has have he her his html http i id if "
    "image img in is isbn it its j jpg k l like lt m more most n nbsp new no not o of on one or org p "
    "q quot r rd ref rowspan s said say she so t td th that the their they this to u url us v w was we "
    "were what when which who will with would www x y you z"
).split()

# The document markup. A record ends at DOC_END; its id is the
# first id="N"; the header runs up to the token holding id="N", then up to the
# first later token that ends with '>', plus the one whitespace character after it.
DOC_END = "</doc>"
ID_PATTERN = 'id="([0-9]+)"'
HEADER_PATTERN = '(?s)^.*?id="[0-9]+"[^ \\t\\n\\x0B\\f\\r]*[ \\t\\n\\x0B\\f\\r].*?>([ \\t\\n\\x0B\\f\\r]|\\z)'

# A stop-word table of at most this many rows becomes literals; a larger one is joined.
MAX_LITERAL_STOP_WORDS = 10_000


def wrap_marked(docs: DataFrame) -> DataFrame:
    """(doc_id, segment): render table rows as marked-up documents (used for fixtures)."""
    head = F.concat(
        F.lit('<doc id="'), F.col("doc_id").cast("string"),
        F.lit('" url="http://x?curid='), F.col("doc_id").cast("string"),
        F.lit('" title="'), F.coalesce(F.col("lang"), F.lit("")), F.lit(" "), F.coalesce(F.col("source"), F.lit("")),
        F.lit('" nonfiltered="1" dbindex="0">'),
    )
    return docs.select("doc_id", F.concat(head, F.lit("\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("\n" + DOC_END)).alias("segment"))


def write_marked_corpus(docs: DataFrame, path: str) -> None:
    """Write marked-up documents as text files (one per task)."""
    wrap_marked(docs).select("segment").write.mode("overwrite").text(path)


def read_marked_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(segment): one record per document; ``path`` may be a directory, glob or list."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("lineSep", DOC_END).text(paths).select(F.col("value").alias("segment"))


def parse_marked_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, body): id from the first ``id="N"``; body after the header.

    A record without an id, or whose header never closes, yields no document.
    """
    seg = F.col("segment")
    return segments.where(seg.rlike(HEADER_PATTERN)).select(
        F.regexp_extract(seg, ID_PATTERN, 1).cast("bigint").alias("doc_id"),
        F.regexp_replace(seg, HEADER_PATTERN, "").alias("body"),
    )


def conversation_documents(conversations: DataFrame) -> DataFrame:
    """(doc_id, body) from (conv_id, turn, role, text): a turn is one document, its id the struct (conv_id, turn)."""
    doc_id = F.struct(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"))
    return conversations.select(doc_id.alias("doc_id"), F.col("text").alias("body"))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word): one stop word per line, newline stripped, blank lines ignored."""
    return spark.read.text(path).select(F.col("value").alias("word")).where(F.col("word") != "")


def stopword_list(words: DataFrame | Iterable[str] | None) -> list[str]:
    """Stop words as a literal list; for tables of a checked size and lists."""
    if words is None:
        return list(STOP_WORDS)
    if isinstance(words, DataFrame):
        return [r[0] for r in words.select("word").distinct().collect()]
    return list(words)


def _clean_line(line: Column, stops: list[str]) -> Column:
    kept = F.filter(F.split(line, WHITESPACE), lambda t: (t != "") & (t.endswith(">") | ~F.lower(t).isin(*stops)))
    return let(kept, lambda k: F.concat(F.array_join(k, " "), F.when(F.size(k) > 0, F.lit(" ")).otherwise(F.lit(""))))


def remove_stopwords(docs: DataFrame, stopwords: DataFrame | Iterable[str] | None = None, body: str = "body") -> DataFrame:
    """(doc_id, body): stop words removed line by line; empty lines dropped.

    Each kept word is followed by one space and every non-empty input line by a
    newline. Matching is on the lower-cased raw token, so ``the,`` stays;
    tokens ending in ``>`` stay. Works within the row, without a shuffle, unless
    the stop words are a table of more than MAX_LITERAL_STOP_WORDS rows.
    """
    if isinstance(stopwords, DataFrame) and stopwords.count() > MAX_LITERAL_STOP_WORDS:
        return _remove_by_join(docs, stopwords, body)
    stops = stopword_list(stopwords)
    lines = F.filter(F.split(F.col(body), "\n"), lambda ln: ln != "")
    cleaned = F.transform(lines, lambda ln: F.concat(_clean_line(ln, stops), F.lit("\n")))
    return docs.select("doc_id", F.array_join(cleaned, "").alias("body"))


def _remove_by_join(docs: DataFrame, stopwords: DataFrame, body: str) -> DataFrame:
    """``remove_stopwords`` against a table of any size: tokens are anti-joined and put back in their lines.

    Rows are told apart by a key of their own, so repeated ids stay apart.
    """
    rows = docs.select("doc_id", F.col(body).alias("body"))
    keyed = rows.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("_same")).withColumn("_key", F.xxhash64("doc_id", "body"))
    lines = keyed.select("_key", "doc_id", "body", F.posexplode(F.filter(F.split("body", "\n"), lambda ln: ln != "")).alias("_ln", "line"))
    tokens = lines.select(
        "_key", "doc_id", "_ln", F.posexplode(F.filter(F.split("line", WHITESPACE), lambda t: t != "")).alias("_at", "raw")
    )
    stops = stopwords.select(F.col("word").alias("_stop")).distinct()
    kept = tokens.join(stops, (F.lower("raw") == F.col("_stop")) & ~F.col("raw").endswith(">"), "left_anti")
    words = kept.groupBy("_key", "doc_id", "_ln").agg(F.array_sort(F.collect_list(F.struct("_at", "raw"))).alias("_w"))
    text = words.select("_key", "doc_id", "_ln", F.concat(F.array_join(F.transform("_w", lambda x: x["raw"]), " "), F.lit(" ")).alias("_t"))
    every = lines.select("_key", "doc_id", "_ln").join(text, ["_key", "doc_id", "_ln"], "left")
    every = every.groupBy("_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("_ln", F.coalesce("_t", F.lit("")).alias("t")))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: F.concat(x["t"], F.lit("\n"))), "")
    out = keyed.join(every.select("_key", joined.alias("_b")), "_key", "left")
    whole = F.when(F.col("body").isNotNull(), F.coalesce("_b", F.lit("")))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_same").cast("int")))
    return out.select("doc_id", whole.alias("body"), copies.alias("_c")).drop("_c")


def write_clean_corpus(docs: DataFrame, path: str) -> None:
    """Write the cleaned corpus as marked-up text, one record per document.

    The header is ``<doc id="N" >``: the id token must not itself end with
    '>', or the reader would skip on to the next such token.
    """
    seg = F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('" >\n'), F.col("body"), F.lit(DOC_END))
    docs.select(seg.alias("value")).write.mode("overwrite").text(path)


def with_line_numbers(lines: DataFrame, start: int = 1, piece: Column | None = None) -> DataFrame:
    """Add ``line_no``, consecutive from ``start``, without a global sort.

    Rows of a ``piece`` are read in order by one task and get increasing ids;
    the pieces (one row each) are numbered in their order and joined back. The
    default piece is the partition; a file scan passes path and offset
    (``file_piece``), so files are numbered in path order, however Spark packs
    them into tasks.
    """
    tagged = lines.withColumn("_piece", F.spark_partition_id() if piece is None else piece).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (
        tagged.join(offsets, "_piece")
        .withColumn("line_no", (F.col("_before") + F.col("_mid") - F.col("_first") + start).cast("bigint"))
        .drop("_mid", "_piece", "_before", "_first")
    )


def file_piece() -> Column:
    """Path and offset of the piece of a file that a row of a file scan comes from."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): one phrase per line, numbered from 1 over files in path order; blank lines skipped unnumbered."""
    lines = spark.read.text(path).where(F.trim(F.col("value")) != "")
    return with_line_numbers(lines, piece=file_piece()).select(F.col("line_no").alias("query_id"), F.col("value").alias("query"))
