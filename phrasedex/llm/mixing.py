"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every source has a target in words (weights, capped, the excess reshared). A
document's expected number of copies is its source's rate, target / size. The
documents of a source are put in one order, their expected copies are prefix
sums, one offset per source (a hash of its name) is added, and a document is
emitted once for every integer boundary its interval crosses.

The order is by cells (size class, salt) and inside a cell by size and id. A
size class spans at most an eighth of its size, so consecutive documents have
about equal sizes and the words taken come near the target. Ranks are counted
per cell and offset by the counts of the cells before, so no task sorts a whole
source: a source that holds a third of all rows, or rows that are all alike,
are spread over ``SALTS`` cells per size class.

Defined cases: null or blank text has size 0 and takes 0 words (it may still
get copies in ``copies``); a null source is a source of its own, last in code
point order; a source whose sizes sum to 0 has target 0 and no copies; rows
that repeat an id count as separate documents; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasedex.session import shared_dir

from .common import ROW_KEY, WORD_PATTERN, table, with_row_key

WEIGHTS = (1, 2, 3)
CAP = 3
SALTS = 64


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, ``extra``, cls, salt) of every document; text is read once."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *extra)
    # Size class: the number of binary digits and the leading three of them.
    shift = F.greatest(F.length(F.bin("size")) - 3, F.lit(0))
    cls = shift * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")
    salt = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % SALTS
    return out.withColumns({"cls": cls.cast("long"), "salt": F.coalesce(salt, F.lit(0))})


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): shares by weight of all words, filled up from the tightest cap.

    One row per source: the windows below run over sources, not documents.
    """
    s = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    pos = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((pos - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("pos", pos)
    order = Window.orderBy((cap * F.col("source_size") / F.col("weight").cast("double")), "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    left = (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
    weight_left = (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    s = s.withColumns({"left": left, "weight_left": weight_left})
    full = cap * F.col("source_size").cast("double") * F.col("weight_left") <= F.col("left") * F.col("weight")
    # The sources that reach their cap come first in this order; the first that does not fixes the level.
    s = s.withColumn("full", full)
    level = F.first(F.when(~F.col("full"), F.struct("left", "weight_left")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("full"), cap * F.col("source_size").cast("double")).otherwise(
        F.col("weight") * F.col("level.left") / F.col("level.weight_left")
    )
    return s.withColumn("level", level).select("source", "source_size", target.alias("target"))


def _copies(rows: DataFrame, weights: tuple[int, ...], cap: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows of ``sized`` with source_size, target and copies; ``ties`` order rows of equal size and id."""
    cells = rows.groupBy("source", "cls", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells, weights, cap)
    prior = F.coalesce(
        F.sum("n").over(Window.partitionBy("source").orderBy("cls", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offset = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cells = cells.select("source", "cls", "salt", prior.alias("prior"), offset.alias("offset"))
    cells = cells.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("c_source"), F.col("cls").alias("c_cls"), F.col("salt").alias("c_salt"), "prior", "offset", "source_size", "target", rate.alias("rate")
    )
    rank = F.row_number().over(Window.partitionBy("source", "cls", "salt").orderBy("size", "doc_id", *ties))
    ranked = rows.withColumn("rank", rank)
    joined = ranked.join(
        cells,
        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cls") == F.col("c_cls")) & (F.col("salt") == F.col("c_salt")),
    )
    end = (F.col("prior") + F.col("rank")).cast("double") * F.col("rate") + F.col("offset")
    begin = (F.col("prior") + F.col("rank") - 1).cast("double") * F.col("rate") + F.col("offset")
    copies = (F.floor(end) - F.floor(begin)).cast("long")
    return joined.withColumn("copies", copies)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) per document; ``taken = copies * size``, copies <= cap."""
    spark = docs.sparkSession
    path = shared_dir(spark, "mix-sizes")
    sized(docs, id_col, text_col, source_col).write.parquet(path)
    return _copies(spark.read.parquet(path), weights, cap).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def emit_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, by a key of the row: ids may repeat or be null."""
    spark = docs.sparkSession
    keyed = with_row_key(docs, "mix-rows")
    path = shared_dir(spark, "mix-sizes")
    sized(keyed, id_col, text_col, source_col, (ROW_KEY,)).write.parquet(path)
    copies = _copies(spark.read.parquet(path), WEIGHTS, CAP, (ROW_KEY,))
    joined = keyed.join(copies.where("copies > 0 and size > 0").select(ROW_KEY, F.col("copies").alias("__mix_copies")), ROW_KEY)
    again = F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))
    return joined.withColumn("__mix_copy", again).select(*[keyed[c] for c in docs.columns])


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH rows0 AS (
  SELECT doc_id::BIGINT AS doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
rows1 AS (
  SELECT *, greatest(length(bin(size)) - 3, 0) AS sh,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {SALTS} AS salt FROM rows0),
rows2 AS (SELECT doc_id, source, size, sh * 8 + (size >> sh::BIGINT) AS cls, salt FROM rows1),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows2 GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM s0),
s2 AS (SELECT *, 1 + (pos - 1) % 3 AS weight FROM s1),
s3 AS (
  SELECT *,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE AS lft,
    (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS weight_left
  FROM s2
  WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, 3 * source_size::DOUBLE * weight_left <= lft * weight AS full_ FROM s3),
lvl AS (SELECT lft, weight_left FROM s4 WHERE NOT full_ ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, pos LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN full_ THEN 3 * source_size::DOUBLE ELSE weight * (SELECT lft FROM lvl) / (SELECT weight_left FROM lvl) END AS target,
    ('0x' || substr(md5(coalesce('s' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS offs
  FROM s4),
ranked AS (
  SELECT r.*, t.source_size, t.target, t.offs,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY r.source ORDER BY cls, salt, size, doc_id) AS rank
  FROM rows2 r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rank::DOUBLE * rate + offs) - floor((rank - 1)::DOUBLE * rate + offs)))::BIGINT * size AS taken,
  ((floor(rank::DOUBLE * rate + offs) - floor((rank - 1)::DOUBLE * rate + offs)))::BIGINT AS copies
FROM ranked
"""
