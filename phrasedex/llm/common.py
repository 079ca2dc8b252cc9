"""Helpers shared by the operators: sizing, worker-safe text access, range blocks of documents."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasedex.session import ARROW_ROWS, parts_for, plan_bytes, shared_dir, ship_package

#: A word of a text: a run of bytes other than space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column of a row's own key, see ``with_row_key``.
ROW_KEY = "__row_key"


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, stored, with a key of every row in ``ROW_KEY``; stored, because the keys depend on how the rows were read."""
    path = shared_dir(docs.sparkSession, name)
    docs.withColumn(ROW_KEY, F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def dealt_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the documents: dealt by key and merged, neither side is ever broadcast.

    Spark sizes a table by its files before the query runs: rows of an explode count as if there were none more, and
    packed files as if their rows took no more, so a table of many times the broadcast limit passes for a small one.
    """
    return left.join(right.hint("merge"), on, how)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def id_bounds(docs: DataFrame, id_col: str, n_blocks: int) -> np.ndarray:
    """At most ``n_blocks - 1`` ascending ids that cut ``docs`` into blocks of about equal row counts.

    One pass over the id column alone; approximate quantiles, so a block may be
    somewhat larger. Block of an id = number of bounds <= id.
    """
    if n_blocks < 2:
        return np.empty(0, np.int64)
    shares = [i / n_blocks for i in range(1, n_blocks)]
    row = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, F.lit(20 * n_blocks)).alias("q")).first()
    return np.unique(np.array(row["q"] or [], np.int64))


def int_hash(*cols: str) -> Column:
    """Nonnegative 64-bit hash of the columns."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def release() -> None:
    """Give freed memory of a Python worker back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
