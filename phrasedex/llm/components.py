"""Connected components of a link table by alternating large and small stars.

Links are dealt to tasks of at most ``LINKS_PER_TASK``, each of which replaces its own by one
star per group they connect. Links that fit one such task are done then, in one round whatever
the length of their chains; more are rewired: every node to smaller neighbours with one
aggregation and one join, so a node with many links is never gathered in one task (its minimum
is combined on the map side; the join's skew is split by adaptive execution).
Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasedex.session import parts_for, shared_dir, ship_package

from .common import dealt_join

# Links of two 8-byte ids that one task connects; a star table of more is dealt to several.
LINKS_PER_TASK = 1_000_000


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id it is connected with) of all ids of the links but the smallest ones."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    # Names ascend, so the smallest label is the smallest id.
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        while (label != label[label]).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def _contracted(stars: DataFrame, tasks: int) -> DataFrame:
    """``stars`` with one star for each group that the links of one task connect; the same components."""

    def contract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in rows if b.num_rows]
        if batches:
            u, v = connected(*(np.concatenate(side) for side in zip(*batches)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return stars.repartition(tasks).mapInArrow(contract, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, for every id of ``links`` (a, b) that is not itself the smallest."""
    spark = links.sparkSession
    ship_package(spark)

    def stored(df: DataFrame) -> DataFrame:
        path = shared_dir(spark, "stars")
        df.write.parquet(path)
        return spark.read.parquet(path)

    stars = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u != v").distinct()
    before = None
    while True:
        stars = stored(stars)
        mark = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        tasks = parts_for(mark["n"], LINKS_PER_TASK)
        if tasks == 1 and mark["n"]:
            stars = stored(_contracted(stars, 1))
        if tasks == 1 or (mark["n"], mark["s"]) == before:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = (mark["n"], mark["s"])
        stars = stored(_contracted(stars, tasks))
        # Large star: every node's greater neighbours go to the smallest of its neighbourhood.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = dealt_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        smallest = _least(large)
        small = dealt_join(large, smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct()
