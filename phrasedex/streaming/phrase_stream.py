"""Continuous phrase search: new phrase files in a folder -> matches in Parquet.

Each micro-batch is one phrase batch: lines are numbered within the batch
(``query_id = batch_id * 2**32 + line``), answered against the stored index in
one job (``search_batch``), and written under ``batch_id=N`` folders with
overwrite, so a batch retried after a failure replaces its own output instead
of duplicating it. The stream's checkpoint lives under the output folder unless
given, so a restarted stream goes on where it stopped; batch intermediates live
in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phrasedex.plans.search import search_batch
from phrasedex.sources.corpus import with_line_numbers

BATCH_SPAN = 2**32


def _answer(spark: SparkSession, index_path: str, out_path: str):
    def handle(batch: DataFrame, batch_id: int) -> None:
        lines = batch.where(F.trim(F.col("value")) != "")
        numbered = with_line_numbers(lines, piece=F.struct("file", "at")).select(
            (F.lit(batch_id) * BATCH_SPAN + F.col("line_no")).cast("bigint").alias("query_id"),
            F.col("value").alias("query"),
            F.col("file"),
        )
        # Lineage cut: the numbering is read by the search and by the queries sink.
        numbered = numbered.checkpoint(eager=True)
        if numbered.isEmpty():
            return
        res = search_batch(spark, index_path, numbered.select("query_id", "query"))
        part = f"batch_id={batch_id}"
        numbered.write.mode("overwrite").parquet(f"{out_path}/queries/{part}")
        res.matches.write.mode("overwrite").parquet(f"{out_path}/matches/{part}")
        res.docs.write.mode("overwrite").parquet(f"{out_path}/docs/{part}")

    return handle


def start_phrase_stream(
    spark: SparkSession,
    index_path: str,
    phrase_dir: str,
    out_path: str,
    checkpoint: str | None = None,
    available_now: bool = False,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start the stream. ``available_now`` processes what is there, then stops."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    lines = reader.load(phrase_dir).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    writer = (
        lines.writeStream.foreachBatch(_answer(spark, index_path, out_path))
        .option("checkpointLocation", checkpoint or out_path.rstrip("/") + "/_checkpoint")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
