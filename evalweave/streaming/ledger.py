"""Streams of ledger cells and responses.

``latest_cells`` keeps one row of state for each cell; ``windowed_operations``
has a watermark, so its state ends with the windows. Windowed figures are an
addition of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_cells(cells: DataFrame) -> DataFrame:
    """The last line of each cell of a stream (runner_id, scenario_id, status, line_no)."""
    return cells.groupBy("runner_id", "scenario_id").agg(F.max_by("status", "line_no").alias("status"), F.max("line_no").alias("line_no"))


def windowed_operations(responses: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Responses, mean latency and refusal rate of each runner by window of access time."""
    w = F.window("accessed_at", window, slide) if slide else F.window("accessed_at", window)
    by = responses.withWatermark("accessed_at", late).groupBy(w.alias("w"), "runner_id")
    return by.agg(F.count(F.lit(1)).alias("responses"), F.avg("latency_ms").alias("mean_latency"), F.avg(F.col("refusal").cast("int")).alias("refusal_rate")).select(F.col("w.start").alias("window_start"), "runner_id", "responses", "mean_latency", "refusal_rate")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs what there is of an aggregated stream into a table under a shared folder, checkpoint beside it; the table read back."""
    path = f"{folder}/table"
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)  # each batch has the whole result, so one that comes again does no harm

    q: StreamingQuery = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def merge_into(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's latest cells to a table, which readers compact by line number; a batch that comes again does no harm."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_cells(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
