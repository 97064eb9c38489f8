"""Rolling counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rolling_counts(
    stream: DataFrame,
    ts: str,
    by: list[str],
    window: str = "24 hours",
    slide: str = "6 hours",
    late: str = "1 hour",
) -> DataFrame:
    """Rows per sliding window and group. Later rows than `late` are dropped by append
    and update sinks; a complete sink keeps every window."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = timed.groupBy(F.window(ts, window, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def write_complete(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole result, one snapshot folder per micro-batch.

    The snapshot holds aggregates only. Readers take the latest folder.
    """

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = counts.writeStream.outputMode("complete").foreachBatch(snapshot)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_snapshot(counts_schema, spark, out: str) -> DataFrame:
    rows = spark.read.schema(counts_schema.add("batch", "long")).parquet(out)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(newest)).drop("batch")
