"""Expiring keys over a stream: the first row of a key blocks it for a TTL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from postsieve.operators.cooldown import SEGMENT_TTLS, accept_per_ttl


def dedup_stream(
    stream: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    ttl_seconds: int,
    out: str,
    checkpoint: str,
    segment_ttls: int = SEGMENT_TTLS,
    available_now: bool = True,
) -> StreamingQuery:
    """Write accepted rows (key, ts, row_id) below `out`.

    The output is the state: an accepted row blocks its key until ts + TTL. A micro-batch
    reads the days of it that can still block, drops blocked rows, and resolves the rest
    with the batch operator, which has no per-key state and no hot key in one task. A
    repeated micro-batch replaces its own folder.
    """
    spark = stream.sparkSession
    fields = [stream.schema[key], stream.schema[ts], stream.schema[row_id]]
    schema = StructType([StructField(f.name, f.dataType) for f in fields]).add("batch", "long").add("day", DateType())
    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").partitionBy("batch", "day").parquet(out)

    def accept(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        start = batch.agg(F.min(F.col(ts).cast("timestamp"))).first()[0]
        if start is None:
            return
        oldest = start - timedelta(seconds=ttl_seconds)
        before = session.read.schema(schema).parquet(out).where(
            (F.col("batch") != batch_id) & (F.col("day") >= F.lit(oldest.date())) & (F.col(ts) > F.lit(oldest))
        )
        ends = F.col(ts).cast("timestamp") + F.expr(f"interval {ttl_seconds} seconds")
        blocked = before.select(key, ends.alias("blocked_until"))
        accepted = accept_per_ttl(batch, key, ts, row_id, ttl_seconds, blocked, segment_ttls)
        daily = accepted.select(
            key, F.col(ts).cast(stream.schema[ts].dataType).alias(ts), row_id, F.to_date(ts).alias("day")
        )
        daily.write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={batch_id}")

    writer = stream.select(key, ts, row_id).writeStream.foreachBatch(accept)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
