"""Continuous ingestion, alerting and source monitoring by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postsieve.plans.alerts import alert_once
from postsieve.plans.ingest import ingest_batch
from postsieve.sources.registry import load_watchlist
from postsieve.sources.tables import create_tables, current_sources


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def ingest_stream(
    raw: DataFrame,
    root: str,
    watchlist_path: str,
    checkpoint: str,
    run: str = "run",
    clock: Callable[[], datetime] = utc_now,
    alert_channels: tuple[str, ...] = (),
    available_now: bool = True,
) -> StreamingQuery:
    """Ingest a stream of raw postings into the tables below `root`.

    Every micro-batch reads the watch-list again and, if channels are given, moves the
    best new jobs to the alert log. `run` names the folders of this stream: keep it with
    the checkpoint, so that a repeated micro-batch replaces what it wrote.
    """
    create_tables(raw.sparkSession, root)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark, now, label = batch.sparkSession, clock(), f"{run}-{batch_id:08d}"
        ingest_batch(spark, root, batch, load_watchlist(spark, watchlist_path), now, label)
        if alert_channels:
            alert_once(spark, root, now, label, alert_channels)

    writer = raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def monitor_stream(
    ticks: DataFrame,
    root: str,
    report: Callable[[DataFrame, int], None],
    checkpoint: str,
    clock: Callable[[], datetime] = utc_now,
    every: str | None = None,
) -> StreamingQuery:
    """Hand the health of all sources to `report` on every micro-batch of `ticks` (a rate
    or file stream): a source silent for a day is stale, one that delivers again is not."""

    def check(batch: DataFrame, batch_id: int) -> None:
        report(current_sources(batch.sparkSession, root, clock()), batch_id)

    writer = ticks.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
