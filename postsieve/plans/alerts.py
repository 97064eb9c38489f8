"""One alert run, one digest run: queue, alert rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators.topk import (
    ALERT_SCORE,
    DIGEST_SCORE,
    REPORT_ROWS,
    alert_queue,
    alert_rows,
    daily_digest,
    digest_remainder,
    render_digest,
)
from postsieve.sources.tables import read_table, write_batch


def alert_once(
    spark: SparkSession,
    root: str,
    as_of: datetime,
    batch_id: str,
    channels: tuple[str, ...] = ("telegram",),
    min_score: int = ALERT_SCORE,
    n: int = REPORT_ROWS,
) -> DataFrame:
    """Move the best waiting jobs to the alert log and return their rows.

    A job with an alert row has left the queue, delivered or not.
    """
    jobs = read_table(spark, root, "jobs")
    done = read_table(spark, root, "alerts", without_batch=batch_id)
    rows = alert_rows(alert_queue(jobs, done, min_score, n), list(channels), as_of)
    write_batch(rows, root, "alerts", batch_id)
    return read_table(spark, root, "alerts").where(F.col("batch_id") == batch_id)


def digest_once(
    spark: SparkSession,
    root: str,
    as_of: datetime,
    batch_id: str,
    channel: str = "digest",
    min_score: int = DIGEST_SCORE,
    n: int = REPORT_ROWS,
) -> DataFrame:
    """The text of the day's digest (no row without matches); its jobs leave the queue by a row in the alert log.

    The rows have a folder of their own (`<batch_id>-digest`), so a run that is repeated gives the same text and rows, and
    an alert run may carry the same batch id.
    """
    label = f"{batch_id}-digest"
    jobs = read_table(spark, root, "jobs")
    done = read_table(spark, root, "alerts", without_batch=label)
    top = daily_digest(jobs, done, as_of, min_score, n)
    text = render_digest(top, digest_remainder(jobs, done, as_of, min_score, n), as_of)
    write_batch(alert_rows(top, [channel], as_of), root, "alerts", label)
    return text
