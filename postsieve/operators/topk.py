"""Ranked reads of the jobs table: alert queue, digest, recent postings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions.render import digest_entry
from postsieve.functions.text import iso_time

# Thresholds and sizes of the reports.
ALERT_SCORE = 80
DIGEST_SCORE = 60
REPORT_ROWS = 10
LOCAL_OFFSET = timedelta(hours=5, minutes=30)


def ranked(jobs: DataFrame, n: int) -> DataFrame:
    """Best score first, then newest, then id."""
    return jobs.orderBy(F.desc("score"), F.desc("ingested_at"), "id").limit(n)


def ingested_between(jobs: DataFrame, since: datetime, until: datetime, closed: bool = True) -> DataFrame:
    """Rows of a time range; the bounds are literals, so they reach the scan, and prune
    folders where the table is partitioned by `ingest_day`."""
    ts = F.col("ingested_at")
    kept = jobs.where((ts >= F.lit(since)) & ((ts <= F.lit(until)) if closed else (ts < F.lit(until))))
    if "ingest_day" in jobs.columns:
        kept = kept.where(F.col("ingest_day").between(F.lit(since.date()), F.lit(until.date())))
    return kept


def unalerted(jobs: DataFrame, alerts: DataFrame, min_score: int = ALERT_SCORE) -> DataFrame:
    """Rows at or above the threshold that no alert row names yet."""
    done = alerts.select(F.col("job_id").alias("id"))
    return jobs.where(F.col("score") >= min_score).join(done, "id", "left_anti")


def alert_queue(
    jobs: DataFrame, alerts: DataFrame, min_score: int = ALERT_SCORE, n: int = REPORT_ROWS
) -> DataFrame:
    return ranked(unalerted(jobs, alerts, min_score), n)


def local_day_bounds(as_of: datetime, offset: timedelta = LOCAL_OFFSET) -> tuple[datetime, datetime]:
    """UTC bounds, half open, of the local day that contains `as_of`."""
    local = as_of + offset
    start = local.replace(hour=0, minute=0, second=0, microsecond=0) - offset
    return start, start + timedelta(days=1)


def digest_matches(
    jobs: DataFrame, alerts: DataFrame, as_of: datetime, min_score: int = DIGEST_SCORE
) -> DataFrame:
    start, end = local_day_bounds(as_of)
    return unalerted(ingested_between(jobs, start, end, closed=False), alerts, min_score)


def daily_digest(
    jobs: DataFrame,
    alerts: DataFrame,
    as_of: datetime,
    min_score: int = DIGEST_SCORE,
    n: int = REPORT_ROWS,
) -> DataFrame:
    return ranked(digest_matches(jobs, alerts, as_of, min_score), n)


def digest_remainder(
    jobs: DataFrame,
    alerts: DataFrame,
    as_of: datetime,
    min_score: int = DIGEST_SCORE,
    n: int = REPORT_ROWS,
) -> DataFrame:
    """Number of matches, and how many of them the digest leaves out."""
    matches = digest_matches(jobs, alerts, as_of, min_score).agg(F.count("*").alias("matches"))
    return matches.select("matches", F.greatest(F.col("matches") - n, F.lit(0).cast("long")).alias("remainder"))


def render_digest(top: DataFrame, remainder: DataFrame, as_of: datetime, title: str = "Daily summary") -> DataFrame:
    """One text row from a digest of at most ten rows; no row for an empty digest."""
    entry = F.struct((-F.col("score")).alias("s"), (-F.unix_micros("ingested_at")).alias("t"), "id", digest_entry().alias("e"))
    entries = top.agg(F.array_sort(F.collect_list(entry)).alias("entries")).where(F.size("entries") > 0)
    day = (as_of + LOCAL_OFFSET).strftime("%Y-%m-%d")
    more = F.when(
        F.col("remainder") > 0,
        F.concat(
            F.lit("\n<i>...and "), F.col("remainder").cast("string"), F.lit(" more. View all "),
            F.col("matches").cast("string"), F.lit(" jobs on the dashboard.</i>"),
        ),
    )
    body = F.array_join(F.transform("entries", lambda e: e["e"]), "\n")
    text = F.concat_ws("\n", F.lit(f"📊 <b>{title} ({day})</b>"), F.lit(""), body, more)
    return entries.crossJoin(remainder).select(text.alias("digest"))


def recent_jobs(
    jobs: DataFrame,
    as_of: datetime,
    hours: int = 24,
    min_score: int = 0,
    remote_only: bool = False,
    limit: int = 20,
) -> DataFrame:
    for name, value, low, high in (
        ("limit", limit, 1, 100), ("min_score", min_score, 0, 100), ("hours", hours, 1, 168),
    ):
        if not low <= value <= high:
            raise ValueError(f"{name} must lie between {low} and {high}, got {value}")
    kept = ingested_between(jobs, as_of - timedelta(hours=hours), as_of).where(F.col("score") >= min_score)
    if remote_only:
        kept = kept.where(F.col("remote_policy") == "remote")
    return ranked(kept, limit)


def job_view(jobs: DataFrame) -> DataFrame:
    """The columns handed to readers, times as ISO text."""
    return jobs.select(
        "id", "company", "title", "score",
        F.col("salary_min").alias("salary_low"), F.col("salary_max").alias("salary_high"),
        "remote_policy", "tech_stack", "location", "url",
        F.col("source_name").alias("source"), F.col("source_tier").alias("tier"),
        iso_time("ingested_at").alias("ingested_at"),
        F.col("is_dream").alias("is_dream_company"),
    )


def alert_rows(queue: DataFrame, channels: list[str], as_of: datetime, delivered: bool = True) -> DataFrame:
    """One alert row per queued job and channel."""
    if not channels:
        raise ValueError("at least one channel is needed")
    return queue.select(
        F.col("id").alias("job_id"),
        F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"),
        "score",
        F.lit(as_of).alias("sent_at"),
        F.lit(delivered).alias("delivered"),
    )


def alerts_with_jobs(alerts: DataFrame, jobs: DataFrame) -> DataFrame:
    """The alert log with the jobs it names."""
    return alerts.withColumnRenamed("score", "alert_score").join(jobs, alerts["job_id"] == jobs["id"])
