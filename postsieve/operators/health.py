"""Source health: staleness, failure streaks, running totals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.operators.salting import salted_left_join
from postsieve.operators.topk import ingested_between

STALE_HOURS = 24
MAX_FAILURES = 3


def source_staleness(
    sources: DataFrame, jobs: DataFrame, as_of: datetime, hours: int = STALE_HOURS
) -> DataFrame:
    """`sources` with the job count of the last hours and the flag that follows from it.

    Jobs are counted per source first, so the join meets one row per source.
    """
    recent = ingested_between(jobs, as_of - timedelta(hours=hours), as_of)
    counts = recent.groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("recent_jobs"))
    n = F.coalesce("recent_jobs", F.lit(0).cast("long"))
    return sources.join(counts, "name", "left").withColumn("recent_jobs", n).withColumn("is_stale", n == 0)


def failing_sources(sources: DataFrame, min_failures: int = MAX_FAILURES) -> DataFrame:
    return sources.where(F.coalesce("consecutive_failures", F.lit(0)) >= min_failures)


def joined_names(sources: DataFrame) -> DataFrame:
    """One row with the sorted names of a (small, already filtered) source table."""
    return sources.agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


def source_gauges(sources: DataFrame) -> DataFrame:
    """Number of stale sources and the longest failure streak, 0 without sources."""
    return sources.agg(
        F.count_if("is_stale").alias("stale_sources"),
        F.coalesce(F.max("consecutive_failures"), F.lit(0)).cast("long").alias("max_failures"),
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """State of every source after an outcome log (source, ts, ok, n_jobs, message).

    Failures count when they come after the last success. That needs the last success
    first, one row per source, joined back to the failures with a salt because one
    source may own most of the log; all groupings combine map-side.
    """
    ok = F.col("ok")
    state = outcomes.groupBy("source").agg(
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"),
        F.max(F.when(~ok, F.col("ts"))).alias("last_failure_at"),
        F.coalesce(F.sum(F.when(ok, F.col("n_jobs"))), F.lit(0)).cast("long").alias("scraped"),
    )
    last_ok = outcomes.where(ok).groupBy("source").agg(F.max("ts").alias("last_ok"))
    streaks = (
        salted_left_join(outcomes.where(~ok).select("source", "ts", "message"), last_ok, "source", "ts")
        .where("last_ok is null or ts > last_ok")
        .groupBy("source")
        .agg(F.count("*").alias("streak"), F.max_by("message", F.struct("ts", "message")).alias("error_message"))
    )
    streak = F.coalesce("streak", F.lit(0).cast("long"))
    return state.join(streaks, "source", "left").withColumn("streak", streak)


def update_source_stats(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """`sources` after a log of outcomes; unknown sources are added (tier from the log)."""
    tiers = outcomes.groupBy(F.col("source").alias("name")).agg(F.max("tier").alias("log_tier"))
    new = outcome_totals(outcomes).withColumnsRenamed(
        {
            "source": "name",
            "last_success_at": "new_success",
            "last_failure_at": "new_failure",
            "error_message": "new_error",
        }
    ).join(tiers, "name")
    succeeded, reported = F.col("new_success").isNotNull(), F.col("streak").isNotNull()
    earlier = F.coalesce("consecutive_failures", F.lit(0).cast("long"))
    return sources.join(new, "name", "full").select(
        "name",
        F.coalesce("tier", "log_tier").alias("tier"),
        "url",
        F.coalesce("new_success", "last_success_at").alias("last_success_at"),
        F.coalesce("new_failure", "last_failure_at").alias("last_failure_at"),
        F.when(succeeded, F.col("streak"))
        .otherwise(earlier + F.coalesce("streak", F.lit(0).cast("long")))
        .alias("consecutive_failures"),
        (F.coalesce("total_scraped", F.lit(0)) + F.coalesce("scraped", F.lit(0))).cast("long").alias("total_scraped"),
        F.when(succeeded, False).otherwise(F.coalesce("is_stale", F.lit(False))).alias("is_stale"),
        F.when(reported, F.col("new_error")).otherwise(F.col("error_message")).alias("error_message"),
    )
