"""Counts over the jobs table, each report in one scan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.render import tier_line
from postsieve.functions.text import iso_time
from postsieve.operators.topk import ingested_between

TIERS = (1, 2, 3, 4)
LATENCY_BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0, 30.0)  # fixed values, seconds


def _since(as_of: datetime, hours: int) -> Column:
    ts = F.col("ingested_at")
    return (ts >= F.lit(as_of - timedelta(hours=hours))) & (ts <= F.lit(as_of))


def stats_overview(jobs: DataFrame, as_of: datetime) -> DataFrame:
    """All rows, rows of the last 24 hours, watch-list rows."""
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(_since(as_of, 24)).alias("last_24h"),
        F.count_if("is_dream").alias("dream_jobs"),
    )


def jobs_by_tier(jobs: DataFrame) -> DataFrame:
    """Rows per tier, zero for a tier without rows.

    One conditional count per tier makes a single-row aggregate: no shuffle by tier and
    no join to fill the gaps.
    """
    counts = [F.count_if(F.col("source_tier") == t).alias(f"t{t}") for t in TIERS]
    pairs = [F.struct(F.lit(t).alias("tier"), F.col(f"t{t}").alias("jobs")) for t in TIERS]
    return jobs.agg(*counts).select(F.inline(F.array(*pairs)))


def recent_by_tier(jobs: DataFrame, as_of: datetime, hours: int = 6) -> DataFrame:
    """Rows per tier of the last hours, zero-filled; their sum is the total."""
    return jobs_by_tier(ingested_between(jobs, as_of - timedelta(hours=hours), as_of))


def scraped_by_source(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source_name", "source_tier").agg(F.count("*").alias("scraped"))


def latency_histogram(samples: DataFrame, value: str, buckets=LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound, +Inf included."""
    bounds = [(str(b), F.col(value) <= b) for b in buckets] + [("+Inf", F.col(value).isNotNull())]
    counts = [F.count_if(cond).alias(f"b{i}") for i, (_, cond) in enumerate(bounds)]
    pairs = [
        F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("samples")) for i, (le, _) in enumerate(bounds)
    ]
    return samples.agg(*counts).select(F.inline(F.array(*pairs)))


def source_listing(sources: DataFrame) -> DataFrame:
    return sources.select(
        "name", "tier",
        iso_time("last_success_at").alias("last_success"),
        F.coalesce("consecutive_failures", F.lit(0)).alias("failures"),
        F.coalesce("is_stale", F.lit(False)).alias("is_stale"),
        F.coalesce("total_scraped", F.lit(0)).alias("total_scraped"),
    )


def render_health(
    by_tier: DataFrame, stale: DataFrame, failing: DataFrame, as_of: datetime, title: str = "Health report"
) -> DataFrame:
    """The report text. `by_tier` as from `recent_by_tier`, `stale` one row with `names`,
    `failing` one row with `names`."""
    lines = F.array_sort(F.collect_list(F.struct("tier", tier_line("tier", "jobs").alias("line"))))
    tiers = by_tier.agg(F.sum("jobs").alias("total"), F.transform(lines, lambda x: x["line"]).alias("lines"))
    notes = stale.select(F.col("names").alias("stale")).crossJoin(failing.select(F.col("names").alias("failing")))

    def note(prefix: str, names: str) -> Column:
        return F.when(F.col(names) != "", F.concat(F.lit(prefix), F.col(names)))

    text = F.concat_ws(
        "\n",
        F.lit(f"🩺 <b>{title}</b>"),
        F.lit(f"🕐 {as_of:%Y-%m-%d %H:%M} UTC"),
        F.lit(""),
        F.concat(F.lit("📥 <b>New jobs (last 6h): "), F.col("total").cast("string"), F.lit("</b>")),
        F.array_join("lines", "\n"),
        note("⚠️ Stale sources: ", "stale"),
        note("🔴 Failing (3+ errors): ", "failing"),
        F.lit(""),
        F.lit("<i>System running normally ✅</i>"),
    )
    return tiers.crossJoin(notes).select(text.alias("report"))
