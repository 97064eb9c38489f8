"""Checks of what Parquet does not enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required columns and maximal lengths of the jobs table.
REQUIRED = ("canonical_hash", "company", "title", "source_tier", "is_dream", "ingested_at")
MAX_LENGTH = {
    "external_id": 255,
    "canonical_hash": 64,
    "company": 255,
    "remote_policy": 20,
    "location": 255,
    "salary_currency": 3,
    "salary_period": 10,
    "source_name": 100,
}


ROWS_PER_TASK = 500_000  # keys that one task counts


def _counted(keys: DataFrame, n: int) -> DataFrame:
    """(rule, key, of_jobs, of_alerts) of key rows, about `n` of them.

    Their number gives the number of tasks, so that what a task holds does not grow with the table. Rows of a hot key are
    counted as they come.
    """
    parts = max(1, -(-n // ROWS_PER_TASK))
    sums = [F.sum(c).alias(c) for c in ("of_jobs", "of_alerts")]
    return keys.repartition(parts, "rule", "key").groupBy("rule", "key").agg(*sums)


def _key(rule: str, key: Column | str, of_jobs: int = 1) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.struct(
        F.lit(rule).alias("rule"), key.alias("key"), F.lit(of_jobs).cast("long").alias("of_jobs"), F.lit(1 - of_jobs).cast("long").alias("of_alerts")
    )


def _row_rules(jobs: DataFrame) -> list[tuple[str, str, Column]]:
    rules = [("not null", c, F.col(c).isNull()) for c in REQUIRED if c in jobs.columns]
    return rules + [("length", c, F.length(c) > n) for c, n in MAX_LENGTH.items() if c in jobs.columns]


def check_jobs(jobs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Violations as (rule, column, key, rows): NULLs and lengths in one scan, repeated
    hashes and external ids, alerts without a job in one grouping of all keys."""
    rules = _row_rules(jobs)
    broken = F.array_compact(
        F.array(*[F.when(cond, F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"))) for r, c, cond in rules])
    )
    per_row = (
        jobs.select("id", F.explode(broken).alias("v"))
        .select("v.rule", "v.column", F.col("id").alias("key"), F.lit(1).cast("long").alias("rows"))
    )
    keys = jobs.select(F.explode(F.array(_key("canonical_hash", "canonical_hash"), _key("external_id", "external_id"), _key("id", "id"))).alias("k"))
    keys = keys.select("k.*").where("key is not null")
    named = alerts.select(_key("id", "job_id", 0).alias("k")).select("k.*")
    counted = _counted(keys.unionByName(named), 3 * jobs.count() + alerts.count())
    orphan = (F.col("rule") == "id") & (F.col("of_jobs") == 0)
    counted = counted.where(orphan | ((F.col("rule") != "id") & (F.col("of_jobs") > 1))).select(
        F.when(orphan, "foreign key").otherwise("unique").alias("rule"), F.when(orphan, "job_id").otherwise(F.col("rule")).alias("column"),
        "key", F.when(orphan, F.col("of_alerts")).otherwise(F.col("of_jobs")).alias("rows"),
    )
    return per_row.unionByName(counted)


def check_sources(sources: DataFrame) -> DataFrame:
    """Repeated source names."""
    keys = sources.where("name is not null").select(_key("name", "name").alias("k")).select("k.*")
    counted = _counted(keys, sources.count()).where("of_jobs > 1")
    return counted.select(F.lit("unique").alias("rule"), F.lit("name").alias("column"), "key", F.col("of_jobs").alias("rows"))
