"""The stored tables: creation, reads, and batch-wise idempotent writes.

A batch writes each table below `batch_id=<id>` and replaces that folder as a whole, so
a repeated batch leaves the same rows. Nothing stored is rewritten: a posting seen again
adds a row to `sightings`, a job that was alerted has a row in `alerts`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType

from postsieve.operators.health import source_staleness, update_source_stats
from postsieve.schemas import TABLES

# Day folders inside of a batch, for pruning: table -> (folder, column).
DAY_FOLDERS = {"jobs": ("ingest_day", "ingested_at"), "seen_keys": ("expiry_day", "expires_at")}


def _stored_schema(name: str) -> StructType:
    schema = StructType(list(TABLES[name].fields)).add("batch_id", StringType())
    return schema.add(DAY_FOLDERS[name][0], DateType()) if name in DAY_FOLDERS else schema


def create_tables(spark: SparkSession, root: str) -> None:
    """Create the tables that are missing; existing ones stay as they are."""
    for name in TABLES:
        folders = ["batch_id"] + ([DAY_FOLDERS[name][0]] if name in DAY_FOLDERS else [])
        empty = spark.createDataFrame([], _stored_schema(name))
        empty.write.mode("ignore").partitionBy(*folders).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, without_batch: str | None = None) -> DataFrame:
    """A table under its current schema; columns older files lack are NULL.

    A batch that runs again leaves out what it wrote before.
    """
    rows = spark.read.schema(_stored_schema(name)).parquet(f"{root}/{name}")
    return rows if without_batch is None else rows.where(F.col("batch_id") != without_batch)


def write_batch(rows: DataFrame, root: str, name: str, batch_id: str) -> None:
    """Replace the rows of one batch."""
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
    writer_path = f"{root}/{name}/batch_id={batch_id}"
    if name not in DAY_FOLDERS:
        rows.write.mode("overwrite").parquet(writer_path)
        return
    folder, column = DAY_FOLDERS[name]
    # rows of a day meet in few files; a hot day is split by size (rebalance)
    daily = rows.withColumn(folder, F.to_date(column)).hint("rebalance", folder)
    daily.write.mode("overwrite").partitionBy(folder).parquet(writer_path)


def split_known(new: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `new` (with canonical_hash) that the jobs table lacks, and those it has.

    A row is known by its hash, or else by its external id: a posting that comes back under
    another title is the stored job, and gets that job's hash here. Blank ids tell nothing.

    The table is reduced to the hashes and ids of the batch first. A batch is small next to
    the table, so its keys are broadcast when their size allows and the table is streamed
    past them without a shuffle; otherwise a bloom filter thins it out before one.
    """
    hashes = jobs.select("canonical_hash").join(new.select("canonical_hash"), "canonical_hash", "left_semi")
    same, other = (new.join(hashes, "canonical_hash", how) for how in ("left_semi", "left_anti"))
    # without an id, rows have keys of their own that no id equals
    own = F.coalesce(F.nullif("external_id", F.lit("")), F.concat(F.lit("\x00"), "canonical_hash"))
    other = other.withColumn("_id", own)
    ids = jobs.where("external_id <> ''").select(F.col("external_id").alias("_id"), F.col("canonical_hash").alias("_stored"))
    ids = ids.join(other.select("_id"), "_id", "left_semi")
    retitled = other.join(ids, "_id").withColumn("canonical_hash", F.col("_stored"))
    inserts = other.join(ids, "_id", "left_anti")
    return inserts.select(*new.columns), same.select(*new.columns).unionByName(retitled.select(*new.columns))


def upsert_jobs(jobs: DataFrame, new: DataFrame, as_of: datetime, touch_tiers: tuple[int, ...] = (1,)) -> DataFrame:
    """The jobs table after a batch: unknown postings are added, known ones are touched if
    the batch row is of a tier that touches, and left alone otherwise."""
    inserts, known = split_known(new, jobs)
    touched = (
        known.where(F.col("source_tier").isin(*touch_tiers)).select("canonical_hash").distinct()
        .withColumn("_seen", F.lit(as_of))
    )
    kept = jobs.join(touched, "canonical_hash", "left")
    kept = kept.withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at")).drop("_seen")
    return kept.unionByName(inserts.select(*jobs.columns))


def current_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Jobs with the time of their last sighting."""
    seen = read_table(spark, root, "sightings").groupBy("canonical_hash").agg(F.max("last_seen_at").alias("_seen"))
    jobs = read_table(spark, root, "jobs").join(seen, "canonical_hash", "left")
    return jobs.withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at")).drop("_seen")


def current_sources(spark: SparkSession, root: str, as_of: datetime) -> DataFrame:
    """Registered and reported sources with their streaks, totals and staleness."""
    known = read_table(spark, root, "sources").drop("batch_id")
    stats = update_source_stats(known, read_table(spark, root, "outcomes"))
    return source_staleness(stats, read_table(spark, root, "jobs"), as_of)
