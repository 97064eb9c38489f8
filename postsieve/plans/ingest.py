"""One ingestion batch: raw postings to new jobs, sightings and key marks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.scoring import is_dream, score
from postsieve.functions.text import canonical_hash, coalesce_blank
from postsieve.operators.dedup import drop_seen, first_per_hash, key_marks, later_per_id
from postsieve.operators.parsing import parse_postings
from postsieve.schemas import JOBS
from postsieve.scratch import scratch_dir
from postsieve.sources.registry import flag_watchlist
from postsieve.sources.keys import create_index, read_index, split_by_index, write_keys
from postsieve.sources.tables import read_table, write_batch

API_TIER = 1


def to_jobs(parsed: DataFrame, watchlist: DataFrame, as_of: datetime) -> DataFrame:
    """Scored job rows of parsed postings: parsed fields first, raw ones where blank.

    All parsed fields are carried over before scoring, so every rule can apply.
    """
    fields = {name: coalesce_blank(f"parsed.{name}", name) for name in ("title", "company", "location")}
    fields |= {
        name: F.col(f"parsed.{name}")
        for name in (
            "salary_min", "salary_max", "salary_period", "compensation", "tech_stack", "remote_policy",
            "certifications_required", "certifications_preferred", "years_of_experience",
        )
    }
    fields["salary_currency"] = F.col("parsed.currency")
    fields["external_id"] = F.nullif(F.col("external_id"), F.lit(""))  # unique where given
    fields["description_raw"] = F.col("raw_text")
    rows = parsed.withColumns(fields)
    rows = rows.withColumn("canonical_hash", canonical_hash("title", "company", "location"))
    rows = flag_watchlist(rows, watchlist).withColumn("score", score("on_watchlist"))
    now = F.lit(as_of)
    ingested = F.col("ingested_at") if "ingested_at" in parsed.columns else now
    rows = rows.withColumns(
        {
            "id": F.col("canonical_hash"), "is_dream": is_dream(),
            "ingested_at": ingested, "updated_at": now, "last_seen_at": now,
        }
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in JOBS.fields])


def ingest_batch(
    spark: SparkSession,
    root: str,
    raw: DataFrame,
    watchlist: DataFrame,
    as_of: datetime,
    batch_id: str,
    payloads: DataFrame | None = None,
    delivered: DataFrame | None = None,
) -> None:
    """Run one batch against the tables below `root`; running it again changes nothing.

    `payloads` (external_id, payload) are answers of an external parser, unless `raw` has them in
    a payload column; without them the rules alone fill the fields. `delivered` are the rows by which
    sources count as successful, `raw` if not given. Stored jobs are looked up in the key index; the jobs table
    itself is not read. Jobs are written before the keys, so a batch that dies in between is not taken for a
    repeat of itself.
    """
    state = read_table(spark, root, "seen_keys", without_batch=batch_id)
    create_index(spark, root, read_table(spark, root, "jobs"))

    unseen = drop_seen(raw, state, as_of)
    if payloads is not None:
        unseen = unseen.join(payloads, "external_id", "left")
    elif "payload" not in raw.columns:
        unseen = unseen.withColumn("payload", F.lit(None).cast("string"))
    parsed = parse_postings(unseen.withColumn("payload", F.coalesce("payload", F.lit("{}"))))

    # parsed once, then read by both branches; few rows come later under an id, and texts are not shuffled to find them
    path, later = scratch_dir(spark, "batch"), scratch_dir(spark, "later")
    first_per_hash(to_jobs(parsed, watchlist, as_of)).select(*JOBS.fieldNames()).write.parquet(path)
    firsts = spark.read.schema(JOBS).parquet(path)
    later_per_id(firsts).write.parquet(later)
    unique = firsts.join(spark.read.schema("canonical_hash string").parquet(later), "canonical_hash", "left_anti")
    inserts, known = split_by_index(unique, read_index(spark, root, without_batch=batch_id))

    write_batch(inserts, root, "jobs", batch_id)
    touched = known.where(F.col("source_tier") == API_TIER)
    write_batch(touched.withColumn("last_seen_at", F.lit(as_of)), root, "sightings", batch_id)
    stored = read_table(spark, root, "jobs").where(F.col("batch_id") == batch_id)
    write_keys(stored, root, batch_id)
    write_batch(batch_outcomes(raw if delivered is None else delivered, stored, as_of), root, "outcomes", batch_id)
    write_batch(key_marks(stored, as_of), root, "seen_keys", batch_id)


def batch_outcomes(raw: DataFrame, stored: DataFrame, as_of: datetime) -> DataFrame:
    """A success per source that delivered rows, with the number of jobs stored for it."""
    delivered = raw.groupBy(F.col("source_name").alias("source")).agg(F.max("source_tier").alias("tier"))
    counts = stored.groupBy(F.col("source_name").alias("source")).agg(F.count("*").alias("n"))
    return delivered.join(counts, "source", "left").select(
        "source", "tier", F.lit(as_of).alias("ts"), F.lit(True).alias("ok"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_jobs"), F.lit(None).cast("string").alias("message"),
    )
