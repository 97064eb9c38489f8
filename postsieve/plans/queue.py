"""Ingestion around an external parser: cached answers at once, the rest through an outbox and an inbox.

A text that the cache lacks is requested once and its postings wait. A later batch brings answers per request batch, bucket and
batch number; each is taken once, fills the cache, and releases the postings that wait for it. All tables are written per batch, and a
batch that runs again reads none of its own rows, so it leaves the same rows after a crash at any point.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators.dedup import drop_seen
from postsieve.operators.parsing import align_results, chunk, parse_requests, split_by_cache
from postsieve.plans.ingest import ingest_batch
from postsieve.schemas import RAW_POSTING
from postsieve.sources.tables import read_table, write_batch

REQUEST = ["request_batch", "bucket", "batch_no"]
CACHE_TTL = timedelta(days=30)
BUCKETS = 64


def accept_answers(spark: SparkSession, root: str, responses: DataFrame, batch_id: str) -> DataFrame:
    """Store the responses (request_batch, bucket, batch_no, response) that answer an open request; returns them.

    A response to nothing, or to a request that has its answer, is left out; of several to one request the smallest text counts.
    """
    asked = read_table(spark, root, "parse_requests", without_batch=batch_id).withColumn("request_batch", F.col("batch_id"))
    taken = read_table(spark, root, "parse_answers", without_batch=batch_id)
    first = responses.where("response is not null").groupBy(*REQUEST).agg(F.min("response").alias("response"))
    fresh = first.join(taken.select(*REQUEST), REQUEST, "left_anti").join(asked.select(*REQUEST).distinct(), REQUEST, "left_semi")
    write_batch(fresh, root, "parse_answers", batch_id)
    return read_table(spark, root, "parse_answers").where(F.col("batch_id") == batch_id).drop("batch_id")


def _aligned(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """`asked` rows of answered requests, each with its own payload; one that the answer leaves out has an empty object."""
    request = F.to_json(F.struct("request_batch", "bucket"))  # align_results knows requests by two columns
    rows = asked.join(answers.select(*REQUEST), REQUEST, "left_semi").withColumn("bucket", request)
    return align_results(rows, answers.withColumn("bucket", request)).select("request_batch", "key", "payload")


def open_requests(spark: SparkSession, root: str) -> DataFrame:
    """The texts for the parser (request_batch, bucket, batch_no, n_texts, request) of all requests without an answer."""
    asked = read_table(spark, root, "parse_requests").withColumn("request_batch", F.col("batch_id"))
    asked = asked.join(read_table(spark, root, "parse_answers").select(*REQUEST), REQUEST, "left_anti")
    by_batch = asked.withColumn("bucket", F.struct("request_batch", "bucket"))
    listed = parse_requests(by_batch, "raw_text")
    return listed.select("bucket.request_batch", F.col("bucket.bucket").alias("bucket"), "batch_no", "n_texts", "request")


def waiting_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings whose text has no answer yet, with key and request_batch."""
    asked = read_table(spark, root, "parse_requests").withColumn("request_batch", F.col("batch_id"))
    done = asked.join(read_table(spark, root, "parse_answers").select(*REQUEST), REQUEST, "left_semi")
    return read_table(spark, root, "waiting").drop("batch_id").join(done.select("request_batch", "key"), ["request_batch", "key"], "left_anti")


def ingest_with_cache(
    spark: SparkSession,
    root: str,
    raw: DataFrame,
    responses: DataFrame,
    watchlist: DataFrame,
    as_of: datetime,
    batch_id: str,
    ttl: timedelta = CACHE_TTL,
    buckets: int = BUCKETS,
) -> None:
    """One batch: take answers, split the unseen postings of `raw` by the cache, request what is unknown, ingest what is answered.

    Copies of a text wait for one request. `responses` has request_batch, bucket, batch_no and response.
    """
    answers = accept_answers(spark, root, responses, batch_id)
    asked = read_table(spark, root, "parse_requests", without_batch=batch_id).withColumn("request_batch", F.col("batch_id"))
    resolved = _aligned(asked, answers)
    entries = resolved.where("payload <> '{}'").select(
        "key", F.concat(F.lit("["), "payload", F.lit("]")).alias("payload"), F.lit(as_of + ttl).alias("expires_at")
    )
    write_batch(entries, root, "parse_cache", batch_id)

    cache = read_table(spark, root, "parse_cache").groupBy("key").agg(
        F.max_by("payload", F.struct("expires_at", "payload")).alias("payload"), F.max("expires_at").alias("expires_at")
    )
    names = RAW_POSTING.fieldNames()
    unseen = drop_seen(raw.select(*names), read_table(spark, root, "seen_keys", without_batch=batch_id), as_of)
    split = split_by_cache(unseen.select(*names), cache, as_of, key="key")

    earlier = read_table(spark, root, "parse_answers", without_batch=batch_id)
    unanswered = asked.join(earlier.select(*REQUEST), REQUEST, "left_anti").join(answers.select(*REQUEST), REQUEST, "left_anti")
    pending = unanswered.select("key", F.col("request_batch").alias("_asked"))
    missing = split.where("not cache_hit").join(pending, "key", "left")
    write_batch(missing.withColumn("request_batch", F.coalesce("_asked", F.lit(batch_id))), root, "waiting", batch_id)
    waiting = read_table(spark, root, "waiting").where((F.col("batch_id") == batch_id) & (F.col("request_batch") == batch_id))
    new = waiting.groupBy("key").agg(F.first("raw_text").alias("raw_text"))
    # keys alone are numbered; texts, which lie by key already, meet their numbers there
    write_batch(new.join(chunk(new.select("key"), "key", buckets), "key"), root, "parse_requests", batch_id)

    waited = read_table(spark, root, "waiting", without_batch=batch_id).join(resolved, ["request_batch", "key"])
    ready = split.where("cache_hit").select(*names, "payload").unionByName(waited.select(*names, "payload"))
    ingest_batch(spark, root, ready, watchlist, as_of, batch_id, delivered=raw)
