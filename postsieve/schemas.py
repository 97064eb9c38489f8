"""Declared schemas of the tables and of the records that flow between operators."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_STR, _INT, _TS, _BOOL = StringType(), IntegerType(), TimestampType(), BooleanType()
_STRS = ArrayType(StringType())

RAW_POSTING = StructType(
    [
        StructField("external_id", _STR),
        StructField("title", _STR),
        StructField("company", _STR),
        StructField("location", _STR),
        StructField("url", _STR),
        StructField("raw_text", _STR),
        StructField("updated_at", _STR),
        StructField("source_name", _STR),
        StructField("source_tier", _INT),
    ]
)

PARSED_POSTING = StructType(
    [
        StructField("title", _STR),
        StructField("company", _STR),
        StructField("location", _STR),
        StructField("salary_min", _INT),
        StructField("salary_max", _INT),
        StructField("currency", _STR),
        StructField("salary_period", _STR),
        StructField("compensation", MapType(_STR, _STR)),
        StructField("tech_stack", _STRS),
        StructField("certifications_required", _STRS),
        StructField("certifications_preferred", _STRS),
        StructField("remote_policy", _STR),
        StructField("years_of_experience", _INT),
    ]
)

# The first nine columns after the key columns are the ones a later migration added;
# files written before it are read with this schema and give NULL for them.
JOBS = StructType(
    [
        StructField("id", _STR),
        StructField("external_id", _STR),
        StructField("canonical_hash", _STR),
        StructField("company", _STR),
        StructField("title", _STR),
        StructField("description_raw", _STR),
        StructField("tech_stack", _STRS),
        StructField("remote_policy", _STR),
        StructField("location", _STR),
        StructField("certifications_required", _STRS),
        StructField("certifications_preferred", _STRS),
        StructField("salary_min", _INT),
        StructField("salary_max", _INT),
        StructField("salary_currency", _STR),
        StructField("salary_period", _STR),
        StructField("compensation", MapType(_STR, _STR)),
        StructField("years_of_experience", _INT),
        StructField("url", _STR),
        StructField("source_tier", _INT),
        StructField("source_name", _STR),
        StructField("score", _INT),
        StructField("is_dream", _BOOL),
        StructField("ingested_at", _TS),
        StructField("updated_at", _TS),
        StructField("last_seen_at", _TS),
    ]
)

SOURCES = StructType(
    [
        StructField("name", _STR),
        StructField("tier", _INT),
        StructField("url", _STR),
        StructField("last_success_at", _TS),
        StructField("last_failure_at", _TS),
        StructField("consecutive_failures", LongType()),
        StructField("total_scraped", LongType()),
        StructField("is_stale", _BOOL),
        StructField("error_message", _STR),
    ]
)

ALERTS = StructType(
    [
        StructField("job_id", _STR),
        StructField("channel", _STR),
        StructField("score", _INT),
        StructField("sent_at", _TS),
        StructField("delivered", _BOOL),
    ]
)

# Expiring keys: `kind` is "ext" (tier + external id) or "can" (posting hash).
SEEN_KEYS = StructType(
    [
        StructField("kind", _STR),
        StructField("key", _STR),
        StructField("marked_at", _TS),
        StructField("expires_at", _TS),
    ]
)

SIGHTINGS = StructType([StructField("canonical_hash", _STR), StructField("last_seen_at", _TS)])

OUTCOMES = StructType(
    [
        StructField("source", _STR),
        StructField("tier", _INT),
        StructField("ts", _TS),
        StructField("ok", _BOOL),
        StructField("n_jobs", LongType()),
        StructField("message", _STR),
    ]
)

#: What the external parser is asked: one row per text, in numbered batches.
PARSE_REQUESTS = StructType(
    [
        StructField("key", _STR),
        StructField("raw_text", _STR),
        StructField("bucket", LongType()),
        StructField("batch_no", LongType()),
        StructField("pos", LongType()),
    ]
)

PARSE_ANSWERS = StructType(
    [
        StructField("request_batch", _STR),
        StructField("bucket", LongType()),
        StructField("batch_no", LongType()),
        StructField("response", _STR),
    ]
)

PARSE_CACHE = StructType(
    [StructField("key", _STR), StructField("payload", _STR), StructField("expires_at", TimestampType())]
)

#: Raw postings until the request of their text is answered.
WAITING = StructType([*RAW_POSTING.fields, StructField("key", _STR), StructField("request_batch", _STR)])

TABLES = {
    "jobs": JOBS,
    "sources": SOURCES,
    "alerts": ALERTS,
    "seen_keys": SEEN_KEYS,
    "sightings": SIGHTINGS,
    "outcomes": OUTCOMES,
    "parse_requests": PARSE_REQUESTS,
    "parse_answers": PARSE_ANSWERS,
    "parse_cache": PARSE_CACHE,
    "waiting": WAITING,
}
