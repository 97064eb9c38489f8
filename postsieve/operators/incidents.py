"""Error log: fingerprints, records and the cool-down between triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import _col
from postsieve.operators.cooldown import SEGMENT_TTLS, accept_per_ttl

COOLDOWN_SECONDS = 3600


def error_fingerprint(
    error_type: Column | str, message: Column | str, file: Column | str, line: Column | str
) -> Column:
    """md5 of the rendered exception line and the place it was raised.

    An exception without a message renders as its type alone; without a place (NULL
    file) only that line counts.
    """
    t, m = _col(error_type), F.coalesce(_col(message), F.lit(""))
    shown = F.concat(F.when(m == "", t).otherwise(F.concat_ws(": ", t, m)), F.lit("\n"))
    place = F.concat(_col(file), F.lit(":"), _col(line).cast("string"))
    return F.md5(F.concat(shown, F.coalesce(place, F.lit(""))))


def merge_context(base: Column | str, explicit: Column | str) -> Column:
    """Union of two string maps, the explicit one wins."""
    empty = F.create_map().cast("map<string,string>")
    b, e = F.coalesce(_col(base), empty), F.coalesce(_col(explicit), empty)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(e, k)), e)


def incident_records(errors: DataFrame) -> DataFrame:
    """One record per row of (context, ts, error_type, message, file, line, base, explicit)."""
    digest = error_fingerprint("error_type", "message", "file", "line")
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return errors.withColumn("error_hash", digest).select(
        F.concat_ws("_", F.lit("incident"), "context", stamp, F.substring("error_hash", 1, 8)).alias("incident_id"),
        "context", "ts", "error_hash", "error_type", "message",
        merge_context("base", "explicit").alias("extra"),
    )


def triggers(
    errors: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    seconds: int = COOLDOWN_SECONDS,
    segment_ttls: int = SEGMENT_TTLS,
) -> DataFrame:
    """Errors that open a cool-down; later ones of the same key within it are left out."""
    return accept_per_ttl(errors, key, ts, row_id, seconds, segment_ttls=segment_ttls)
