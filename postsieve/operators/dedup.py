"""Repeats: live-key lookups, first row of a batch, key marks and their counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.text import blank, canonical_hash, dedup_hash, is_blank

# How long a key stays live.
EXT_TTL_DAYS = 30
CAN_TTL_DAYS = 60


def ext_key(tier: Column | str = "source_tier", external_id: Column | str = "external_id") -> Column:
    """Key of the first layer; NULL (never equal to a mark) for a blank id."""
    t = F.col(tier) if isinstance(tier, str) else tier
    return F.when(~is_blank(external_id), F.concat_ws(":", t.cast("string"), blank(external_id)))


def can_key(strict_compat: bool = False) -> Column:
    """Key of the second layer; NULL where the layer does not apply.

    Rows without a title all share one key per company, so after the first of them the
    rest would count as repeats for the whole TTL. They bypass the layer; with
    `strict_compat` only rows that lack title and company do.
    """
    applies = ~is_blank("title")
    if strict_compat:
        applies = applies | ~is_blank("company")
    return F.when(applies, dedup_hash("title", "company", "location"))


def live_keys(state: DataFrame, kind: str, as_of: datetime) -> DataFrame:
    """Keys of one kind that have not expired. With the state partitioned by kind and
    expiry day both conditions prune folders."""
    live = state.where((F.col("kind") == kind) & (F.col("expires_at") > F.lit(as_of)))
    if "expiry_day" in state.columns:
        live = live.where(F.col("expiry_day") >= F.lit(as_of.date()))
    return live.select("key")


def _seen_among(rows: DataFrame, key: Column, state: DataFrame, kind: str, as_of: datetime) -> DataFrame:
    """Live keys that occur in `rows`.

    The state outgrows every batch. Reduced to the keys of the batch it is streamed past
    their broadcast, if their size allows that, and the rows then meet only the hits.
    """
    keys = rows.select(key.alias("key")).where("key is not null").distinct()
    return live_keys(state, kind, as_of).join(keys, "key", "left_semi")


def _drop_known(rows: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """Anti-join on `key`. Rows whose key is NULL pass; they get a key of their own so
    that they do not all meet in one partition."""
    spread = F.concat(F.lit("\0"), F.xxhash64("url", "raw_text", "external_id").cast("string"))
    keyed = rows.withColumn("_key", F.coalesce(key, spread))
    return keyed.join(known.withColumnRenamed("key", "_key"), "_key", "left_anti").drop("_key")


def drop_seen_ids(rows: DataFrame, state: DataFrame, as_of: datetime) -> DataFrame:
    """Drop rows whose (tier, external id) is live."""
    key = ext_key()
    return _drop_known(rows, _seen_among(rows, key, state, "ext", as_of), key)


def drop_seen_hashes(
    rows: DataFrame,
    state: DataFrame,
    as_of: datetime,
    strict_compat: bool = False,
    batch: DataFrame | None = None,
) -> DataFrame:
    """Drop rows whose posting hash is live.

    `batch` may name the frame `rows` were filtered from: its keys serve to reduce the
    state, which spares running the filters twice.
    """
    key = can_key(strict_compat)
    return _drop_known(rows, _seen_among(rows if batch is None else batch, key, state, "can", as_of), key)


def drop_seen(rows: DataFrame, state: DataFrame, as_of: datetime, strict_compat: bool = False) -> DataFrame:
    """Drop rows that either layer knows."""
    return drop_seen_hashes(drop_seen_ids(rows, state, as_of), state, as_of, strict_compat, batch=rows)


def first_per(rows: DataFrame, keys: list[Column | str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first `n` rows per key.

    The rank filter is pushed below the shuffle (window group limit), so every task
    sends at most `n` rows of a key, however many copies it holds.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def first_per_hash(rows: DataFrame, order: str = "ingested_at") -> DataFrame:
    """The earliest row per canonical hash."""
    # the hash crosses the shuffle as 32 bytes, not as their 64 hexadecimal digits
    hashed = rows.withColumn("_hash", F.unhex(canonical_hash("title", "company", "location"))).drop("canonical_hash")
    first = first_per(hashed, ["_hash"], [F.col(order), F.col("external_id")])
    return first.withColumn("canonical_hash", F.lower(F.hex("_hash"))).drop("_hash")


def _first_per_id(rows: DataFrame, order: str) -> DataFrame:
    # a blank id is no id: the hash, unique by now, stands in for it
    rows = rows.withColumn("_hash", F.unhex("canonical_hash")).drop("canonical_hash")
    stand_in = F.when(is_blank("external_id"), F.concat(F.lit("\0"), F.lower(F.hex("_hash"))))
    key = F.coalesce(stand_in, F.col("external_id"))
    first = first_per(rows, [key], [F.col(order), F.col("_hash")])
    return first.withColumn("canonical_hash", F.lower(F.hex("_hash"))).drop("_hash")


def later_per_id(rows: DataFrame, order: str = "ingested_at") -> DataFrame:
    """canonical_hash of those of `rows` (one per canonical_hash) that are not the first of their external id; only keys are shuffled."""
    slim = rows.select("canonical_hash", "external_id", order)
    return slim.join(_first_per_id(slim, order), "canonical_hash", "left_anti").select("canonical_hash")


def first_wins(rows: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Keep the earliest row per canonical hash, then per external id."""
    return _first_per_id(first_per_hash(rows, order), order)


def new_rows(
    rows: DataFrame,
    state: DataFrame,
    as_of: datetime,
    order: str = "ingested_at",
    strict_compat: bool = False,
) -> DataFrame:
    """Unseen rows of a batch, one per posting.

    Copies share their posting hash and so their fate in the second layer. Taking the
    first copy before that layer leaves the join without hot keys and gives the same rows.
    """
    unique = first_per_hash(drop_seen_ids(rows, state, as_of), order)
    return _first_per_id(drop_seen_hashes(unique, state, as_of, strict_compat, batch=rows), order)


def key_marks(stored: DataFrame, as_of: datetime | Column, strict_compat: bool = False) -> DataFrame:
    """State rows that mark stored postings as seen, one per layer that applies."""
    now = F.lit(as_of) if isinstance(as_of, datetime) else as_of
    marks = F.array(
        F.struct(F.lit("ext").alias("kind"), ext_key().alias("key"), F.lit(EXT_TTL_DAYS).alias("days")),
        F.struct(F.lit("can").alias("kind"), can_key(strict_compat).alias("key"), F.lit(CAN_TTL_DAYS).alias("days")),
    )
    return (
        stored.select(now.alias("marked_at"), F.explode(marks).alias("m"))
        .where("m.key is not null")
        .select(
            "m.kind",
            "m.key",
            "marked_at",
            (F.col("marked_at") + F.make_dt_interval("m.days")).alias("expires_at"),
        )
    )


def layer_hits(rows: DataFrame, state: DataFrame, as_of: datetime, strict_compat: bool = False) -> DataFrame:
    """Rejected rows per layer; a row rejected by its id is not looked up by hash.

    Rows are counted per key before each lookup, so a hot key crosses the network as
    one row per task.
    """
    by_id = (
        rows.withColumn("key", ext_key()).where("key is not null").groupBy("key").count()
        .join(live_keys(state, "ext", as_of).distinct(), "key", "left_semi")
    )
    by_hash = (
        drop_seen_ids(rows, state, as_of)
        .withColumn("key", can_key(strict_compat)).where("key is not null").groupBy("key").count()
        .join(live_keys(state, "can", as_of).distinct(), "key", "left_semi")
    )
    layers = [(by_id, "ext"), (by_hash, "can")]
    counts = [
        hits.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("hits")).select(F.lit(kind).alias("layer"), "hits")
        for hits, kind in layers
    ]
    return counts[0].unionByName(counts[1])


def live_key_counts(state: DataFrame, as_of: datetime) -> DataFrame:
    """Live keys per kind. A key marked again counts once."""
    live = state.where(F.col("expires_at") > F.lit(as_of)).select("kind", "key").distinct()
    return live.groupBy("kind").agg(F.count("*").alias("entries"))


def upsert_keyed(state: DataFrame, new: DataFrame, keys: list[str], marked_at: str = "marked_at") -> DataFrame:
    """State with the last mark of every key; partial aggregation keeps hot keys cheap.

    Of marks of the same time the one whose other columns are largest (as JSON) stays.
    """
    rest = F.struct(*[c for c in state.columns if c not in keys])
    latest = F.max_by(rest, F.struct(F.col(marked_at), F.to_json(rest))).alias("_last")
    merged = state.unionByName(new.select(*state.columns)).groupBy(*keys).agg(latest)
    return merged.select(*keys, "_last.*").select(*state.columns)
