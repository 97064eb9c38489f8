"""Join of rows with hot keys to one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_left_join(rows: DataFrame, per_key: DataFrame, key: str, spread: str, salts: int = 32) -> DataFrame:
    """Left join on `key` that spreads every key over `salts` partitions by `spread`.

    For joins followed by a grouping on the same key: there the skew handling of
    adaptive execution must keep the partitioning and cannot split. A small `per_key`
    side is still broadcast by size, in which case the salt costs next to nothing.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    return left.join(per_key.withColumn("_salt", salt), [key, "_salt"], "left").drop("_salt")
