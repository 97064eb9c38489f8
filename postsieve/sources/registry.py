"""Source registry, watch-list and the manifest of fetched payloads."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.scoring import watchlist_key
from postsieve.functions.text import blank
from postsieve.schemas import SOURCES

# Where the two board kinds publish their lists.
BOARD_URLS = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs",
    "lever": "https://api.lever.co/v0/postings/{}",
}
MANIFEST_TTL = timedelta(days=1)


def load_registry(spark: SparkSession, config: dict[str, list[str]]) -> DataFrame:
    """(name, tier, url) of the configured sources: boards of tier 1, `feeds` of tier 2."""
    rows = [(slug, 1, url.format(slug)) for kind, url in BOARD_URLS.items() for slug in config.get(kind) or []]
    rows += [(name, 2, None) for name in config.get("feeds") or []]
    return spark.createDataFrame(rows, "name string, tier int, url string")


def seed_sources(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """`sources` plus the registered ones whose name is new; the first of equal names."""
    first = registry.groupBy("name").agg(F.min(F.struct("tier", "url")).alias("s")).select("name", "s.*")
    new = first.join(sources.select("name"), "name", "left_anti")
    given = {"consecutive_failures": F.lit(0), "total_scraped": F.lit(0), "is_stale": F.lit(False)}
    cols = []
    for field in SOURCES.fields:
        value = F.col(field.name) if field.name in new.columns else given.get(field.name, F.lit(None))
        cols.append(value.cast(field.dataType).alias(field.name))
    return sources.unionByName(new.select(*cols))


def load_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Normalized names of a YAML list of texts; other entries are left out and a
    missing file is an empty list. Read again wherever a fresh list is wanted."""
    empty = spark.createDataFrame([], "company_key string")
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    entry = F.regexp_extract("value", r"""^\s*-\s+(.*?)\s*(?:\s#.*)?$""", 1)
    quoted = F.regexp_extract("entry", r"""^(["'])(.*)\1$""", 2)
    is_text = ~F.col("entry").rlike(r"(?i)^(|[-+]?[\d._]+(e[-+]?\d+)?|true|false|yes|no|on|off|null|~)$")
    names = lines.select(entry.alias("entry")).where(is_text)
    name = F.when(quoted != "", quoted).otherwise(F.col("entry"))
    return names.select(watchlist_key(name).alias("company_key")).distinct()


def flag_watchlist(rows: DataFrame, watchlist: DataFrame, company: str = "company") -> DataFrame:
    """Adds `on_watchlist`. The list is broadcast if its size allows, else shuffled."""
    listed = watchlist.select(F.col("company_key").alias("_key"), F.lit(True).alias("_hit"))
    joined = rows.withColumn("_key", watchlist_key(company)).join(listed, "_key", "left")
    return joined.withColumn("on_watchlist", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def skip_unchanged(payloads: DataFrame, manifest: DataFrame, as_of: datetime) -> DataFrame:
    """Drop payloads (kind, url, etag, last_modified) that match their stored validators.

    A feed is unchanged if its stored tag equals the new one; the date decides only
    where no tag is stored. A site list goes by a non-empty date alone.
    """
    live = manifest.where(F.col("expires_at") > F.lit(as_of)).select(
        F.col("url_key").alias("_key"), F.col("etag").alias("_etag"), F.col("last_modified").alias("_date")
    )
    joined = payloads.withColumn("_key", F.md5("url")).join(live, "_key", "left")
    same_date = (blank("_date") != "") & (F.col("_date") == F.col("last_modified"))
    by_tag = F.when(blank("_etag") != "", F.col("_etag") == F.col("etag")).otherwise(same_date)
    unchanged = F.when(F.col("kind") == "feed", by_tag).otherwise(same_date)
    return joined.where(~F.coalesce(unchanged, F.lit(False))).drop("_key", "_etag", "_date")


def manifest_rows(payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Validators to store for read payloads that carry any, live for a day."""
    carried = payloads.where((blank("etag") != "") | (blank("last_modified") != ""))
    return carried.select(
        F.md5("url").alias("url_key"), "etag", "last_modified",
        F.lit(as_of).alias("marked_at"), F.lit(as_of + MANIFEST_TTL).alias("expires_at"),
    )
