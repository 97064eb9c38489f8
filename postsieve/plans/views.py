"""Posting-shaped views of the benchmark tables, the inputs of the registered queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.extract import with_hints
from postsieve.functions.normalize import normalize_remote
from postsieve.functions.scoring import score, watchlist_match
from postsieve.functions.text import canonical_hash, computed_once
from postsieve.operators.dedup import can_key, ext_key

AS_OF = datetime(2001, 7, 1, 12, 0, 0)
CUT_OFF = datetime(2001, 6, 1)
EVENTS_AS_OF = datetime(2024, 1, 30, 12, 0, 0)
WATCHLIST = ["Customer#000000050", "Customer#000000101"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a plain scan ahead of costly work per row.

    They stay as they are read, unless the session asks for a shuffle by `postsieve.input.partitions`; that helps
    where a table is a single file with one row group.
    """
    partitions = rows.sparkSession.conf.get("postsieve.input.partitions", None)
    return rows.repartition(int(partitions)) if partitions else rows


def pick(key: str, n: int, *values: str | None) -> Column:
    """The value at position `key % n`; the last one stands for all further positions."""
    texts = ["null" if v is None else "'" + v.replace("'", "\\'") + "'" for v in values]
    cases = " ".join(f"when {i} then {t}" for i, t in enumerate(texts[:-1]))
    return F.expr(f"case {key} % {n} {cases} else {texts[-1]} end")


def postings(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """Postings made of orders: `k` is the order key, the customer is the company."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = spread(orders) if spread_out else orders
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("k")
    title = F.concat(
        pick("k", 5, "Senior ", "Junior ", "", "Lead ", "Associate "),
        pick("k", 4, "SOC Analyst", "Security Engineer", "Backend Developer", "Network Architect"),
    )
    salary = pick(
        "k", 7, "$120,000 - $180,000 USD", "$120k - $160k", "$95k to $110k", "competitive pay", "$50/hr",
        "€70,000", "$155,000",
    )
    policy = pick("k", 6, "Fully Remote", "Hybrid 2 days", "onsite", "in-office", "remote-first", "flexible")
    tech = pick(
        "k", 3, "CISSP, SIEM and Python", "cloud security, AWS, Kubernetes", "JavaScript, storage, Google Docs"
    )
    rows = rows.select(
        F.col("o_orderkey").alias("k"), F.col("c_name").alias("company"), F.col("n_name").alias("location"),
        F.col("o_orderdate").cast("timestamp").alias("dt"),
    ).withColumn("title", title)
    return rows.select(
        "k",
        F.concat(F.lit("o_"), k.cast("string")).alias("external_id"),
        "title", "company", "location",
        (1 + k % 4).cast("int").alias("source_tier"),
        F.concat(F.lit("src"), (k % 12).cast("string")).alias("source_name"),
        F.concat(F.lit("https://jobs.example.com/"), k.cast("string")).alias("url"),
        F.concat_ws(" ", "title", F.lit("at"), "company", salary, policy, tech).alias("raw_text"),
        (F.col("dt") + F.make_dt_interval(secs=k % 86400)).alias("ingested_at"),
        F.when(k % 8 != 7, k % 8).cast("int").alias("years_of_experience"),
    )


def jobs(
    spark: SparkSession, sf_dir: str, since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """Scored postings in the shape of the jobs table, one row per posting.

    Callers that want a time range name it here, ahead of the extraction.
    """
    rows = postings(spark, sf_dir, spread_out=True)
    if since is not None:
        rows = rows.where(F.col("ingested_at").between(F.lit(since), F.lit(until)))
    rows = with_hints(computed_once(rows, "raw_text"))
    # one step that only takes the struct apart, so that unused facts are not computed
    facts = ("salary_min", "salary_max", "remote_policy", "tech_stack")
    rows = rows.withColumns({name: F.col(f"hints.{name}") for name in facts}).drop("hints")
    rows = rows.withColumns(
        {
            "id": F.col("external_id"),
            "remote_policy": normalize_remote("remote_policy"),
            "certifications_required": F.when(F.col("k") % 3 == 0, F.array(F.lit("CISSP"))).otherwise(
                F.array().cast("array<string>")
            ),
            "salary_currency": F.lit("USD"),
            "salary_period": pick("k", 3, "YEARLY", None, ""),
            "canonical_hash": canonical_hash("title", "company", "location"),
        }
    )
    # the top score is reserved to the list, so the flag needs no score
    rows = rows.withColumn("is_dream", watchlist_match("company", WATCHLIST))
    return rows.withColumn("score", score("is_dream"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth posting has been alerted already; one alert names no job."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).where("k % 9 = 0")
    orphan = F.when(F.col("k") == 0, "gone").otherwise(F.concat(F.lit("o_"), F.col("k").cast("string")))
    return rows.select(orphan.alias("job_id"), F.lit("telegram").alias("channel"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen sources, of which src12 and src13 never deliver."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").where(n <= 13).select(
        F.concat(F.lit("src"), n.cast("string")).alias("name"),
        (1 + n % 4).cast("int").alias("tier"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("timestamp").alias("last_success_at"),
        F.lit(None).cast("timestamp").alias("last_failure_at"),
        (n % 5).alias("consecutive_failures"),
        (n * 10).alias("total_scraped"),
        (n % 3 == 0).alias("is_stale"),
        F.lit(None).cast("string").alias("error_message"),
    )


def seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key marks of the postings before the cut-off."""
    before = postings(spark, sf_dir).where(F.col("ingested_at") < F.lit(CUT_OFF))
    mark = F.explode(
        F.array(
            F.struct(F.lit("ext").alias("kind"), ext_key().alias("key"), F.lit(30).alias("days")),
            F.struct(F.lit("can").alias("kind"), can_key().alias("key"), F.lit(60).alias("days")),
        )
    )
    return before.select("ingested_at", mark.alias("m")).select(
        "m.kind", "m.key", F.col("ingested_at").alias("marked_at"),
        (F.col("ingested_at") + F.make_dt_interval("m.days")).alias("expires_at"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with an untidy parser answer: every kind of wrong, odd or missing field."""
    rows, k = postings(spark, sf_dir, spread_out=True), F.col("k")
    parts = [
        F.lit('{"title":"'), F.col("title"),
        F.lit('","currency":"'), pick("k", 6, "usd", "EUR ", " us dollars", "", "gbp", "USD"), F.lit('"'),
        pick("k", 5, ',"remote_policy":"Fully Remote"', ',"remote_policy":"HYBRID 3 days"',
             ',"remote_policy":"In-Office"', ',"remote_policy":""', ',"remote_policy":"unknown"'),
        pick("k", 11, ',"salary_min":-5', ',"salary_min":"90000"', ',"salary_min":null', ',"salary_min":0',
             ',"salary_min":120000.0', ',"salary_min":"lots"', ""),
        pick("k", 7, ',"tech_stack":[]', ',"tech_stack":[" Rust ","GO",""]', ',"tech_stack":null',
             ',"tech_stack":["a",7]', ""),
        pick("k", 4, ',"certifications_required":["sec+"," CISSP ","","Own Cert","cissp"]',
             ',"certifications_required":[]', "", ',"certifications_required":["CEH","ceh "]'),
        F.when(k % 29 == 0, "").otherwise("}"),
    ]
    return computed_once(rows.withColumn("payload", F.concat(*parts)), "payload", "raw_text")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an outcome log: a view is a success, everything else a failure."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
        (1 + F.col("user_id") % 20 % 4).cast("int").alias("tier"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "view").alias("ok"),
        (F.col("event_id") % 7).alias("n_jobs"),
        F.col("props").alias("message"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # held, or a filter on the text would move back below the shuffle
    return computed_once(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return computed_once(spread(table(spark, sf_dir, "pages")), "html")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose text is settled before anything reads it."""
    return computed_once(postings(spark, sf_dir, spread_out=True), "raw_text")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "props")
