"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.extract import (
    extract_company,
    extract_remote_policy,
    extract_salary,
    has_company,
    has_salary,
    with_keywords,
    worth_parsing,
)
from postsieve.functions.normalize import normalize_certs, normalize_currency, normalize_remote, normalize_tech
from postsieve.functions.render import format_salary, format_tech, render_alert
from postsieve.functions.text import (
    canonical_hash,
    coalesce_blank,
    company_from_slug,
    dedup_hash,
    split_title_company,
    strip_tags,
    subject_line,
    surrogate_id,
)
from postsieve.operators import constraints, cooldown, dedup, health, incidents, metrics, parsing, topk
from postsieve.plans import queue, views
from postsieve.plans.views import AS_OF, CUT_OFF, EVENTS_AS_OF
from postsieve.scratch import scratch_dir
from postsieve.sources import keys, payloads, registry, tables
from postsieve.streaming import counts, dedup as stream_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DAY = 24 * 3600
REQUEST_BUCKETS = 64


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__.removesuffix("_query")] = run
    return fn


def _csv(c: Column | str) -> Column:
    return F.array_join(c, ",")


def _time(c: str, name: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def _micros(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


# Ranked reads


@query
def alert_queue_top10(spark, sf_dir):
    queue = topk.alert_queue(views.jobs(spark, sf_dir), views.alerts(spark, sf_dir))
    return queue.select("id", "company", "title", "score", _csv("tech_stack").alias("tech"), _time("ingested_at"))


@query
def recent_jobs(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir, AS_OF - timedelta(hours=168), AS_OF)
    recent = topk.recent_jobs(jobs, AS_OF, hours=168, min_score=20, remote_only=True, limit=50)
    view = topk.job_view(recent).withColumn("tech_stack", _csv("tech_stack"))
    return view.withColumns({c: F.col(c).cast("string") for c in ("salary_low", "salary_high")})


def _jobs_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.jobs(spark, sf_dir, *topk.local_day_bounds(AS_OF))


@query
def daily_digest(spark, sf_dir):
    top = topk.daily_digest(_jobs_of_day(spark, sf_dir), views.alerts(spark, sf_dir), AS_OF)
    return top.select("id", "company", "title", "score", _time("ingested_at"))


@query
def digest_remainder(spark, sf_dir):
    return topk.digest_remainder(_jobs_of_day(spark, sf_dir), views.alerts(spark, sf_dir), AS_OF, min_score=0, n=5)


@query
def digest_text(spark, sf_dir):
    jobs, alerts = _jobs_of_day(spark, sf_dir), views.alerts(spark, sf_dir)
    top = topk.daily_digest(jobs, alerts, AS_OF, min_score=0, n=5)
    return topk.render_digest(top, topk.digest_remainder(jobs, alerts, AS_OF, min_score=0, n=5), AS_OF)


@query
def alert_texts(spark, sf_dir):
    waiting = topk.unalerted(views.jobs(spark, sf_dir), views.alerts(spark, sf_dir))
    return waiting.select("id", format_salary().alias("salary"), format_tech().alias("tech"), render_alert().alias("text"))


@query
def alerts_per_channel(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir)
    rows = topk.alert_rows(topk.alert_queue(jobs, views.alerts(spark, sf_dir)), ["telegram", "email"], AS_OF)
    return topk.alerts_with_jobs(rows, jobs).select("job_id", "channel", "alert_score", "company", "delivered")


# Scoring and extraction


@query
def score_all(spark, sf_dir):
    return views.jobs(spark, sf_dir).select("k", "score", "is_dream")


@query
def salary_extract(spark, sf_dir):
    low, high = extract_salary("raw_text")
    return views.texts(spark, sf_dir).select(
        "k", low.cast("string").alias("salary_min"), high.cast("string").alias("salary_max"), has_salary("raw_text").alias("has_salary")
    )


@query
def salary_extract_documents(spark, sf_dir):
    low, high = extract_salary("text")
    return views.documents(spark, sf_dir).select(
        "doc_id", low.cast("string").alias("salary_min"), high.cast("string").alias("salary_max"), has_salary("text").alias("has_salary")
    )


@query
def policy_extract(spark, sf_dir):
    phrase = extract_remote_policy("raw_text")
    return views.texts(spark, sf_dir).select("k", phrase.alias("phrase"), normalize_remote(phrase).alias("policy"))


@query
def keyword_scan(spark, sf_dir):
    rows = views.texts(spark, sf_dir)
    return with_keywords(rows).select("k", _csv("tech_stack").alias("tech"))


@query
def keyword_scan_documents(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return with_keywords(docs, "text").select("doc_id", _csv("tech_stack").alias("tech"))


@query
def company_extract(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select("doc_id", extract_company("text").alias("company"), has_company("text").alias("has_company"))


@query
def message_prefilter(spark, sf_dir):
    return views.documents(spark, sf_dir).where(worth_parsing("text")).select("doc_id")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = views.table(spark, sf_dir, "conversations")
    return talks.select(
        F.concat(F.lit("channel_"), "role").alias("channel"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text"
    )


@query
def messages_to_raw(spark, sf_dir):
    raw = payloads.messages_to_raw(_messages(spark, sf_dir))
    return raw.select("external_id", "title", "company", "url", "source_name", F.md5("raw_text").alias("text_md5"))


@query
def latest_messages(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    latest = payloads.latest_per(messages, "channel", "msg_id", payloads.MESSAGES_PER_CHANNEL)
    return latest.select("channel", "msg_id")


# Parsed fields


@query
def normalize_fields(spark, sf_dir):
    rows = views.postings(spark, sf_dir)
    policy = views.pick("k", 6, "Fully Remote", " HYBRID remote", "In-Office", "in person", "", None)
    currency = views.pick("k", 7, "usd", "EUR ", " us dollars", "", None, "gbp", " chf")
    tech = F.split(views.pick("k", 3, " Rust |GO||go", "", "C++| "), r"\|")
    certs = F.split(views.pick("k", 4, "sec+| CISSP ||Own Cert|cissp", "", "Security+|ceh", "AWS Certified Security"), r"\|")
    return rows.select(
        "k",
        normalize_remote(policy).alias("policy"),
        normalize_currency(currency).alias("currency"),
        _csv(normalize_tech(tech)).alias("tech"),
        _csv(normalize_certs(certs)).alias("certs"),
    )


def _parsed_columns() -> list[Column]:
    p = "parsed"
    return [
        F.col(f"{p}.title").alias("title"),
        F.col(f"{p}.salary_min").cast("string").alias("salary_min"),
        F.col(f"{p}.currency").alias("currency"),
        F.col(f"{p}.remote_policy").alias("policy"),
        _csv(f"{p}.tech_stack").alias("tech"),
        _csv(f"{p}.certifications_required").alias("certs"),
    ]


@query
def validate_split(spark, sf_dir):
    return parsing.validate_parsed(views.payloads(spark, sf_dir)).select("k", "is_valid", *_parsed_columns())


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_postings(views.payloads(spark, sf_dir))


@query
def merge_hints(spark, sf_dir):
    return _parsed(spark, sf_dir).where("is_valid").select("k", *_parsed_columns())


@query
def fallback_parse(spark, sf_dir):
    bad = _parsed(spark, sf_dir).where("not is_valid")
    return bad.select("k", F.col("parsed.company").alias("company"), *_parsed_columns())


# Names and keys


@query
def split_title_company_query(spark, sf_dir):
    rows = views.postings(spark, sf_dir)
    text = F.when(F.col("k") % 3 == 0, F.col("title")).otherwise(
        F.concat_ws(" at ", "title", F.when(F.col("k") % 3 == 1, "night"), F.concat("company", F.lit(" ")))
    )
    title, company = split_title_company(text)
    return rows.select("k", title.alias("title"), company.alias("company"))


@query
def slug_company(spark, sf_dir):
    slug = F.concat_ws("-", F.lower(F.translate("company", "#", "-")), F.lit("3d"), F.lower("location"))
    return views.postings(spark, sf_dir).select("k", company_from_slug(slug).alias("company"))


@query
def surrogate_ids(spark, sf_dir):
    return views.postings(spark, sf_dir).select("k", surrogate_id("rss", "url").alias("external_id"))


@query
def dedup_hash_query(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.upper("title"), F.lit("\n"))
    return views.postings(spark, sf_dir).select("k", dedup_hash(padded, "company", "location").alias("hash"))


@query
def canonical_hash_query(spark, sf_dir):
    padded = F.concat(F.lit(" "), F.upper("title"))
    return views.postings(spark, sf_dir).select("k", canonical_hash(padded, "company", "location").alias("hash"))


@query
def blank_fallback(spark, sf_dir):
    parsed = views.pick("k", 3, "", None, "Parsed title")
    return views.postings(spark, sf_dir).select("k", coalesce_blank(parsed, "title").alias("title"))


# Stored pages


@query
def page_links_positional(spark, sf_dir):
    rows = payloads.extract_mail_postings(
        views.pages(spark, sf_dir), link=r'href="(/[^"]+)"', title=r"<h1[^>]*>([^<]+)</h1>",
        company=r"<b[^>]*>([^<]+)<", keep=("page_id",),
    )
    return rows.select("page_id", "external_id", "url", "title", "company", F.md5("raw_text").alias("text_md5"))


@query
def page_cards(spark, sf_dir):
    pages = views.pages(spark, sf_dir)
    menu = payloads.extract_page_cards(pages, "li", title="a", keep=("page_id",))
    body = payloads.extract_page_cards(pages, "article", title="h1", company="p", keep=("page_id",))
    return menu.unionByName(body).select("page_id", "external_id", "title", F.md5("raw_text").alias("text_md5"))


@query
def strip_tags_subject(spark, sf_dir):
    return views.pages(spark, sf_dir).select(
        "page_id", F.md5(strip_tags("html")).alias("text_md5"), subject_line("html").alias("subject")
    )


# Repeats


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings since the cut-off, and older ones polled once more."""
    rows = views.postings(spark, sf_dir)
    return rows.where((F.col("ingested_at") >= F.lit(CUT_OFF)) | (F.col("k") % 7 == 3))


@query
def dedup_against_state(spark, sf_dir):
    new = dedup.new_rows(_incoming(spark, sf_dir), views.seen_keys(spark, sf_dir), CUT_OFF)
    return new.select("k", "external_id", "canonical_hash")


@query
def dedup_layer_hits(spark, sf_dir):
    return dedup.layer_hits(_incoming(spark, sf_dir), views.seen_keys(spark, sf_dir), CUT_OFF)


@query
def live_key_counts(spark, sf_dir):
    return dedup.live_key_counts(views.seen_keys(spark, sf_dir), CUT_OFF)


@query
def key_marks(spark, sf_dir):
    marks = dedup.key_marks(views.postings(spark, sf_dir), AS_OF)
    return marks.select("kind", "key", _time("expires_at"))


@query
def upsert_keys(spark, sf_dir):
    """Key state after all postings are marked at their ingest time."""
    state = views.seen_keys(spark, sf_dir)
    later = dedup.key_marks(_incoming(spark, sf_dir), F.col("ingested_at"))
    merged = dedup.upsert_keyed(state, later, ["kind", "key"])
    return merged.select("kind", "key", _time("marked_at"), _time("expires_at"))


@query
def first_wins_batch(spark, sf_dir):
    rows = views.postings(spark, sf_dir)
    shared = F.concat(F.lit("o_"), F.floor(F.col("k") / 3).cast("string"))
    first = dedup.first_wins(rows.withColumn("external_id", F.when(F.col("k") % 10 == 9, "").otherwise(shared)))
    return first.select("k", "external_id", "canonical_hash")


def _stored(rows: DataFrame) -> DataFrame:
    """The rows as a written table, for inputs that several branches read."""
    path = scratch_dir(rows.sparkSession, "table")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query
def upsert_jobs(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir).select(
        "k", "external_id", "title", "company", "location", "score", "source_tier", "ingested_at",
        F.col("ingested_at").alias("last_seen_at"),
    )
    jobs = _stored(jobs)
    old = _stored(dedup.first_wins(jobs.where(F.col("ingested_at") < F.lit(CUT_OFF))))
    again = jobs.where((F.col("ingested_at") >= F.lit(CUT_OFF)) | (F.col("k") % 7 == 3))
    retitled = F.when(F.col("k") % 14 == 3, F.concat("title", F.lit(" II"))).otherwise(F.col("title"))
    new = _stored(dedup.first_wins(again.withColumn("title", retitled)))
    merged = tables.upsert_jobs(old, new, AS_OF)
    return merged.select("canonical_hash", "external_id", "score", _time("ingested_at"), _time("last_seen_at"))


@query
def jobs_by_key_index(spark, sf_dir):
    """Two batches against the key index, whose folders are merged in between."""
    jobs = views.jobs(spark, sf_dir).select("k", "external_id", "title", "company", "location", "ingested_at")
    jobs, root = _stored(jobs), scratch_dir(spark, "index")
    first = dedup.first_wins(jobs.where(F.col("ingested_at") < F.lit(CUT_OFF)))
    keys.create_index(spark, root, first.withColumn("batch_id", F.lit("b0")).limit(0))
    keys.write_keys(first, root, "b1")
    keys.compact_index(spark, root)
    retitled = F.when(F.col("k") % 14 == 3, F.concat("title", F.lit(" II"))).otherwise(F.col("title"))
    second = dedup.first_wins(jobs.withColumn("title", retitled))
    inserts, known = keys.split_by_index(second, keys.read_index(spark, root, without_batch="b2"))
    both = inserts.withColumn("state", F.lit("new")).unionByName(known.withColumn("state", F.lit("known")))
    return both.select("external_id", "canonical_hash", "state")


@query
def constraint_violations(spark, sf_dir):
    jobs, k = views.jobs(spark, sf_dir), F.col("k")
    broken = jobs.withColumns(
        {
            "company": F.when(k % 50 != 7, F.col("company")),
            "salary_currency": F.when(k % 60 == 5, "US Dollar").otherwise("USD"),
            "external_id": F.when(k % 100 == 1, "o_0").otherwise(F.col("external_id")),
        }
    )
    columns = {"id", *constraints.REQUIRED, *constraints.MAX_LENGTH}
    stored = _stored(broken.select(*[c for c in broken.columns if c in columns]))
    return constraints.check_jobs(stored, views.alerts(spark, sf_dir))


# External parser


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return parsing.chunk(docs, "doc_id", buckets=REQUEST_BUCKETS)


@query
def parse_cache_split(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    d = F.col("doc_id")
    entry = F.when(d % 5 == 0, "[]").when(d % 5 == 1, "oops").otherwise(F.concat(F.lit('[{"title":"t'), d.cast("string"), F.lit('"}]')))
    first = docs.where(d % 3 == 0).groupBy(parsing.cache_key("raw_text").alias("key")).agg(F.min("doc_id").alias("doc_id"))
    days = F.make_dt_interval(days=(d % 10).cast("int"))
    cache = first.select(
        "key", entry.alias("payload"), (F.lit("2024-01-25").cast("timestamp") + days).alias("expires_at")
    )
    split = parsing.split_by_cache(docs, cache, EVENTS_AS_OF)
    return split.select("doc_id", "cache_hit", "payload")


@query
def chunk_requests(spark, sf_dir):
    requests = parsing.parse_requests(_chunked(spark, sf_dir))
    return requests.select("bucket", "batch_no", "n_texts", F.md5("request").alias("request_md5"))


@query
def align_results(spark, sf_dir):
    chunked = _chunked(spark, sf_dir).drop("raw_text")
    item = F.concat(F.lit('{"title":"d'), F.col("doc_id").cast("string"), F.lit('"}'))
    answered = chunked.where("pos < 18").withColumn("item", item)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda e: e["item"])
    listed = answered.groupBy("bucket", "batch_no").agg(listed.alias("items"))
    response = F.when(F.col("batch_no") % 4 == 1, F.get("items", F.lit(0))).otherwise(
        F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    )
    responses = listed.select("bucket", "batch_no", response.alias("response"))
    return parsing.align_results(chunked, responses).select("doc_id", "payload")


@query
def ingest_with_cache(spark, sf_dir):
    """Two batches: documents of even id, then all of them and the answers to the first; what is stored, and what waits."""
    root = scratch_dir(spark, "ingest")
    tables.create_tables(spark, root)
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    named = {"external_id": key, "title": F.concat(F.lit("doc "), key), "company": F.col("lang"), "location": F.lit("")}
    rest = {"url": F.lit(""), "raw_text": F.col("text"), "updated_at": F.lit(None).cast("string"), "source_name": F.col("source"), "source_tier": F.lit(2)}
    docs = views.table(spark, sf_dir, "documents")
    raw = docs.select("doc_id", *[c.alias(n) for n, c in (named | rest).items()])
    nobody = spark.createDataFrame([], "company_key string")
    none = spark.createDataFrame([], "request_batch string, bucket long, batch_no long, response string")
    queue.ingest_with_cache(spark, root, raw.where("doc_id % 2 = 0").drop("doc_id"), none, nobody, EVENTS_AS_OF, "first")

    asked = tables.read_table(spark, root, "parse_requests")
    answer = F.concat(F.lit('{"years_of_experience":'), F.length("raw_text").cast("string"), F.lit("}"))
    listed = F.array_sort(F.collect_list(F.struct("pos", answer.alias("a"))))
    answers = asked.groupBy(F.col("batch_id").alias("request_batch"), "bucket", "batch_no").agg(
        F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["a"]), ","), F.lit("]")).alias("response")
    )
    later = EVENTS_AS_OF + timedelta(hours=1)
    queue.ingest_with_cache(spark, root, raw.drop("doc_id"), answers, nobody, later, "second")
    jobs = tables.read_table(spark, root, "jobs").select(
        "external_id", "title", F.lit("stored").alias("state"), F.col("years_of_experience").cast("long").alias("answered")
    )
    waits = queue.waiting_postings(spark, root)
    waits = waits.select("external_id", "title", F.lit("waiting").alias("state"), F.lit(-1).cast("long").alias("answered"))
    return jobs.unionByName(waits)


# Sources


@query
def union_sources(spark, sf_dir):
    columns = ["external_id", "title", "company", "source_name", "source_tier"]
    mails = payloads.extract_mail_postings(
        views.table(spark, sf_dir, "pages"), link=r'href="(/[^"]+)"', title=r"<h1[^>]*>([^<]+)</h1>"
    )
    frames = [views.postings(spark, sf_dir), payloads.messages_to_raw(_messages(spark, sf_dir)), mails]
    return payloads.union_sources(*[f.select(*columns) for f in frames])


@query
def seed_registry(spark, sf_dir):
    n = F.col("n_nationkey") + 7
    listed = views.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src"), n.cast("string")).alias("name"), (1 + n % 2).cast("int").alias("tier"),
        F.concat(F.lit("https://feeds.example.com/"), n.cast("string")).alias("url"),
    )
    seeded = registry.seed_sources(views.sources(spark, sf_dir), listed)
    return seeded.select("name", "tier", "url", "consecutive_failures", "total_scraped", "is_stale")


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    return views.table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.when(p % 2 == 0, "feed").otherwise("sitemap").alias("kind"),
        F.when(p % 3 != 0, F.md5("html")).alias("etag"),
        F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("day "), (p % 20).cast("string"))).alias("last_modified"),
    )


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    rows = _landed(spark, sf_dir).groupBy("url").agg(F.min_by(F.struct("page_id", "etag", "last_modified"), "page_id").alias("r")).select("url", "r.*")
    return rows.where(p % 4 != 0).select(
        F.md5("url").alias("url_key"),
        F.when(p % 7 == 0, "old").otherwise(F.col("etag")).alias("etag"),
        F.when(p % 11 == 0, "old").otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(p % 13 == 0, "2024-01-29").otherwise("2024-01-31").cast("timestamp").alias("expires_at"),
    )


@query
def skip_unchanged(spark, sf_dir):
    changed = registry.skip_unchanged(_landed(spark, sf_dir), _manifest(spark, sf_dir), EVENTS_AS_OF)
    return changed.select("page_id", "kind", "url")


@query
def manifest_rows(spark, sf_dir):
    rows = registry.manifest_rows(_landed(spark, sf_dir), EVENTS_AS_OF)
    return rows.select("url_key", "etag", "last_modified", _time("expires_at"))


@query
def watchlist_join(spark, sf_dir):
    """Companies on a list that is itself a table: the customers in debt."""
    debtors = views.table(spark, sf_dir, "customer").where("c_acctbal < -900")
    listed = debtors.select(F.lower("c_name").alias("company_key")).distinct()
    rows = registry.flag_watchlist(views.postings(spark, sf_dir), listed)
    return rows.select("k", "on_watchlist")


# Counts and health


@query
def stats_overview(spark, sf_dir):
    return metrics.stats_overview(views.jobs(spark, sf_dir), AS_OF)


@query
def jobs_by_tier(spark, sf_dir):
    return metrics.jobs_by_tier(views.postings(spark, sf_dir))


@query
def health_6h(spark, sf_dir):
    return metrics.recent_by_tier(views.postings(spark, sf_dir), AS_OF)


@query
def health_text(spark, sf_dir):
    sources = views.sources(spark, sf_dir)
    return metrics.render_health(
        metrics.recent_by_tier(views.postings(spark, sf_dir), AS_OF),
        health.joined_names(sources.where("is_stale")),
        health.joined_names(health.failing_sources(sources)),
        AS_OF,
    )


@query
def scraped_by_source(spark, sf_dir):
    return metrics.scraped_by_source(views.postings(spark, sf_dir))


@query
def source_staleness(spark, sf_dir):
    stale = health.source_staleness(views.sources(spark, sf_dir), views.postings(spark, sf_dir), AS_OF)
    return stale.select("name", "tier", "recent_jobs", "is_stale")


@query
def stale_names(spark, sf_dir):
    stale = health.source_staleness(views.sources(spark, sf_dir), views.postings(spark, sf_dir), AS_OF)
    return health.joined_names(stale.where("is_stale"))


@query
def failing_sources(spark, sf_dir):
    failing = health.failing_sources(views.sources(spark, sf_dir))
    return failing.select("name", "tier", "consecutive_failures")


@query
def source_gauges(spark, sf_dir):
    return health.source_gauges(views.sources(spark, sf_dir))


@query
def source_listing(spark, sf_dir):
    log = views.outcomes(spark, sf_dir)
    return metrics.source_listing(health.update_source_stats(views.sources(spark, sf_dir), log))


@query
def failure_streak(spark, sf_dir):
    totals = health.outcome_totals(views.outcomes(spark, sf_dir))
    return totals.select("source", "streak", "scraped", "error_message", _micros("last_success_at"), _micros("last_failure_at"))


@query
def source_totals(spark, sf_dir):
    updated = health.update_source_stats(views.sources(spark, sf_dir), views.outcomes(spark, sf_dir))
    return updated.select("name", "tier", "consecutive_failures", "total_scraped", "is_stale", "error_message")


@query
def latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(views.table(spark, sf_dir, "events"), "value")


# Error log and expiring keys


@query
def error_fingerprint(spark, sf_dir):
    rows = views.errors(spark, sf_dir)
    digest = incidents.error_fingerprint(
        F.lit("ValueError"), F.when(F.col("event_id") % 4 != 0, F.col("props")), F.concat(F.lit("/app/u"), F.col("user_id").cast("string")),
        F.col("event_id") % 100,
    )
    return rows.select("event_id", digest.alias("error_hash"))


@query
def incident_records(spark, sf_dir):
    e = views.errors(spark, sf_dir)
    user = F.col("user_id").cast("string")
    log = e.select(
        F.concat(F.lit("worker"), user).alias("context"), "ts", F.lit("KeyError").alias("error_type"),
        F.col("props").alias("message"), F.lit("/app/main").alias("file"), F.lit(7).alias("line"),
        F.create_map(F.lit("user"), F.lit("?"), F.lit("props"), F.col("props")).alias("base"),
        F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("user"), user)).alias("explicit"), "event_id",
    )
    records = incidents.incident_records(log)
    pairs = F.array_sort(F.transform(F.map_entries("extra"), lambda p: F.concat_ws("=", p["key"], p["value"])))
    return records.select("incident_id", "error_hash", F.array_join(pairs, ";").alias("extra"))


@query
def error_cooldown(spark, sf_dir):
    rows = incidents.triggers(views.errors(spark, sf_dir), "user_id", "ts", "event_id", DAY)
    return rows.select("user_id", "event_id", _micros("ts"))


@query
def ttl_dedup_batch(spark, sf_dir):
    """Postings accepted with a 60-day block per posting hash."""
    rows = views.postings(spark, sf_dir).withColumn("key", dedup.can_key())
    kept = cooldown.accept_per_ttl(rows, "key", "ingested_at", "k", dedup.CAN_TTL_DAYS * DAY)
    return kept.select("key", "k", _time("ingested_at"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, because a stream takes a plain path for a folder and the table may be one file
    schema = views.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query
def ttl_dedup_stream(spark, sf_dir):
    out = scratch_dir(spark, "accepted")
    stream_dedup.dedup_stream(
        _event_stream(spark, sf_dir), "user_id", "ts", "event_id", DAY, out, scratch_dir(spark, "checkpoint")
    ).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_id", _micros("ts"))


@query
def rolling_counts_stream(spark, sf_dir):
    out = scratch_dir(spark, "counts")
    rolling = counts.rolling_counts(_event_stream(spark, sf_dir), "ts", ["event_type"])
    counts.write_complete(rolling, out, scratch_dir(spark, "checkpoint")).awaitTermination()
    latest = counts.latest_snapshot(rolling.schema, spark, out)
    return latest.select("event_type", _time("window_start"), _time("window_end"), "n")
