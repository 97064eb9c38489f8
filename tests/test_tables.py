from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postsieve.operators import dedup, health
from postsieve.operators.constraints import check_jobs
from postsieve.operators.topk import local_day_bounds, recent_jobs, render_digest
from postsieve.plans.alerts import alert_once
from postsieve.plans.ingest import ingest_batch
from postsieve.schemas import RAW_POSTING
from postsieve.sources.tables import create_tables, current_jobs, current_sources, read_table
from postsieve.streaming.ingest import ingest_stream, monitor_stream

NOW = datetime(2024, 3, 1, 12)


def raw(spark, *rows):
    """Raw postings from (external_id, title, company, tier, source, text)."""
    full = [(e, t, c, "Oslo", f"http://x/{e}", text, None, s, tier) for e, t, c, tier, s, text in rows]
    return spark.createDataFrame(full, RAW_POSTING)


FIRST = [
    ("g1", "Junior SOC Analyst", "Blue Whale", 1, "board", "$160k remote SIEM"),
    ("g2", "junior soc analyst", "blue whale", 1, "board", "copy of g1"),
    ("g3", "Senior Cook", "Acme", 2, "feed", "onsite"),
    ("g4", "Guard", "Okta", 3, "mail", "hybrid"),
    ("", "No Id", "Acme", 2, "feed", ""),
    ("", "No Id Either", "Acme", 2, "feed", ""),
]


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "tables")
    create_tables(spark, path)
    create_tables(spark, path)
    return path


def watch(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "company_key string")


def run(spark, root, rows, batch, now=NOW, **kw):
    ingest_batch(spark, root, raw(spark, *rows), watch(spark, "okta"), now, batch, **kw)


def stored(spark, root):
    return {r.external_id or r.title: r for r in current_jobs(spark, root).collect()}


def test_batch_and_its_repetition(spark, root):
    for _ in range(2):
        run(spark, root, FIRST, "b1")
        rows = stored(spark, root)
        assert set(rows) == {"g1", "g3", "g4", "No Id", "No Id Either"}
    assert (rows["g1"].score, rows["g1"].remote_policy, rows["g1"].salary_min) == (99, "remote", 160000)
    assert (rows["g3"].score, rows["g4"].score, rows["g4"].is_dream) == (5, 100, True)
    assert check_jobs(read_table(spark, root, "jobs"), read_table(spark, root, "alerts")).count() == 0
    kinds = {r.kind: r.entries for r in dedup.live_key_counts(read_table(spark, root, "seen_keys"), NOW).collect()}
    assert kinds == {"ext": 3, "can": 5}


def test_known_postings(spark, root):
    run(spark, root, FIRST, "b1")
    later = NOW + timedelta(days=40)
    # ids have expired after 30 days, hashes live for 60; after those only the table knows
    run(spark, root, FIRST, "b2", later)
    assert all(r.last_seen_at == NOW for r in stored(spark, root).values())
    much_later = NOW + timedelta(days=61)
    run(spark, root, FIRST + [("g9", "New", "Acme", 2, "feed", "")], "b3", much_later)
    rows = stored(spark, root)
    assert len(rows) == 6 and rows["g1"].last_seen_at == much_later and rows["g3"].last_seen_at == NOW
    sources = {r.name: r for r in current_sources(spark, root, much_later).collect()}
    assert (sources["feed"].total_scraped, sources["feed"].is_stale, sources["board"].is_stale) == (4, False, True)


def test_retitled_posting_is_the_stored_job(spark, root):
    run(spark, root, FIRST, "b1")
    later = NOW + timedelta(days=40)  # the id's mark has expired
    again = [("g1", "Lead SOC Analyst", "Blue Whale", 1, "board", "again"), ("g3", "Head Cook", "Acme", 2, "feed", ""), ("", "No Id III", "Acme", 2, "feed", "")]
    for _ in range(2):
        run(spark, root, again, "b2", later)
        rows = stored(spark, root)
        assert set(rows) == {"g1", "g3", "g4", "No Id", "No Id Either", "No Id III"}
    assert (rows["g1"].title, rows["g1"].last_seen_at, rows["g3"].last_seen_at) == ("Junior SOC Analyst", later, NOW)
    assert check_jobs(read_table(spark, root, "jobs"), read_table(spark, root, "alerts")).count() == 0


def test_parser_answers(spark, root):
    answers = spark.createDataFrame([("g1", '{"title": "Analyst", "salary_min": 1000}'), ("g3", "{bad")], "external_id string, payload string")
    run(spark, root, FIRST, "b1", payloads=answers)
    rows = stored(spark, root)
    assert (rows["g1"].title, rows["g1"].salary_min, rows["g3"].title) == ("Analyst", 1000, "Senior Cook")


def test_alerts_leave_the_queue(spark, root):
    run(spark, root, FIRST, "b1")
    first = alert_once(spark, root, NOW, "a1", ("telegram", "email"), n=1).collect()
    assert {r.channel for r in first} == {"telegram", "email"} and {r.score for r in first} == {100}
    again = alert_once(spark, root, NOW, "a1", ("telegram", "email"), n=1).collect()
    assert {r.job_id for r in again} == {r.job_id for r in first}
    assert {r.score for r in alert_once(spark, root, NOW, "a2").collect()} == {99}
    assert alert_once(spark, root, NOW, "a3").count() == 0


def test_stream(spark, tmp_path):
    root, land, names = str(tmp_path / "t"), str(tmp_path / "land"), tmp_path / "names.yaml"
    names.write_text("- Okta\n")

    def poll(rows, at):
        raw(spark, *rows).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(RAW_POSTING).parquet(land)
        ingest_stream(
            stream, root, str(names), str(tmp_path / "mark"), clock=lambda: at, alert_channels=("telegram",)
        ).awaitTermination()

    poll(FIRST, NOW)
    names.write_text("- Acme\n")  # read again by the next batch
    poll(FIRST[:1] + [("n1", "Chef", "ACME", 2, "feed", "")], NOW + timedelta(hours=30))
    rows = stored(spark, root)
    assert len(rows) == 6 and rows["n1"].score == 100
    assert read_table(spark, root, "alerts").count() == 3

    seen = []
    ticks = spark.readStream.schema(RAW_POSTING).parquet(land)
    monitor_stream(
        ticks, root, lambda s, i: seen.extend(s.collect()), str(tmp_path / "mark2"), lambda: NOW + timedelta(hours=31)
    ).awaitTermination()
    assert {r.name: r.is_stale for r in seen} == {"board": True, "mail": True, "feed": False}


def test_older_files_lack_columns(spark, root):
    run(spark, root, FIRST, "b1")
    old = read_table(spark, root, "jobs").drop("salary_min", "years_of_experience", "batch_id")
    old.withColumn("external_id", F.concat(F.lit("old_"), "external_id")).write.partitionBy("ingest_day").parquet(f"{root}/jobs/batch_id=b0")
    rows = read_table(spark, root, "jobs").where("batch_id = 'b0'")
    assert rows.count() == 5 and rows.where("salary_min is not null").count() == 0


def test_hot_hash_and_ids(spark):
    """A third of the rows are one posting, many ids are blank: nothing is lost or kept twice."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("title"),
        F.lit("c").alias("company"), F.lit("l").alias("location"), F.lit(1).alias("source_tier"),
        F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("e"), "id")).alias("external_id"),
        F.lit("u").alias("url"), F.lit("r").alias("raw_text"), F.timestamp_seconds("id").alias("ingested_at"), "id",
    )
    state = dedup.key_marks(rows.where("id in (1, 5)"), NOW)
    new = dedup.new_rows(rows, state, NOW).collect()
    titles = {r.title for r in rows.select("title").distinct().collect()} - {"t1", "t5"}
    assert {r.title for r in new} == titles and len(new) == len(titles)
    assert min(r.id for r in new if r.title == "same") == 0
    compat = dedup.drop_seen_hashes(rows.withColumn("title", F.lit("")), state, NOW)
    assert compat.count() == 3000


def test_strict_compat_blocks_blank_titles(spark):
    row = raw(spark, ("a", "", "Site", 2, "s", "x"), ("b", "", "Site", 2, "s", "y"))
    state = dedup.key_marks(row.where("external_id = 'a'"), NOW, strict_compat=True)
    assert dedup.drop_seen(row, state, NOW, strict_compat=True).count() == 0
    assert dedup.drop_seen(row, state, NOW).count() == 1


def test_failure_streaks(spark):
    log = [("a", True), ("a", False), ("a", False), ("b", False), ("c", False), ("c", True)]
    rows = [(s, 1, NOW + timedelta(minutes=i), ok, 2, None if ok else f"m{i}") for i, (s, ok) in enumerate(log)]
    frame = spark.createDataFrame(rows, "source string, tier int, ts timestamp, ok boolean, n_jobs long, message string")
    totals = {r.source: (r.streak, r.scraped, r.error_message) for r in health.outcome_totals(frame).collect()}
    assert totals == {"a": (2, 2, "m2"), "b": (1, 0, "m3"), "c": (0, 2, None)}


def test_bounds_are_checked(spark):
    jobs = spark.createDataFrame([], "id string, score int, ingested_at timestamp, remote_policy string")
    for wrong in ({"limit": 0}, {"limit": 101}, {"hours": 169}, {"min_score": -1}):
        with pytest.raises(ValueError):
            recent_jobs(jobs, NOW, **wrong)


def test_local_day():
    assert local_day_bounds(datetime(2024, 1, 1, 18, 29)) == (datetime(2023, 12, 31, 18, 30), datetime(2024, 1, 1, 18, 30))
    assert local_day_bounds(datetime(2024, 1, 1, 18, 30))[0] == datetime(2024, 1, 1, 18, 30)


def test_empty_digest(spark):
    top = spark.createDataFrame([], "id string, company string, title string, score int, url string, ingested_at timestamp")
    none = spark.createDataFrame([(0, 0)], "matches long, remainder long")
    assert render_digest(top, none, NOW).count() == 0
