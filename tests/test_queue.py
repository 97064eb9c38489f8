"""Ingestion with requests that are answered in later batches."""

from datetime import datetime, timedelta

import pytest

from postsieve.operators.constraints import check_jobs
from postsieve.plans import queue
from postsieve.schemas import RAW_POSTING
from postsieve.sources.tables import create_tables, read_table

NOW = datetime(2024, 3, 1, 12)
ANSWER = "request_batch string, bucket long, batch_no long, response string"


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "tables")
    create_tables(spark, path)
    return path


def run(spark, root, rows, batch, answers=(), now=NOW):
    full = [(e, t, "Acme", "Oslo", "http://x", text, None, "board", tier) for e, t, tier, text in rows]
    watch = spark.createDataFrame([], "company_key string")
    raw, said = spark.createDataFrame(full, RAW_POSTING), spark.createDataFrame(list(answers), ANSWER)
    queue.ingest_with_cache(spark, root, raw, said, watch, now, batch, buckets=1)


def jobs(spark, root):
    return {r["title"]: (r["batch_id"], r["years_of_experience"]) for r in read_table(spark, root, "jobs").collect()}


def waiting(spark, root):
    return sorted(r["title"] for r in queue.waiting_postings(spark, root).collect())


def asked(spark, root):
    return {(r["request_batch"], r["bucket"], r["batch_no"]): r["n_texts"] for r in queue.open_requests(spark, root).collect()}


FIRST = [("1", "One", 1, "same text"), ("1", "One elsewhere", 2, "same text"), ("", "Two", 1, "other"), ("", "Three", 1, None)]


def answer_to(spark, root, request, years):
    """The response that gives each text of a request the years of `years`; texts that lack there have an empty object."""
    rows = read_table(spark, root, "parse_requests").where(f"batch_id = '{request[0]}' and batch_no = {request[2]}").orderBy("pos").collect()
    said = [f'{{"years_of_experience":{years[r["raw_text"]]}}}' if r["raw_text"] in years else "{}" for r in rows]
    return (*request, "[" + ",".join(said) + "]")


def test_answers_release_once(spark, root):
    for _ in range(2):  # a batch that runs again leaves the same rows
        run(spark, root, FIRST, "b1")
        assert jobs(spark, root) == {} and waiting(spark, root) == ["One", "One elsewhere", "Three", "Two"]
        assert asked(spark, root) == {("b1", 0, 0): 3}  # copies of a text are one request

    # while that waits: another posting of a text that is asked for, and a new text
    late = [("9", "Late", 1, "other"), ("8", "New", 1, "new")]
    run(spark, root, late, "b2")
    assert asked(spark, root) == {("b1", 0, 0): 3, ("b2", 0, 0): 1}

    good = answer_to(spark, root, ("b1", 0, 0), {"same text": 3, "other": 5})
    answers = [good, good, ("b1", 0, 7, "[]"), ("nobody", 0, 0, "[{}]"), ("b2", 0, 0, None)]
    more = [("7", "Cached", 1, "same text")]
    for _ in range(2):
        run(spark, root, more, "b3", answers, NOW + timedelta(hours=1))
        expected = {"Two": ("b3", 5), "Three": ("b3", None), "Late": ("b3", 5), "Cached": ("b3", 3)}
        got = jobs(spark, root)
        one = {t: got.pop(t) for t in ("One", "One elsewhere") if t in got}  # one external id, one job
        assert got == expected and list(one.values()) == [("b3", 3)]
        assert waiting(spark, root) == ["New"] and asked(spark, root) == {("b2", 0, 0): 1}

    # the same answer again, and one that comes too late to change anything
    other = answer_to(spark, root, ("b1", 0, 0), {"same text": 30, "other": 50})
    run(spark, root, [], "b4", [good, other], NOW + timedelta(hours=2))
    assert read_table(spark, root, "parse_answers").where("batch_id = 'b4'").count() == 0
    assert len(jobs(spark, root)) == 5

    run(spark, root, [("6", "Again", 1, "other")], "b5", [answer_to(spark, root, ("b2", 0, 0), {"new": 8})], NOW + timedelta(hours=3))
    got = jobs(spark, root)
    assert got["New"] == ("b5", 8) and got["Again"] == ("b5", 5) and waiting(spark, root) == []
    assert check_jobs(read_table(spark, root, "jobs"), read_table(spark, root, "alerts")).count() == 0


def test_expired_entry_is_asked_again(spark, root):
    run(spark, root, [("1", "One", 1, "text")], "b1")
    run(spark, root, [], "b2", [answer_to(spark, root, ("b1", 0, 0), {"text": 2})])
    run(spark, root, [("2", "Two", 1, "text")], "b3", now=NOW + queue.CACHE_TTL)
    assert asked(spark, root) == {("b3", 0, 0): 1} and waiting(spark, root) == ["Two"]
    run(spark, root, [], "b4", [answer_to(spark, root, ("b3", 0, 0), {"text": 4})], NOW + queue.CACHE_TTL)
    assert jobs(spark, root) == {"One": ("b2", 2), "Two": ("b4", 4)}


def test_texts_are_dealt_once_for_their_requests(spark, root, monkeypatch):
    """The plan of a batch's requests shuffles texts by key only; their numbers come from keys."""
    plans = {}
    write = queue.write_batch

    def seen(rows, root, name, batch_id):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        write(rows, root, name, batch_id)

    monkeypatch.setattr(queue, "write_batch", seen)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run(spark, root, FIRST, "b1")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert asked(spark, root) == {("b1", 0, 0): 3}
    nodes = plans["parse_requests"].splitlines()
    aggregates = [i for i, line in enumerate(nodes) if "first(raw_text" in line and "partial" not in line]
    assert aggregates and not any("Exchange" in line for line in nodes[: aggregates[0]])


def test_a_later_row_of_an_id_is_no_job(spark, root):
    answers = []
    for batch in ("b1", "b2"):
        run(spark, root, [("1", "One", 1, "x"), ("1", "Other", 1, "x"), ("2", "Two", 1, "x"), ("", "Three", 1, "x"), ("", "Four", 1, "x")], batch, answers)
        answers = [answer_to(spark, root, r, {"x": 5}) for r in asked(spark, root)]
    titles = jobs(spark, root)
    assert len(titles) == 4 and {"Two", "Three", "Four"} < set(titles)
