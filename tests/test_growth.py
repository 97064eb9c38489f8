"""What one task holds, and how often inputs are read, does not grow with the tables."""

from postsieve.operators import constraints
from postsieve.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_keys_are_counted_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(constraints, "ROWS_PER_TASK", 20)
    jobs = spark.range(100).selectExpr("cast(id as string) id", "cast(id % 90 as string) canonical_hash", "'same' external_id")
    alerts = spark.createDataFrame([("3",), ("gone",), ("gone",)], "job_id string")
    found = constraints.check_jobs(jobs, alerts)
    assert found.rdd.getNumPartitions() >= 15
    rows = {(r["rule"], r["column"], r["key"]): r["rows"] for r in found.collect()}
    assert rows[("unique", "external_id", "same")] == 100 and rows[("foreign key", "job_id", "gone")] == 2
    assert sum(k[1] == "canonical_hash" for k in rows) == 10 and len(rows) == 12


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_takes_first_rows_once(spark):
    assert "row_number" not in _plan(queries.QUERIES["upsert_jobs"](spark, SMALL))
