import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_tables import FIRST, NOW, run, stored

from postsieve.operators.constraints import check_jobs
from postsieve.plans.alerts import alert_once, digest_once
from postsieve.sources import keys
from postsieve.sources.tables import create_tables, read_table, split_known

ROW = "canonical_hash string, external_id string, ingested_at timestamp"


@pytest.fixture
def root(spark, tmp_path):
    create_tables(spark, str(tmp_path))
    return str(tmp_path)


def test_split_equals_the_one_by_the_jobs_table(spark, root):
    draw = random.Random(2)
    at = datetime(2024, 1, 1)
    old = {f"h{draw.randrange(200)}": draw.choice(["", None, f"e{i}"]) for i in range(120)}
    ids = [f"e{i}" for i in range(160)]
    draw.shuffle(ids)
    new = {f"h{i}": draw.choice(["", None, ids[i % 160]]) for i in range(100, 260)}
    old, new = (spark.createDataFrame([(h, e, at) for h, e in x.items()], ROW) for x in (old, new))
    keys.create_index(spark, root, old.withColumn("batch_id", F.lit("b1")))
    for _ in range(2):
        got = keys.split_by_index(new, keys.read_index(spark, root))
        for mine, plain in zip(got, split_known(new, old)):
            assert sorted(mine.collect(), key=str) == sorted(plain.collect(), key=str)
        keys.compact_index(spark, root)
    assert keys.split_by_index(new, keys.read_index(spark, root, without_batch="b1"))[1].count() == 0
    assert keys.split_by_index(new.limit(0), keys.read_index(spark, root))[0].count() == 0


def test_batches_on_a_merged_index(spark, root):
    run(spark, root, FIRST, "b1")
    keys.compact_index(spark, root)
    run(spark, root, FIRST, "b1")  # once more: its own keys are merged, and still left out
    assert len(stored(spark, root)) == 5
    run(spark, root, [("g3", "Senior Chef", "Acme", 2, "feed", ""), ("g7", "New", "Acme", 2, "feed", "")], "b2")
    assert set(stored(spark, root)) == {"g1", "g3", "g4", "g7", "No Id", "No Id Either"}
    assert check_jobs(read_table(spark, root, "jobs"), read_table(spark, root, "alerts")).count() == 0


def test_jobs_stored_before_there_was_an_index(spark, root):
    run(spark, root, FIRST, "b1")
    other = f"{root}/moved"
    create_tables(spark, other)
    read_table(spark, root, "jobs").write.mode("append").partitionBy("batch_id", "ingest_day").parquet(f"{other}/jobs")
    run(spark, other, FIRST, "b2")
    assert read_table(spark, other, "jobs").count() == 5


def test_one_lookup_and_no_read_of_the_jobs(spark, root):
    run(spark, root, FIRST, "b1")
    new = spark.createDataFrame([("h", "e", NOW)], ROW)
    plan = keys.split_by_index(new, keys.read_index(spark, root))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("part#") > 0


def test_digested_jobs_are_not_alerted_again(spark, root):
    run(spark, root, FIRST, "b1")
    texts = [digest_once(spark, root, NOW, "a1", min_score=99).collect() for _ in range(2)]
    assert texts[0] == texts[1] and "Guard" in texts[0][0].digest and "Junior SOC Analyst" in texts[0][0].digest
    assert alert_once(spark, root, NOW, "a1", min_score=99).count() == 0
    assert digest_once(spark, root, NOW, "a2", min_score=99).count() == 0
    rows = read_table(spark, root, "alerts").collect()
    assert sorted((r.channel, r.score) for r in rows) == [("digest", 99), ("digest", 100)]


def test_keys_are_stored_as_digests_and_rows_dealt_once(spark, root):
    rows = spark.createDataFrame([(c * 64, f"e{c}", datetime(2024, 1, 1)) for c in "0123456789abcdef"], ROW)
    keys.write_keys(rows, root, "b1")
    keys.write_keys(rows, root, "b2")
    keys.compact_index(spark, root)
    index = keys.read_index(spark, root).collect()
    assert len(index) == 64 and {len(r["key"]) for r in index} == {16}
    assert sum(r["job_hash"] is not None for r in index) == 32
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        inserts, known = keys.split_by_index(rows, keys.read_index(spark, root))
        both = inserts.unionByName(known)
        assert both.count() == 16 and known.count() == 16
        both.collect()
        plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("ReusedExchange") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
