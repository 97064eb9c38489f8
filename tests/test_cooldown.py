import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsieve.operators import cooldown
from postsieve.operators.cooldown import _Segment, accept_per_ttl
from postsieve.streaming.dedup import dedup_stream

START = datetime(2024, 1, 1)


def brute(rows, ttl, blocked=None):
    until, kept, span = {}, [], timedelta(seconds=ttl)
    rows = [r for r in rows if not any(k == r[0] and u - span <= r[1] < u for k, u in (blocked or {}).items())]
    for key, ts, row_id in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in until or ts >= until[key]:
            kept.append((key, ts, row_id))
            until[key] = ts + timedelta(seconds=ttl)
    return sorted(kept)


def sample(seed, n=600):
    rnd = random.Random(seed)
    # one key holds a third of all rows, times repeat
    keys = ["hot"] * (n // 3) + [f"k{rnd.randrange(40)}" for _ in range(n - n // 3)]
    return [(k, START + timedelta(seconds=rnd.randrange(200_000) // 7 * 7), i) for i, k in enumerate(keys)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp, id long")


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("ttl, segment_ttls", [(21_000, 16), (21_000, 1), (3_000, 2), (500, 5), (70_000, 2)])
def test_equals_brute_force(spark, short_batches, ttl, segment_ttls):
    rows = sample(ttl)
    got = accept_per_ttl(frame(spark, rows).repartition(5), "key", "ts", "id", ttl, segment_ttls=segment_ttls)
    assert sorted(map(tuple, got.collect())) == brute(rows, ttl)


def test_large_ids_and_one_key_over_many_segments(spark):
    rows = [("a", ts, 2**60 + i) for _, ts, i in sample(5)]
    got = accept_per_ttl(frame(spark, rows), "key", "ts", "id", 900, segment_ttls=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 900)


def test_segment_tells_the_block_that_leaves_it():
    rnd = random.Random(11)
    for _ in range(300):
        ttl, ttls = rnd.randrange(1, 30), rnd.randrange(1, 6)
        t = sorted(rnd.randrange(ttl * ttls) for _ in range(rnd.randrange(1, 60)))
        falling, segment = np.array(t[::-1], np.int64), _Segment(ttl)
        for part in np.array_split(falling, rnd.randrange(1, min(4, len(t)) + 1)):
            segment.add(part)
        at, outcome = segment.pieces()
        for entry in range(ttl):
            until = entry
            for x in t:
                until = x + ttl if x >= until else until
            place = np.searchsorted(at, entry)
            assert (outcome[place] if place < len(at) else entry) == until


@pytest.mark.parametrize("segment_ttls", [16, 1])
def test_earlier_blocks_count(spark, segment_ttls):
    rows, ttl = sample(3), 40_000
    blocked = {"hot": START + timedelta(seconds=90_000), "k1": START}
    earlier = spark.createDataFrame(list(blocked.items()), "key string, blocked_until timestamp")
    got = accept_per_ttl(frame(spark, rows), "key", "ts", "id", ttl, earlier, segment_ttls)
    assert sorted(map(tuple, got.collect())) == brute(rows, ttl, blocked)


def test_late_rows_are_blocked_only_inside_of_a_block(spark):
    rows = [("a", START + timedelta(seconds=s), s) for s in (50, 99, 105, 110, 200)]
    earlier = spark.createDataFrame([("a", START + timedelta(seconds=110))], "key string, blocked_until timestamp")
    got = accept_per_ttl(frame(spark, rows), "key", "ts", "id", 10, earlier)
    assert sorted(r.id for r in got.collect()) == [50, 99, 110, 200]


def test_block_ends_at_ttl_and_is_not_extended(spark):
    rows = [("a", START + timedelta(seconds=s), s) for s in (0, 5, 9, 10, 19, 20)]
    got = accept_per_ttl(frame(spark, rows), "key", "ts", "id", 10)
    assert sorted(r.id for r in got.collect()) == [0, 10, 20]


@pytest.mark.parametrize("segment_ttls", [16, 2])
def test_stream_equals_batch(spark, tmp_path, segment_ttls):
    rows, ttl = sorted(sample(8), key=lambda r: r[1]), 30_000
    for i in range(4):
        part = frame(spark, rows[i * 150 : (i + 1) * 150]).coalesce(1)
        part.withColumn("part", F.lit(i)).drop("part").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, id long").option("maxFilesPerTrigger", 1)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # a second start finds nothing new
        dedup_stream(
            stream.parquet(str(tmp_path / "in")), "key", "ts", "id", ttl, out, mark, segment_ttls
        ).awaitTermination()
    got = spark.read.parquet(out).select("key", "ts", "id")
    assert sorted(map(tuple, got.collect())) == brute(rows, ttl)


def test_segments_of_a_batch_are_walked_together(spark):
    """Whole segments give what one gives that is taken in row by row, and both passes read one shuffle."""
    rnd = random.Random(3)
    ttl, span = 10, 160
    times = [sorted(rnd.randrange(s * span, (s + 1) * span) for _ in range(rnd.randrange(1, 60))) for s in range(-20, 60)]
    sizes = [len(t) for t in times]
    group, s = np.repeat(np.arange(len(times)), sizes), np.repeat(np.arange(-20, 60), sizes)
    rows, outcome = cooldown._whole_segments(group, np.concatenate(times), s, ttl, span)
    for i, t in enumerate(times):
        one = _Segment(ttl)
        one.add(np.array(t[::-1]))
        here, start = group[rows] == i, (i - 20) * span
        left = [(np.concatenate(times)[rows][here], outcome[here]), one.pieces()]
        # a block that enters ends within a TTL
        for entry in range(start, start + ttl):
            assert len({int(u[at]) if (at := np.searchsorted(x, entry)) < len(x) else None for x, u in left}) == 1
    sent = accept_per_ttl(frame(spark, sample(5)), "key", "ts", "id", 3600)
    sent.collect()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
