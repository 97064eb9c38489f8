from datetime import datetime

from postsieve.operators import parsing

T = "title string, company string, raw_text string, payload string"


def parse(spark, payload, raw_text="pays $120k - $160k, hybrid, go"):
    rows = spark.createDataFrame([("Raw title", "Raw company", raw_text, payload)], T)
    row = parsing.parse_postings(rows).first()
    return row["is_valid"], row["parsed"]


def test_defaults(spark):
    valid, p = parse(spark, "{}", "")
    assert valid and (p.remote_policy, p.currency, p.tech_stack, p.title) == ("unknown", "USD", [], "")


def test_hints_fill_silent_fields_only(spark):
    valid, p = parse(spark, '{"salary_min": 1e8, "title": "t"}')
    assert valid and p.salary_min == 100_000_000
    assert not parse(spark, '{"salary_min": 1.5e0}')[0]
    valid, p = parse(spark, '{"salary_min": 0, "salary_max": 200000, "remote_policy": "unknown", "tech_stack": []}')
    assert valid
    assert (p.salary_min, p.salary_max, p.remote_policy, p.tech_stack) == (120000, 200000, "unknown", ["go"])


def test_lenient_numbers(spark):
    rows = spark.createDataFrame([('{"salary_min": "120", "salary_max": 5.0, "years_of_experience": true}',)], "payload string")
    p = parsing.validate_parsed(rows).first()["parsed"]
    assert (p.salary_min, p.salary_max, p.years_of_experience) == (120, 5, 1)


def test_invalid_objects(spark):
    bad = [
        '{"title": null}', '{"title": 5}', '{"salary_max": -1}', '{"salary_min": "lots"}', '{"years_of_experience": 1.5}',
        '{"tech_stack": null}', '{"tech_stack": ["a", 1]}', '{"tech_stack": [null]}', '{"compensation": []}', "[1]", "{bad", None,
    ]
    rows = spark.createDataFrame([(b,) for b in bad], "payload string")
    assert [r.is_valid for r in parsing.validate_parsed(rows).collect()] == [False] * len(bad)


def test_fallback(spark):
    valid, p = parse(spark, '{"salary_min": -3, "title": "T"}')
    assert not valid
    assert (p.title, p.company, p.salary_min, p.remote_policy, p.tech_stack) == ("Raw title", "Raw company", 120000, "hybrid", ["go"])


def test_chunks_keep_every_row(spark):
    rows = spark.range(1, 1001).withColumnRenamed("id", "n")
    chunks = parsing.chunk(rows, "n", size=20, buckets=7).collect()
    assert len(chunks) == 1000 and {r.bucket for r in chunks} == set(range(7))
    batches = {}
    for r in chunks:
        batches.setdefault((r.bucket, r.batch_no), []).append((r.pos, r.n))
    assert all([p for p, _ in sorted(b)] == list(range(len(b))) and len(b) <= 20 for b in batches.values())
    assert all([n for _, n in sorted(b)] == sorted(n for _, n in b) for b in batches.values())


def test_cache(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "raw_text string")
    key = parsing.cache_key("raw_text")
    hits = {"a": ('[{"title":"x"}]', 2), "b": ("broken", 2), "c": ('[{"title":"y"}]', 1)}
    cache = spark.createDataFrame([(k, p, datetime(2024, 1, d)) for k, (p, d) in hits.items()], "raw_text string, payload string, expires_at timestamp")
    cache = cache.select(key.alias("key"), "payload", "expires_at")
    split = {r.raw_text: (r.cache_hit, r.payload) for r in parsing.split_by_cache(rows, cache, datetime(2024, 1, 1)).collect()}
    assert split == {"a": (True, '{"title":"x"}'), "b": (False, None), "c": (False, None), "d": (False, None)}


def test_hints_are_searched_only_where_they_count(spark):
    """A filter for invalid rows reaches below the search for hints, and changes no row."""
    payloads = ['{"title": "t"}', '{"title": 5}', '{"tech_stack": null}', '{"salary_min": -1}', "{bad", None, '{"salary_min": "lots"}', "{}"]
    rows = spark.createDataFrame([("Raw", "Co", "pays $120k, hybrid, go" if i % 2 else "", p) for i, p in enumerate(payloads)], T)
    split = parsing.parse_postings(rows)
    whole = parsing.fallback_parse(parsing.validate_parsed(parsing.with_hints(rows, "raw_text"), "payload", "hints"))
    columns = ["payload", "raw_text", "is_valid", "parsed"]
    assert sorted(map(str, split.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    plan = split.where("not is_valid").select("parsed")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("remote-first") :]
