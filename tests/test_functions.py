import hashlib

import pytest
from pyspark.sql import functions as F

from postsieve.functions import extract, normalize, render, scoring, text


def one(spark, column, **values):
    names = list(values) or ["x"]
    types = {str: "string", int: "int", list: "array<string>"}
    schema = ", ".join(f"{n} {types.get(type(v), 'string')}" for n, v in values.items()) or "x string"
    row = tuple(values.values()) or (None,)
    assert names
    return spark.createDataFrame([row], schema).select(column).first()[0]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


class TestKeys:
    def test_hash_ignores_case_and_outer_space(self, spark):
        h = text.dedup_hash("t", "c", "l")
        a = one(spark, h, t="Cloud Guard ", c=" ACME", l="Oslo\n")
        assert a == one(spark, h, t="cloud guard", c="acme", l="oslo") == sha("cloud guard|acme|oslo")
        assert len(a) == 64

    def test_hash_differs_by_title(self, spark):
        h = text.dedup_hash("t", "c", "l")
        assert one(spark, h, t="a", c="x", l="y") != one(spark, h, t="b", c="x", l="y")

    def test_canonical_hash_keeps_space(self, spark):
        assert one(spark, text.canonical_hash("t", "c", "l"), t="A ", c="B", l=None) == sha("a |b|")

    def test_surrogate_id(self, spark):
        expected = "rss_" + hashlib.md5(b"http://x").hexdigest()[:16]
        assert one(spark, text.surrogate_id("rss", "u"), u="http://x") == expected


class TestNames:
    @pytest.mark.parametrize("slug", ["palo-alto", "3d-systems", "o'neil-2go", "ÉCOLE-b", "x"])
    def test_slug_like_title_case(self, spark, slug):
        assert one(spark, text.company_from_slug("s"), s=slug) == slug.replace("-", " ").title()

    @pytest.mark.parametrize(
        "title, name, company",
        [
            ("Cook at night at  Diner ", "Cook at night", "Diner"),
            ("Cook ", "Cook ", ""),
            ("Cook\nlate at A\nB", "Cook\nlate", "A\nB"),
        ],
    )
    def test_split_at_last(self, spark, title, name, company):
        pair = F.struct(*[c.alias(n) for c, n in zip(text.split_title_company("t"), "ab")])
        assert tuple(one(spark, pair, t=title)) == (name, company)

    def test_subject(self, spark):
        html = "<p> \n</p>\n <b> Hello   there</b> \nmore"
        assert one(spark, text.subject_line("h"), h=html) == "Hello   there"
        assert one(spark, text.subject_line("h", "none"), h="<br> \n") == "none"
        assert len(one(spark, text.subject_line("h"), h="y" * 300)) == 300
        assert len(one(spark, text.subject_line("h", length=100), h="y" * 300)) == 100


class TestExtraction:
    @pytest.mark.parametrize(
        "raw, low, high",
        [
            ("Pay: $120,000 - $180,000 a year", 120000, 180000),
            ("we pay $120k - $160k", 120000, 160000),
            ("$95k to $110K", 95000, 110000),
            ("$95k – 110k", 95000, 110000),
            ("$50/hr", 50000, None),
            ("$, then $7", None, None),
            ("$99999999999", None, None),
            ("€70,000", None, None),
            ("", None, None),
            (None, None, None),
        ],
    )
    def test_salary(self, spark, raw, low, high):
        pair = F.struct(*[c.alias(n) for c, n in zip(extract.extract_salary("t"), "ab")])
        assert tuple(one(spark, pair, t=raw)) == (low, high)

    @pytest.mark.parametrize(
        "raw, phrase",
        [
            ("The team is FULLY remote.", "fully remote"),
            ("remote-first shop", "remote-first"),
            ("Éremote nothing", None),
            ("hybrid_x, In Office", "in office"),
            ("", None),
        ],
    )
    def test_policy(self, spark, raw, phrase):
        assert one(spark, extract.extract_remote_policy("t"), t=raw) == phrase

    def test_keywords_are_substrings(self, spark):
        rows = spark.createDataFrame([("Google uses AppSec",), ("Teamwork",), (None,)], "raw_text string")
        found = [r[0] for r in extract.with_keywords(rows).select("tech_stack").collect()]
        assert found == [["appsec", "go"], [], []]

    def test_keywords_as_words(self, spark):
        found = one(spark, extract.scan_keywords("t", word_boundary=True), t="google uses go and c++")
        assert found == ["c++", "go"]

    def test_hints(self, spark):
        rows = spark.createDataFrame([("Hybrid, $100k, Rust",)], "raw_text string")
        hints = extract.with_hints(rows).first()["hints"]
        assert tuple(hints) == (100000, None, "hybrid", ["rust"])

    @pytest.mark.parametrize(
        "raw, company, named",
        [
            ("Join us at Blue Whale, today!", "Blue Whale, today", True),
            ("mail me@home", "", True),
            ("COMPANY: xy", "xy", True),
            ("COMPANY: x", "", True),
            ("nothing", "", False),
        ],
    )
    def test_company(self, spark, raw, company, named):
        assert one(spark, extract.extract_company("t"), t=raw) == company
        assert one(spark, extract.has_company("t"), t=raw) is named

    @pytest.mark.parametrize("raw, hit", [("$5", True), ("80k usd", True), ("5 k", False), ("$x", False)])
    def test_has_salary(self, spark, raw, hit):
        assert one(spark, extract.has_salary("t"), t=raw) is hit

    def test_prefilter(self, spark):
        keep = extract.worth_parsing("t")
        assert one(spark, keep, t="We look for a cook and pay $90k now") is True
        assert one(spark, keep, t="pay $90k") is False
        assert one(spark, keep, t="We look for somebody who can cook") is False
        assert one(spark, keep, t=None) is False


class TestNormalizers:
    @pytest.mark.parametrize(
        "policy, expected",
        [
            ("Fully Remote", "remote"), ("Hybrid - 2 days", "hybrid"), ("remote or hybrid", "hybrid"),
            ("In-Office", "onsite"), ("in person", "onsite"), ("", "unknown"), (None, "unknown"),
        ],
    )
    def test_remote(self, spark, policy, expected):
        assert one(spark, normalize.normalize_remote("p"), p=policy) == expected

    def test_tech(self, spark):
        assert one(spark, normalize.normalize_tech("t"), t=["APPSEC", " Go ", "", "go", None]) == ["appsec", "go", "go"]

    def test_certs(self, spark):
        certs = one(spark, normalize.normalize_certs("c"), c=["sec+", " Security+", "", "Mine ", None])
        assert certs == ["CompTIA Security+", "Mine"]

    @pytest.mark.parametrize("raw, code", [("usd", "USD"), (" eur ", "EUR"), ("dollars", "USD"), ("", "USD"), (None, "USD")])
    def test_currency(self, spark, raw, code):
        assert one(spark, normalize.normalize_currency("c"), c=raw) == code


class TestScore:
    def score(self, spark, watch=(), **job):
        row = {
            "company": "Acme", "title": "", "remote_policy": None, "salary_min": None, "tech_stack": None,
            "years_of_experience": None,
        } | job
        schema = (
            "company string, title string, remote_policy string, salary_min int, tech_stack array<string>, "
            "years_of_experience int"
        )
        df = spark.createDataFrame([tuple(row.values())], schema)
        return df.select(scoring.score(scoring.watchlist_match("company", list(watch)))).first()[0]

    def test_watchlist(self, spark):
        assert self.score(spark, ["Okta"], company=" OKTA ") == 100
        assert self.score(spark, ["Okta"], company="Okta Inc") == 50

    def test_rules(self, spark):
        assert self.score(spark, remote_policy="remote", salary_min=160000, tech_stack=["AppSec"]) == 99
        assert self.score(spark, remote_policy="onsite", salary_min=0, tech_stack=[]) == 50
        assert self.score(spark, tech_stack=[None, "iam"], salary_min=100000, remote_policy="hybrid") == 74

    def test_title_factor(self, spark):
        assert self.score(spark, title="Senior Guard", remote_policy="remote", salary_min=160000) == 8
        assert self.score(spark, title="Junior Guard", years_of_experience=1) == 99

    def test_negative_scores_stay(self, spark):
        assert self.score(spark, title="Junior Guard", years_of_experience=5) == -60


class TestTexts:
    def test_salary(self, spark):
        shown = render.format_salary("a", "b", "c", "p")
        assert one(spark, shown, a=120000, b=1180000, c="EUR", p="YEARLY") == "💰 $120,000 – $1,180,000 EUR / yearly"
        assert one(spark, shown, a=90000, b=0, c="", p="") == "💰 $90,000 USD"
        assert one(spark, shown, a=0, b=5, c="", p="") == "💰 Not disclosed"

    def test_tech(self, spark):
        shown = render.format_tech("t", "c")
        assert one(spark, shown, t=list("abcdefghij"), c=["CEH"]) == "🔧 a · b · c · d · e · f · g · h · i · j\n📜 Req: CEH"
        first = render.format_tech("t", "c", most=8)
        assert one(spark, first, t=list("abcdefghij"), c=["CEH"]) == "🔧 a · b · c · d · e · f · g · h\n📜 Req: CEH"
        assert one(spark, shown, t=[], c=[]) == "🔧 Not specified"


def test_filters_pass_held_columns(spark, tmp_path):
    from postsieve.functions.extract import with_hints

    path = str(tmp_path / "lake")
    spark.range(4).selectExpr("cast(id as string) raw_text", "id % 2 p").write.partitionBy("p").parquet(path)
    rows = with_hints(spark.read.parquet(path))
    plan = rows.where("p = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    plan = rows.where("hints.salary_min > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(coalesce(raw_text") <= 2
