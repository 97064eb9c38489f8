"""Around the external parser: requests, results, cache, validation and fallback."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.extract import with_hints
from postsieve.functions.normalize import (
    normalize_certs,
    normalize_currency,
    normalize_remote,
    normalize_tech,
)
from postsieve.functions.text import blank, computed_once, cut

BATCH_SIZE = 20  # postings per request


def chunk(rows: DataFrame, order: str, buckets: int, size: int = BATCH_SIZE) -> DataFrame:
    """Number rows in batches of `size`: adds bucket, batch_no (in the bucket) and pos.

    Buckets are a hash of the unique `order` column, so they are even, and a row's bucket
    does not depend on other rows. Each is sorted by one task: a fixed number that suits
    the largest input keeps them small. Within a bucket the input order holds.
    """
    digest = F.conv(F.substring(F.md5(F.col(order).cast("string")), 1, 8), 16, 10).cast("long")
    w = Window.partitionBy("bucket").orderBy(order)
    n = F.row_number().over(w) - 1
    return (
        rows.withColumn("bucket", F.pmod(digest, F.lit(buckets)))
        .withColumn("_n", n)
        .withColumn("batch_no", F.floor(F.col("_n") / size).cast("long"))
        .withColumn("pos", (F.col("_n") % size).cast("long"))
        .drop("_n")
    )


def parse_requests(chunked: DataFrame, text: str = "raw_text", length: int | None = None) -> DataFrame:
    """One request per batch: the numbered texts, each cut if the parser takes only a `length`.

    A batch has at most `size` rows, so the list per group is bounded.
    """
    entry = F.concat(
        F.lit("=== JOB "), (F.col("pos") + 1).cast("string"), F.lit(" ===\n"),
        cut(blank(text), length), F.lit("\n\n"),
    )
    listed = F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"))))
    return chunked.groupBy("bucket", "batch_no").agg(
        F.count("*").alias("n_texts"), F.array_join(F.transform(listed, lambda e: e["entry"]), "").alias("request")
    )


def align_results(chunked: DataFrame, responses: DataFrame) -> DataFrame:
    """Give the i-th result of a response to the i-th row of its batch.

    `responses` has (bucket, batch_no, response); a response that is no list counts as
    a list of one, a missing result is an empty object.
    """
    listed = F.from_json("response", "array<variant>")
    single = F.array(F.try_parse_json("response"))
    is_list = F.substring(F.ltrim("response"), 1, 1) == "["
    results = responses.select(
        "bucket", "batch_no", F.posexplode(F.when(is_list, listed).otherwise(single)).alias("pos", "result")
    )
    results = results.withColumn("pos", F.col("pos").cast("long")).withColumn("payload", F.to_json("result"))
    joined = chunked.join(results.drop("result"), ["bucket", "batch_no", "pos"], "left")
    return joined.withColumn("payload", F.coalesce("payload", F.lit("{}")))


def cache_key(text: Column | str) -> Column:
    return F.sha2(blank(text), 256)


def split_by_cache(
    rows: DataFrame, cache: DataFrame, as_of: datetime, text: str = "raw_text", key: str | None = None
) -> DataFrame:
    """Rows with the cached payload (NULL for a miss) and `cache_hit`; with `key` the text's key stays under that name, and
    joins and groupings by it find the rows where this lookup dealt them.

    `cache` has (key, payload, expires_at), one row per key. An expired entry, one that
    is no JSON list or an empty one is a miss.
    """
    element = F.get(F.from_json("payload", "array<variant>"), F.lit(0))
    live = cache.where(F.col("expires_at") > F.lit(as_of)).select(
        F.col("key").alias("_key"), F.to_json(element).alias("payload")
    )
    joined = rows.withColumn("_key", cache_key(text)).join(live, "_key", "left")
    joined = joined.withColumnRenamed("_key", key) if key else joined.drop("_key")
    return joined.withColumn("cache_hit", F.col("payload").isNotNull())


# Expected fields of a parsed object and the kind of value each takes.
_FIELDS = {
    "title": "text",
    "company": "text",
    "location": "text",
    "salary_min": "amount",
    "salary_max": "amount",
    "currency": "text",
    "salary_period": "optional text",
    "compensation": "object",
    "tech_stack": "texts",
    "certifications_required": "texts",
    "certifications_preferred": "texts",
    "remote_policy": "text",
    "years_of_experience": "number",
}
_SILENT = ["null", '""', "0", "0.0", "false", "[]", "{}"]
_INTEGRAL = r"\A\s*[+-]?\d+(\.0*)?\s*\z"


def _read_field(value: Column, expected: str) -> tuple[Column, Column]:
    """Typed value and whether the JSON value is acceptable for it.

    A missing field takes its default; an explicit null is an error in a text, list or
    object field.
    """
    kind = F.schema_of_variant(value)
    missing = value.isNull()
    absent = missing | (kind == "VOID")
    text = F.try_variant_get(value, "$", "string")
    if expected == "text":
        return F.coalesce(text, F.lit("")), missing | (kind == "STRING")
    if expected == "optional text":
        return text, absent | (kind == "STRING")
    if expected == "object":
        empty = F.create_map().cast("map<string,string>")
        return F.coalesce(F.try_variant_get(value, "$", "map<string,string>"), empty), missing | kind.startswith("OBJECT")
    if expected == "texts":
        items = F.try_variant_get(value, "$", "array<string>")
        # an empty list and a list of nulls are both ARRAY<VOID>
        typed = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull())
        return F.coalesce(items, F.array().cast("array<string>")), missing | typed
    whole = F.regexp_replace(F.trim(text), r"\.0*$", "").try_cast("int")
    flag = F.when(text == "true", 1).when(text == "false", 0)
    value = text.try_cast("double")
    spelled = F.when(value == F.floor(value), text.try_cast("decimal(38,18)").try_cast("int"))  # 1e8
    number = F.when(kind == "BOOLEAN", flag).when(text.rlike(_INTEGRAL), whole).when(kind == "DOUBLE", spelled)
    good = number >= 0 if expected == "amount" else number.isNotNull()
    return number, absent | good


def _decoded(rows: DataFrame, payload: str) -> DataFrame:
    """Adds the JSON object in _d, decoded once, into variants."""
    schema = ", ".join(f"{name} variant" for name in _FIELDS) + ", _corrupt string"
    decoded = F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return computed_once(rows.withColumn("_d", decoded), "_d")


def _read_fields(payload: str, hints: str | None) -> tuple[dict[str, Column], Column]:
    """Typed values of the fields in _d, filled by hints, and whether all are acceptable."""
    hinted = {"salary_min", "salary_max", "remote_policy", "tech_stack"} if hints else set()
    ok = F.col("_d._corrupt").isNull() & (F.substring(F.ltrim(payload), 1, 1) == "{")
    values = {}
    for name, expected in _FIELDS.items():
        raw = F.col(f"_d.{name}")
        value, good = _read_field(raw, expected)
        if name in hinted:
            hint = F.col(f"{hints}.{name}")
            says = F.size(hint) > 0 if expected == "texts" else blank(hint.cast("string")).isin("", "0") == F.lit(False)
            fills = (raw.isNull() | F.to_json(raw).isin(_SILENT)) & F.coalesce(says, F.lit(False))
            value, good = F.when(fills, hint).otherwise(value), fills | good
        values[name] = value
        ok = ok & F.coalesce(good, F.lit(False))
    return values, F.coalesce(ok, F.lit(False))


def _with_parsed(checked: DataFrame, payload: str, hints: str | None) -> DataFrame:
    """Adds `parsed` to rows with _d and is_valid, and drops _d. Only valid rows are read and normalized."""
    values, _ = _read_fields(payload, hints)
    values["remote_policy"] = normalize_remote(values["remote_policy"])
    values["currency"] = normalize_currency(values["currency"])
    values["tech_stack"] = normalize_tech(values["tech_stack"])
    for name in ("certifications_required", "certifications_preferred"):
        values[name] = normalize_certs(values[name])
    parsed = F.when(F.col("is_valid"), F.struct(*[c.alias(n) for n, c in values.items()]))
    return computed_once(checked.withColumn("parsed", parsed).drop("_d"), "parsed")


def validate_parsed(rows: DataFrame, payload: str = "payload", hints: str | None = None) -> DataFrame:
    """Adds `parsed` (a PARSED_POSTING struct, NULL if invalid) and `is_valid`.

    The JSON object is decoded once, into variants. With a `hints` column a hint first
    fills each of its fields in which the object is silent (missing, null, empty, zero);
    the word "unknown" is an answer and stays.
    """
    _, ok = _read_fields(payload, hints)
    checked = computed_once(_decoded(rows, payload).withColumn("is_valid", ok), "is_valid")
    return _with_parsed(checked, payload, hints)


def fallback_parse(checked: DataFrame, hints: str = "hints") -> DataFrame:
    """Rebuild `parsed` of invalid rows from the raw title and company and the hints."""
    h = lambda name: F.col(f"{hints}.{name}")
    none = F.array().cast("array<string>")
    rebuilt = F.struct(
        blank("title").alias("title"),
        blank("company").alias("company"),
        F.lit("").alias("location"),
        h("salary_min").alias("salary_min"),
        h("salary_max").alias("salary_max"),
        F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("salary_period"),
        F.create_map().cast("map<string,string>").alias("compensation"),
        normalize_tech(h("tech_stack")).alias("tech_stack"),
        none.alias("certifications_required"),
        none.alias("certifications_preferred"),
        normalize_remote(h("remote_policy")).alias("remote_policy"),
        F.lit(None).cast("int").alias("years_of_experience"),
    )
    return checked.withColumn("parsed", F.when(F.col("is_valid"), F.col("parsed")).otherwise(rebuilt))


def parse_postings(rows: DataFrame, payload: str = "payload", text: str = "raw_text") -> DataFrame:
    """Hints, validation and fallback in one map-only step.

    An object that is acceptable by itself is so with any hints. That is told first, so that a filter for invalid rows
    reaches below the search for hints.
    """
    _, alone = _read_fields(payload, None)
    checked = computed_once(_decoded(rows, payload).withColumn("_alone", alone), "_alone")
    checked = with_hints(checked, text)
    _, ok = _read_fields(payload, "hints")
    checked = computed_once(checked.withColumn("_hinted", F.when(F.col("_alone"), F.lit(True)).otherwise(ok)), "_hinted")
    checked = checked.withColumn("is_valid", F.col("_alone") | F.col("_hinted"))
    return fallback_parse(_with_parsed(checked, payload, "hints").drop("_alone", "_hinted"))
