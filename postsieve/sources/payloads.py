"""Readers of landed payloads, all projecting onto RAW_POSTING."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.extract import extract_company, worth_parsing
from postsieve.functions.text import (
    blank,
    company_from_slug,
    compose_text,
    cut,
    split_title_company,
    strip,
    strip_tags,
    surrogate_id,
)
from postsieve.operators.dedup import first_per
from postsieve.schemas import RAW_POSTING

# What job mails look like, and how many messages of a channel are polled.
MAIL_LINK = r'href="(https://www\.linkedin\.com/jobs/view/[^"]+)"'
MAIL_TITLE = r"<h3[^>]*>([^<]+)</h3>"
MAIL_COMPANY = r"<h4[^>]*>([^<]+)</h4>"
MESSAGES_PER_CHANNEL = 50

# Markup: tags whose end may be left out, and how deep a tag may contain itself.
ENDS_ITSELF = {"p", "dt", "dd", "option"}
NESTING = 24


def _raw(rows: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Select `keep` and the raw schema; fields not given are NULL."""
    cols = [F.col(k) for k in keep]
    for field in RAW_POSTING.fields:
        value = columns.get(field.name, F.lit(None))
        cols.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*cols)


def _slug_column(slug: str | None) -> Column:
    """The given name, or the `slug` folder of the path (slug=<name>/...)."""
    return F.col("slug") if slug is None else F.lit(slug)


def read_board_json(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """Boards that answer {"jobs": [...]}; `location` is an object with a name or a scalar."""
    job = (
        "id variant, title string, absolute_url string, location variant, content string, updated_at string"
    )
    schema = f"jobs array<struct<{job}>>" + (", slug string" if slug is None else "")
    rows = spark.read.schema(schema).json(path, multiLine=True)
    rows = rows.select(_slug_column(slug).alias("slug"), F.explode("jobs").alias("j"))
    loc = F.col("j.location")
    is_object = F.coalesce(F.schema_of_variant(loc).startswith("OBJECT"), F.lit(False))
    place = F.when(is_object, F.try_variant_get(loc, "$.name", "string")).otherwise(
        F.try_variant_get(loc, "$", "string")
    )
    return _raw(
        rows.withColumn("place", blank(place)),
        external_id=F.concat(F.lit("gh_"), blank(F.try_variant_get("j.id", "$", "string"))),
        title=blank("j.title"),
        company=company_from_slug("slug"),
        location=F.col("place"),
        url=blank("j.absolute_url"),
        raw_text=compose_text("j.title", "place", "j.content"),
        updated_at=F.col("j.updated_at"),
        source_name=F.lit("greenhouse"),
        source_tier=F.lit(1),
    )


def read_postings_json(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """Boards that answer a flat list of postings."""
    schema = (
        "id string, text string, hostedUrl string, categories struct<location string>, descriptionPlain string"
        + (", slug string" if slug is None else "")
    )
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return _raw(
        rows,
        external_id=F.concat(F.lit("lv_"), blank("id")),
        title=blank("text"),
        company=company_from_slug(_slug_column(slug)),
        location=blank("categories.location"),
        url=blank("hostedUrl"),
        raw_text=compose_text("text", "categories.location", "descriptionPlain"),
        source_name=F.lit("lever"),
        source_tier=F.lit(1),
    )


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def read_feed_xml(spark: SparkSession, path: str, name: str, text_length: int | None = None) -> DataFrame:
    """Feed items; the company follows the last " at " of the title."""
    schema = "title string, link string, location string, description string, `content:encoded` string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    title, company = split_title_company("title")
    split = items.withColumns({"_title": title, "_company": company})
    return _raw(
        split,
        external_id=surrogate_id("rss", "link"),
        title=F.col("_title"),
        company=F.col("_company"),
        location=blank("location"),
        url=blank("link"),
        raw_text=compose_text("_title", "_company", "location", "description", "`content:encoded`", length=text_length),
        source_name=F.lit(name),
        source_tier=F.lit(2),
    )


def read_sitemap_xml(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Every non-empty location of page lists and of lists of lists."""
    locs = [
        spark.read.format("xml").option("rowTag", tag).schema("loc string").load(path)
        for tag in ("url", "sitemap")
    ]
    rows = locs[0].unionByName(locs[1]).where(blank("loc") != "")
    return _raw(
        rows,
        external_id=surrogate_id("sm", "loc"),
        title=F.lit(""),
        company=F.lit(name),
        location=F.lit(""),
        url=F.col("loc"),
        raw_text=F.col("loc"),
        source_name=F.lit(name),
        source_tier=F.lit(2),
    )


def extract_mail_postings(
    mails: DataFrame,
    html: str = "html",
    link: str = MAIL_LINK,
    title: str = MAIL_TITLE,
    company: str = MAIL_COMPANY,
    name: str = "linkedin_imap",
    keep: tuple[str, ...] = (),
    limit: int | None = None,
    body_length: int | None = None,
) -> DataFrame:
    """The links of each mail with the title and company at the same position.

    Columns in `keep` are carried along in front. `limit` reads the first links of a mail only, `body_length` cuts
    the mail's part of the text.
    """

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))

    found = mails.where(blank(html) != "").select(
        *keep,
        cut(html, body_length).alias("body"),
        _first(all_of(title), limit).alias("titles"),
        _first(all_of(company), limit).alias("companies"),
        _first(all_of(link), limit).alias("links"),
    )
    rows = found.select("*", F.posexplode("links").alias("pos", "link")).withColumns(
        {"t": blank(F.get("titles", F.col("pos"))), "c": blank(F.get("companies", F.col("pos")))}
    )
    return _raw(
        rows,
        keep,
        external_id=surrogate_id("li", "link"),
        title=strip("t"),
        company=strip("c"),
        location=F.lit(""),
        url=F.col("link"),
        raw_text=compose_text("t", "c", "body"),
        source_name=F.lit(name),
        source_tier=F.lit(3),
    )


def latest_per(rows: DataFrame, box: str, order: str, n: int) -> DataFrame:
    """The newest `n` rows of every mailbox or channel."""
    return first_per(rows, [box], [F.desc(order)], n)


def _element(selector: str) -> str:
    """Pattern of an element for a selector `tag`, `.class` or `tag.class`; group 1 is
    the tag, group 2 the inside.

    Inside of the element, elements of the same tag must be closed, up to NESTING deep;
    a tag of ENDS_ITSELF ends where the next one of its kind starts. The possessive
    loops neither backtrack nor recurse over the text.
    """
    tag, _, cls = selector.partition(".")
    attrs = r"(?:\s[^>]*+)?"
    if cls:
        word = rf"""(?:"(?:[^"]*\s)?{cls}(?:\s[^"]*)?"|'(?:[^']*\s)?{cls}(?:\s[^']*)?'|{cls}(?=[\s>]))"""
        attrs = rf"\s(?:[^>]*\s)?class\s*=\s*{word}[^>]*+"
    start = rf"(?is)<({tag or '[a-z][a-z0-9]*'}){attrs}>"
    other = r"[^<]++|<(?!/?\1\b)"
    if tag.lower() in ENDS_ITSELF:
        return rf"{start}((?:{other})*+)(?=</?\1\b|\z)"
    inside = rf"(?:{other})*+"
    for _ in range(NESTING):
        inside = rf"(?:{other}|<\1\b[^>]*+>{inside}</\1\s*+>)*+"
    return rf"{start}({inside})</\1\s*+>"


def extract_page_cards(
    pages: DataFrame,
    items: str,
    title: str = "",
    company: str = "",
    location: str = "",
    name: str = "pages",
    html: str = "html",
    url: str = "url",
    keep: tuple[str, ...] = (),
    limit: int | None = None,
) -> DataFrame:
    """The cards of each stored page, or the first `limit` of them.

    Selectors are `tag`, `.class` or `tag.class`; a card inside of a card is part of the
    outer one. An empty selector gives an empty field, one that hits nothing drops its card.
    """
    cards = pages.select(
        *keep,
        F.col(url).alias("url"),
        F.posexplode(_first(F.regexp_extract_all(html, F.lit(_element(items)), F.lit(2)), limit)).alias("pos", "card"),
    )
    fields = {"title": title, "company": company, "location": location}
    for field, selector in fields.items():
        if not selector:
            cards = cards.withColumn(field, F.lit(""))
            continue
        pattern = _element(selector)
        found = cards.withColumn(field, F.regexp_extract("card", pattern, 0)).where(F.col(field) != "")
        cards = found.withColumn(field, strip(strip_tags(F.regexp_extract(field, pattern, 2))))
    return _raw(
        cards,
        keep,
        external_id=surrogate_id("pw", F.concat(blank("url"), "title")),
        title=F.col("title"),
        company=F.col("company"),
        location=F.col("location"),
        url=blank("url"),
        raw_text=compose_text("title", "company", "location"),
        source_name=F.lit(name),
        source_tier=F.lit(3),
    )


def messages_to_raw(
    messages: DataFrame, title_length: int | None = None, text_length: int | None = None
) -> DataFrame:
    """Channel messages (channel, msg_id, text) that pass the prefilter; the text is the title too."""
    channel, number = F.col("channel"), F.col("msg_id").cast("string")
    return _raw(
        messages.where(worth_parsing("text")),
        external_id=F.concat_ws("_", F.lit("tg"), number, F.substring(channel, 1, 10)),
        title=cut("text", title_length),
        company=extract_company("text"),
        location=F.lit(""),
        url=F.concat(F.lit("https://t.me/"), channel, F.lit("/"), number),
        raw_text=cut("text", text_length),
        source_name=F.concat(F.lit("telegram_"), channel),
        source_tier=F.lit(4),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of the sources of a tier, repeats included."""
    return reduce(DataFrame.unionByName, frames)
