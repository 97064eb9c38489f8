"""Personal data: fixed patterns, and terms that disclose the protected entities by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import discard, forget, held, packed, row_key, salted_join, stored, unpacked

# Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "term")

#: The patterns of the kinds, written so that no input makes them slow or deep: a match starts where a run starts (or
#: where the match before ended), runs give nothing back, and groups in a loop are turned into character classes by
#: first replacing the dots and separators that can't be part of a match (by a character of the same length).
LOOSE_DOT, DOT_FILLER = r"\.(?![A-Za-z0-9-])", "_"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]+"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DOUBLE_SEPARATOR, SEPARATOR_FILLER = r"[ -](?=[ -])|(?<=[ -])[ -]", "x"
CARD = r"[0-9][0-9 -]*[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]{3,}"

NEAR = 60  # characters on either side of an entity
LEAST_LINES = 3
GENERALISE_AT, REMOVE_AT = 0.5, 0.8

FOUND = "array<struct<start:int,end:int,value:string>>"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def found(pieces: Column, values: Column) -> Column:
    """Spans in code points from the pieces between matches and the matches."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    return F.aggregate(pairs, empty, step, lambda s: s["out"])


def cut(text: Column, pattern: str, possible: Column) -> Column:
    """The text's pieces between matches and its matches; none where `possible` says that there can't be one."""
    some = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"))
    none = F.struct(F.array().cast("array<string>").alias("pieces"), F.array().cast("array<string>").alias("values"))
    return F.when(possible, some).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        once = F.reverse(digits).substr(i, F.lit(1)).cast("int")
        twice = 2 * once
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(once)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def is_ip(value: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(value, r"\."), small)


def is_card(value: Column) -> Column:
    n = F.length(digits_of(value))
    return F.when(n.between(14, 19), passes_luhn(digits_of(value))).otherwise(F.lit(False))


def is_phone(value: Column) -> Column:
    return F.length(digits_of(value)).between(10, 15)


def with_base_spans(rows: DataFrame) -> DataFrame:
    """`rows` (text and others) with the spans of the fixed patterns in base, sorted by start and kind."""
    t, raw = F.col("text"), "raw"
    has_digit, has_at = t.rlike("[0-9]"), t.contains("@")
    rows = held(
        rows,
        **{
            f"{raw}0": cut(F.when(has_at, F.regexp_replace(t, LOOSE_DOT, DOT_FILLER)), EMAIL, has_at),
            f"{raw}1": cut(t, IP, has_digit),
            f"{raw}2": cut(F.when(has_digit, F.regexp_replace(t, DOUBLE_SEPARATOR, SEPARATOR_FILLER)), CARD, has_digit),
            f"{raw}3": cut(t, PHONE, t.contains("+")),
        },
    )

    def of_kind(k: int, rule) -> Column:
        spans = F.filter(found(F.col(f"{raw}{k}.pieces"), F.col(f"{raw}{k}.values")), lambda s: rule(s["value"]))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    rules = (lambda v: F.lit(True), is_ip, is_card, is_phone)
    parts = [of_kind(k, rule) for k, rule in enumerate(rules)]
    rows = held(rows, base=F.sort_array(F.concat(*parts)).cast(SPANS))
    return rows.drop(*[f"{raw}{k}" for k in range(4)])


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def contexts(rows: DataFrame) -> DataFrame:
    """A row per entity of (key, text, base) and term near it on its line: key, entity, term, start, end, line (hash)."""
    key, t = "key", F.col("text")
    each = rows.where(F.size("base") > 0).select(key, "text", F.explode("base").alias("s"))
    first = F.greatest(F.col("s.start") - NEAR, F.lit(0))
    before = t.substr(first + 1, F.col("s.start") - first)
    after = t.substr(F.col("s.end") + 1, F.lit(NEAR))
    # the window ends at line ends, and at its edges words that are cut off are left out
    before = F.when(first > 0, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
    before = F.substring_index(before, "\n", -1)
    whole = F.length(after) < NEAR
    after = F.when(whole, after).otherwise(F.regexp_replace(after, r"[\p{L}\p{N}]+$", ""))
    after = F.substring_index(after, "\n", 1)
    each = held(each, before=before, after=after).select(
        key, F.xxhash64("s.value").alias("entity"), "s.start", "s.end", "before", "after",
        F.xxhash64("before", F.lit("|"), "after").alias("line"),
    )
    sides = F.array(
        F.struct((F.col("start") - F.length("before")).alias("at"), F.col("before").alias("side")),
        F.struct(F.col("end").alias("at"), F.col("after").alias("side")),
    )
    each = each.select(key, "entity", "line", F.explode(sides).alias("w")).select(key, "entity", "line", "w.*")
    each = held(each, raw=cut(F.col("side"), TERM, F.lit(True)))
    each = each.select(key, "entity", "line", "at", F.explode(found(F.col("raw.pieces"), F.col("raw.values"))).alias("f"))
    return each.select(
        key, "entity", "line", F.lower("f.value").alias("term"),
        (F.col("at") + F.col("f.start")).alias("start"), (F.col("at") + F.col("f.end")).alias("end"),
    )


def disclosing_terms(texts: DataFrame, near: DataFrame, least_lines: int, generalise_at: float) -> DataFrame:
    """(entity, term, ratio) of terms that tell at least `generalise_at` of an entity's information.

    ratio = PMI(entity, term) / IC(entity), from counts of distinct lines over the whole corpus: 1 if the term occurs only with
    the entity. Pairs on fewer than `least_lines` distinct surroundings tell nothing. Repeated lines and surroundings (copies)
    count once.
    """
    seen = near.select("entity", "term", "line").distinct()
    pair = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") >= least_lines)
    entity = near.select("entity", "line").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pair = stored(pair.join(entity, "entity"), "entity-terms")
    lines = texts.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("l")).where(F.length("l") > 0)
    lines = stored(lines.groupBy(F.xxhash64("l").alias("h")).agg(F.first("l").alias("l")), "distinct-lines")
    terms = lines.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("l"), F.lit(TERM), 0))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = lines.agg(F.count(F.lit(1)).cast("double").alias("n_lines"))
    pair = salted_join(pair, counts, ["term"], F.col("entity"), "inner").join(F.broadcast(total))
    pmi = F.log(F.col("n_pair") * F.col("n_lines") / (F.col("n_entity") * F.greatest("n_term", "n_pair")))
    ic = F.log(F.col("n_lines") / F.col("n_entity"))
    telling = pair.select("entity", "term", (pmi / F.when(ic > 0, ic)).alias("ratio")).where(F.col("ratio") >= generalise_at)
    telling = stored(telling, "telling")
    # the lines are as large as the corpus, and nothing reads them any more
    discard(lines)
    forget(texts.sparkSession)
    return telling


def find_personal_data(
    docs: DataFrame, text: str = "text", keep_text: bool = False, least_lines: int = LEAST_LINES, generalise_at: float = GENERALISE_AT
) -> DataFrame:
    """`docs` with found (array of start, kind, end, value; kinds by KINDS, terms with their ratio as value), n_email, n_ip, n_card,
    n_phone, n_term, base_sha256 and spans (kind:start:end, joined). Without the text, unless `keep_text`.

    Terms are looked up near base spans only. A term inside of a base span is left out. NULL is an empty text. Every row
    stays, repeated ones with equal results; no rows give no rows. Columns of `docs` called like the new ones are replaced.
    """
    new = ("found", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = packed(docs, new if keep_text else (*new, text), text=body)
    rows = with_base_spans(rows.withColumn("key", row_key(F.col("text"))))
    near = stored(contexts(rows.select("key", "text", "base")), "contexts")
    telling = disclosing_terms(docs.select(body.alias("text")), near, least_lines, generalise_at)
    hits = salted_join(near.drop("line"), telling, ["entity", "term"], F.col("key"), "inner")
    terms = hits.groupBy("key", "start", "end").agg(F.max("ratio").alias("ratio"))
    one = F.struct("start", F.lit(4).alias("kind"), "end", F.col("ratio").cast("string").alias("value"))
    terms = terms.groupBy("key").agg(F.collect_list(one).cast(SPANS).alias("terms"))
    rows = rows.drop("text").join(terms, "key", "left")
    outside = lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))
    added = F.filter(F.coalesce("terms", F.array().cast(SPANS)), outside)
    rows = held(rows, found=F.sort_array(F.concat(F.col("base"), added)))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    figures = {f"n_{name}": count(k) for k, name in enumerate(KINDS)}
    figures |= {"base_sha256": F.sha2(listed(F.col("base")), 256), "spans": listed(F.col("found"))}
    return unpacked(rows.withColumns(figures), *new)


def sanitise(docs: DataFrame, text: str = "text", remove_at: float = REMOVE_AT, **options) -> DataFrame:
    """`docs` with personal data replaced by `<KIND>`; disclosing terms become `<TERM>`, or go if they tell `remove_at` or more.

    Spans that overlap are one, named after the first. NULL texts stay NULL; the other columns stay as they are.
    """
    rows = find_personal_data(docs, text, keep_text=True, **options).select(*docs.columns, "found")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    t = F.col(text)

    def step(state: Column, s: Column) -> Column:
        gone = (s["kind"] == 4) & (s["value"].try_cast("double") >= remove_at)
        name = F.when(gone, F.lit("")).otherwise(F.element_at(names, s["kind"] + 1))
        fresh = s["start"] >= state["at"]
        piece = F.concat(t.substr(state["at"] + 1, s["start"] - state["at"]), name)
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("found", start, step, lambda s: F.concat(F.array_join(s["out"], ""), t.substr(s["at"] + 1, F.length(t))))
    return rows.withColumn(text, F.when(F.size("found") > 0, clean).otherwise(t)).drop("found")
