"""Quality rules: figures of each text, and lines that repeat across a host's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import SPACE, SPACE_CHARS, held, packed, row_key, salted_join, stored, unpacked, words_of

LINE_LIMIT = 20  # distinct documents of a host
MARKS = 4  # three-word windows that stand for a line
EDITED = 0.3  # share of them in frequent lines, from which a line is an edited one
COPIED = 0.5  # share of words in lines that may be frequent, from which a document may be a near copy
LEAST_LEFT_WORDS = 20
LEAST_LEFT_SHARE = 0.2

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def normalized_line(line: Column) -> Column:
    """Lower case, numbers as 0, other marks as single blanks."""
    out = F.regexp_replace(F.lower(line), r"[0-9]+", "0")
    return F.btrim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def with_figures(rows: DataFrame) -> DataFrame:
    """`rows` (text and others) with the columns FIGURES and lines (those with a word), row by row.

    NULL and empty texts have no words. A word is a run without white space; equal lines are equal characters.
    Each array is made once and kept in a column, since a lambda would make it again for every element.
    """
    rows = rows.withColumn("body", F.coalesce("text", F.lit("")))
    rows = held(rows, words=words_of(F.col("body")))
    n = F.size("words")
    at = lambda i: F.element_at("words", i)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    rows = held(rows, windows=F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    h = F.col("windows")
    indexed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(h)) < F.size(h)
    rows = held(rows, pairs=F.when(some, indexed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    equal = lambda x, j: F.coalesce(F.get("pairs", j)["h"] == x["h"], F.lit(False))
    repeated = F.filter("pairs", lambda x, j: equal(x, j - 1) | equal(x, j + 1))
    rows = held(rows, again=F.sort_array(F.transform(repeated, lambda x: x["i"])))
    # words of windows that overlap count once
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    repeat_words = F.aggregate(
        "again", state, lambda s, i: F.struct((s["sum"] + i + 3 - F.greatest(i, s["end"])).alias("sum"), (i + 3).alias("end")),
        lambda s: s["sum"].cast("long"),
    )
    lines = F.filter(F.split("body", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    rows = held(rows, lines=lines).withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("body", SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": repeat_words,
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("body", "words", "windows", "pairs", "again")


def with_lines(rows: DataFrame) -> DataFrame:
    """`rows` of `with_figures` with host and digest (of all lines), and in lines per line its hash, number of words and marks.

    marks are the MARKS smallest hashes of the line's three-word windows, or the line's hash if it has none. Each step is held
    in a column, since a lambda would make it again for every window.
    """
    host = F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\x00no host")))
    count = lambda x: F.size(F.split(F.btrim(x, F.lit(SPACE_CHARS)), SPACE))
    clean = F.transform("lines", lambda x: F.struct(normalized_line(x).alias("line"), count(x).alias("words")))
    rows = held(rows, clean=clean)
    rows = held(rows, split=F.transform("clean", lambda x: F.split(x["line"], " ")))
    at = F.element_at

    def marks(w: Column, line: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)))
        return F.when(F.size(w) > 2, F.slice(F.sort_array(F.array_distinct(windows)), 1, MARKS)).otherwise(F.array(F.xxhash64(line)))

    each = F.zip_with(
        "clean", "split",
        lambda x, w: F.struct(F.xxhash64(x["line"]).alias("line"), x["words"].alias("words"), marks(w, x["line"]).alias("marks")),
    )
    rows = held(rows, each=each).withColumn("lines", F.col("each"))
    return rows.withColumns({"host": host, "digest": F.xxhash64("lines.line")}).drop("clean", "split", "each")


def identities(documents: DataFrame, held_lines: DataFrame, often: DataFrame) -> DataFrame:
    """(host, digest, identity) of documents that may be near copies: COPIED or more of their words are in lines of `often`.

    The identity is the set of the lines that are neither in `often` nor edited forms of such lines, so that documents under
    a common menu differ by what they add to it. A document without such a line is a near copy of others: its identity is
    the smallest of its lines in `often`.
    """
    copied = held_lines.groupBy("host", "digest").agg(F.sum("words").alias("words"), F.min("line").alias("least"))
    copied = documents.join(copied.withColumnRenamed("words", "known").hint("merge"), ["host", "digest"])
    all_words = F.aggregate("lines.words", F.lit(0).cast("long"), lambda s, n: s + n)
    copied = stored(copied.where(F.col("known") >= COPIED * all_words).drop("known"), "copied")
    each = copied.select("host", "digest", F.explode("lines").alias("l")).select("host", "digest", "l.line", "l.marks")
    each = salted_join(each, often.withColumn("often", F.lit(True)), ["host", "line"], F.col("digest"), "left")
    each = stored(each, "marked-lines")
    known = each.where("often").select("host", F.explode("marks").alias("mark")).distinct().withColumn("hit", F.lit(1)).hint("merge")
    own = each.where("often is null").select("host", "digest", "line", F.explode("marks").alias("mark"))
    own = salted_join(own, known, ["host", "mark"], F.col("digest"), "left")
    own = own.groupBy("host", "digest", "line").agg((F.count("hit") / F.count(F.lit(1))).alias("share")).where(F.col("share") < EDITED)
    own = own.groupBy("host", "digest").agg(F.xxhash64(F.sort_array(F.collect_set("line"))).alias("own"))
    both = copied.select("host", "digest", "least").join(own.hint("merge"), ["host", "digest"], "left")
    return both.select("host", "digest", F.coalesce("own", "least").alias("identity"))


def taken_lines(facts: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, digest, taken, taken_lines) of documents with frequent lines: words in them, and the lines.

    A line is frequent if more than `limit` distinct documents of the host hold it. Copies of a document (one digest) and
    repeats of a line inside of it count once, near copies as one by their `identities`; none of them takes anything from the
    count. Copies go first, so that lines are counted without a shuffle of their own for distinct ones. What is joined grows
    with the corpus, so no side is broadcast at any size.
    """
    documents = stored(facts.groupBy("host", "digest").agg(F.first("lines").alias("lines")), "distinct-documents")
    once = documents.select("host", F.explode(F.array_distinct("lines.line")).alias("line"))
    often = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("host", "line")
    often = stored(often, "often").hint("merge")
    each = documents.select("host", "digest", F.explode(F.arrays_zip("lines.line", "lines.words")).alias("l"))
    each = each.select("host", "digest", F.col("l")["line"].alias("line"), F.col("l")["words"].alias("words"))
    holders = stored(salted_join(each, often, ["host", "line"], F.col("digest"), "inner"), "holders")
    own = identities(documents, holders, often)
    different = holders.join(own.hint("merge"), ["host", "digest"], "left").select("host", "line", F.coalesce("identity", "digest").alias("identity"))
    counts = different.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.where(F.col("n") > limit).select("host", "line").hint("merge")
    hits = salted_join(holders, frequent, ["host", "line"], F.col("digest"), "inner")
    taken = hits.groupBy("host", "digest").agg(F.sum("words").alias("taken"), F.collect_set("line").alias("taken_lines"))
    return taken.hint("merge")


def without_lines(text: Column, taken_lines: Column) -> Column:
    """The text without the lines whose hashes are in the array `taken_lines`; as it is, if that is NULL."""
    stay = lambda x: ~F.array_contains(taken_lines, F.xxhash64(normalized_line(x)))
    return F.when(taken_lines.isNotNull(), F.array_join(F.filter(F.split(text, "\n"), stay), "\n")).otherwise(text)


def judge_documents(
    docs: DataFrame, text: str = "text", source: str = "source", limit: int = LINE_LIMIT, rewrite: bool = False,
    least_words: int = LEAST_LEFT_WORDS, least_share: float = LEAST_LEFT_SHARE, hashes: bool = False,
) -> DataFrame:
    """`docs` with FIGURES, left_words and kept; with `rewrite` the text comes along without its frequent lines, else it is dropped.
    With `hashes` the hashes of these lines come along in taken_lines (NULL: none), for `without_lines`.

    Lines (normalised, hashed) that more than `limit` distinct documents of a host hold are taken away. kept is false where
    base_failed is true, or where lines were taken and fewer than `least_words` words or than the share `least_share` are left. NULL sources are one host. NULL and empty
    texts fail the base rules. Every row stays, repeated ones with equal results; no rows give no rows. Columns of `docs`
    called like the new ones are replaced.
    """
    new = (*FIGURES, "left_words", "kept", *(["taken_lines"] if hashes else []))
    rows = packed(docs, (*new, text), text=F.col(f"`{text}`"), source=F.col(f"`{source}`"))
    rows = with_lines(with_figures(rows.withColumn("key", F.xxhash64(row_key(F.col("text"))))))
    facts = stored(rows.drop("source", *([] if rewrite else ["text"])), "facts")
    taken = taken_lines(facts.select("host", "digest", "lines"), limit)
    listed = F.aggregate("lines.words", F.lit(0).cast("long"), lambda s, n: s + n)
    rows = facts.withColumn("listed", listed).drop("lines")
    rows = salted_join(rows, taken if rewrite or hashes else taken.drop("taken_lines"), ["host", "digest"], F.col("key"), "left")
    if rewrite:
        rows = rows.withColumn(text, without_lines(F.col("text"), F.col("taken_lines")))
    rows = rows.withColumn("left_words", F.col("n_words") - F.coalesce("taken", F.lit(0)))
    few = (F.col("left_words") < least_words) | (F.col("left_words") / F.col("listed") < least_share)
    depleted = F.col("taken").isNotNull() & few
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return unpacked(rows, *([text] if rewrite else []), *new)
