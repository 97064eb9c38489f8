"""Ranked lexical search by sequential reads of impact-sorted postings, with score intervals per document.

Postings are stored in falling order of their impact (what they add to a score). Rounds read on in all lists from where the last one
ended, each list as deep as the others. A document's score lies between the sum of what was read of it and that sum with the
highest impact left in each list. A query takes no new documents once its last place is worth more than any unseen document can reach, and documents that cannot
reach that place are dropped. Reading goes on for the others until intervals are points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.llm.common import discard, stored
from postsieve.llm.hashing import PLAIN, in_batches, word_hashes

KNOWN_TERMS = 1_000_000
DEPTHS = (1 / 64, 1 / 16, 1 / 4)  # of the number of documents, where rounds end


def term_counts(rows: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """`rows` (id, text) as id, no, n, terms, counts: a number of the row, its terms with repeats, the 64-bit hashes of those in `known`
    (sorted; all without it), and how often each occurs. To be stored once: tasks that run again may number anew."""
    kinds = [("no", T.LongType()), ("n", T.LongType()), ("terms", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, k) for n, k in kinds)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_batches(texts):
                hashes, offsets = word_hashes(texts[a:b], PLAIN)
                owner, terms = np.repeat(np.arange(b - a), np.diff(offsets)), hashes.view(np.int64)
                vocabulary = np.unique(terms) if known is None else known
                at = np.searchsorted(vocabulary, terms)
                if known is not None:
                    at[at == len(known)] = 0
                    found = known[at] == terms if len(known) else np.zeros(len(at), bool)
                    owner, at = owner[found], at[found]
                pairs, counts = np.unique(owner * max(len(vocabulary), 1) + at, return_counts=True)
                of, at = np.divmod(pairs, max(len(vocabulary), 1))
                ends = pa.array(np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int64))) for v in (vocabulary[at], counts)]
                columns = [batch.column(0).slice(a, b - a), pa.array(np.arange(no, no + b - a)), pa.array(np.diff(offsets).astype(np.int64)), *lists]
                no += b - a
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select("id", "text").mapInArrow(count, schema)


def impact_index(counted: DataFrame, query_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, blocks) of the terms of `query_terms` (term): stored postings term, no, impact, round, a folder per round and each file
    in falling order of impact; per term and round, the highest impact. Postings that add nothing are left out.

    Each list is cut into rounds at the same depths, shares of all documents, but only between heights (quarter powers of two) of impact.
    """
    n_docs, n_terms = counted.agg(F.sum(F.when(F.col("n") > 0, 1)), F.sum("n")).head()
    spread = F.explode(F.arrays_zip("terms", "counts")).alias("p")
    listed = counted.select("no", "n", spread).select(F.col("p.terms").alias("term"), "no", "n", F.col("p.counts").alias("tf"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * (n_docs or 0) + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = listed.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(query_terms.select("term").distinct(), "term", "left_semi")
    weights = stored(weights.select("term", weight.alias("w")).where("w > 0"), "weights")
    length = F.expr(f"25 + (75L * n * {n_docs or 0}L) div {n_terms or 1}L")
    impact = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    rows = listed.withColumn("m", length).join(weights, "term").select("term", "no", impact.alias("impact")).where("impact > 0")
    rows = rows.withColumn("height", F.floor(F.log2("impact") * 4).cast("int"))
    heights = stored(rows.groupBy("term", "height").agg(F.max("impact").alias("top"), F.count(F.lit(1)).alias("n")), "heights")
    depth = F.sum("n").over(Window.partitionBy("term").orderBy(F.col("height").desc()))
    number = sum(((F.col("depth") > share * (n_docs or 0)).cast("int") for share in DEPTHS), F.lit(0))
    heights = stored(heights.withColumn("depth", depth).withColumn("round", number).select("term", "height", "top", "round"), "rounds")
    rows = rows.join(heights.drop("top"), ["term", "height"]).drop("height")
    postings = stored(rows.sortWithinPartitions("round", F.col("impact").desc()), "postings", "round")
    return postings, heights.groupBy("term", "round").agg(F.max("top").alias("top"))


def search(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", query_text: str = "text", best: int = 10,
) -> DataFrame:
    """The `best` documents per query: `item`, rank, `key`, score; scores above 0 only, equal ones by ascending key, NULL last.

    Terms are runs of letters, digits and characters outside ASCII, A-Z lower-cased, held as 64-bit hashes; scores saturate in a
    term's count and shrink with the document's length, in whole numbers. Rows of `queries` with one id are one query with the terms
    of all of them. Rows of `docs` that repeat are documents each. NULL and empty texts have no terms; queries without terms, or
    whose terms no document has, give no rows, as do empty tables. Other columns are not read.

    Up to `KNOWN_TERMS` different query terms go to the tasks, which then list no others; beyond that all postings are listed and
    joined. The result is the same.
    """
    asked = term_counts(queries.select(F.col(f"`{item}`").alias("id"), F.col(f"`{query_text}`").alias("text")))
    asked = asked.select(F.col("id").alias("item"), F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    asked = stored(asked.groupBy("item", F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("times")), "query-terms")
    different = asked.select("term").distinct()
    known = None
    if different.count() <= KNOWN_TERMS:
        known = np.sort(np.array([r["term"] for r in different.collect()], np.int64))
    counted = stored(term_counts(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), known), "term-counts")
    postings, blocks = impact_index(counted, asked)
    asked = stored(asked.join(blocks.select("term").distinct(), "term", "left_semi"), "listed-terms")
    zero = F.lit(0).cast("long")
    state = asked.select("item", zero.alias("no"), zero.alias("low"), F.lit(False).alias("closed")).where("false")
    status, before = asked.select("item", F.lit(False).alias("closed")).distinct(), None
    for number in range(len(DEPTHS) + 1):
        left = blocks.where(F.col("round") > number).groupBy("term").agg(F.max("top").alias("top"))
        sums = _read(postings.where(F.col("round") == number), asked, state, status)
        state, status = _bounded(sums, asked, left, best)
        if before is not None:
            discard(before)
        before = sums
    discard(postings)
    order = Window.partitionBy("item").orderBy(F.col("low").desc(), F.col("id").asc_nulls_last(), "no")
    ranked = state.join(counted.select("no", "id"), "no").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(key), F.col("low").alias("score"))


def _read(block: DataFrame, asked: DataFrame, state: DataFrame, status: DataFrame) -> DataFrame:
    """Stored sums (item, no, low) of `state` and of what the postings of `block` add."""
    found = status.withColumnRenamed("item", "of")
    terms = asked.join(found, F.col("item").eqNullSafe(F.col("of"))).drop("of")
    adds = (F.col("item"), F.col("no"), (F.col("times") * F.col("impact")).alias("low"))
    fresh = block.join(terms.where("not closed").drop("closed"), "term").select(*adds, F.lit(1).alias("held"))
    # queries that take no new documents need the postings of the documents that one of them still holds
    some = state.where("closed").select("no").distinct()
    more = block.join(some, "no", "left_semi").join(terms.where("closed"), "term").select(*adds, F.lit(0).alias("held"))
    every = state.select("item", "no", "low", F.lit(1).alias("held")).unionByName(fresh).unionByName(more)
    sums = every.groupBy("item", "no").agg(F.sum("low").alias("low"), F.max("held").alias("held")).where("held = 1")
    return stored(sums.drop("held"), "sums")


def _bounded(sums: DataFrame, asked: DataFrame, left: DataFrame, best: int) -> tuple[DataFrame, DataFrame]:
    """State (item, no, low, closed) of the documents of `sums` that can still be among the `best`, and status (item, closed).

    `left` has the highest impact not yet read per term (term, top). A document is worth `low` at least and at most that and the
    highest impacts left of all the query's terms.
    """
    order = Window.partitionBy("item").orderBy(F.col("low").desc(), "no")
    last = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)
    last = last.groupBy("item").agg(F.max("place").alias("places"), F.min("low").alias("low")).where(F.col("places") == best)
    last = last.select(F.col("item").alias("of"), F.col("low").alias("least"))
    unread = asked.join(left, "term", "left").groupBy("item").agg(F.sum(F.col("times") * F.coalesce("top", F.lit(0))).alias("unread"))
    bounds = unread.join(last, F.col("item").eqNullSafe(F.col("of")), "left").drop("of")
    bounds = stored(bounds.withColumn("closed", F.coalesce(F.col("least") > F.col("unread"), F.lit(False))), "bounds")
    limits = bounds.withColumnRenamed("item", "of")
    kept = sums.join(limits, F.col("item").eqNullSafe(F.col("of")))
    kept = kept.where(F.col("least").isNull() | (F.col("low") + F.col("unread") >= F.col("least")))
    return kept.select("item", "no", "low", "closed"), bounds.select("item", "closed")
