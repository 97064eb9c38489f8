"""Near-duplicates by Order MinHash on occurrence-labelled word 5-mers, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import discard, forget, packed, salted_join, stored, unpacked
from postsieve.llm.components import components
from postsieve.llm.hashing import BASE, PLAIN, in_batches, mixed, word_hashes

K = 5  # words in a k-mer
KEPT = 5  # k-mers of a sketch, in text order
SKETCHES = 20
SIMILARITY = 0.8
DRAWN = 2  # members of a group that those unlike its leader are compared with
CELLS = 256  # counts of k-mers by hash, at most 255 each
BLOCK = 128  # texts of a group that one row holds, on average

_ODD = (np.random.default_rng(20240501).integers(0, 2**63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def labelled_kmers(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers with their occurrence number in the text, and the offsets of the texts in them.

    A text of 1 to 4 words is one k-mer of all its words; a text without words has none.
    """
    n = np.diff(offsets)
    count = np.where(n >= K, n - K + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(offsets[:-1] - at[:-1], count) + np.arange(at[-1])
    length = np.repeat(np.minimum(n, K), count)
    padded = np.concatenate((hashes, np.zeros(K, np.uint64)))
    kmers = np.zeros(at[-1], np.uint64)
    for j in range(K):
        kmers = kmers * np.uint64(BASE) + np.where(j < length, padded[first + j], np.uint64(j + 1))
    kmers = mixed(kmers)
    # occurrence: position among equal k-mers of the same text
    doc = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((kmers, doc))
    k, d = kmers[order], doc[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    run = np.arange(len(k)) - np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
    occurrence = np.empty(len(k), np.int64)
    occurrence[order] = run
    return np.where(occurrence == 0, kmers, mixed(kmers + occurrence.astype(np.uint64) * np.uint64(BASE))), at


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One hash per sketch: its KEPT smallest k-mers under the sketch's own order, combined in text order."""
    drawn = kmers[None, :] * _ODD[:, None]
    drawn ^= drawn >> np.uint64(29)
    drawn *= np.uint64(0xBF58476D1CE4E5B9)
    if len(kmers) > KEPT:
        at = np.sort(np.argpartition(drawn, KEPT - 1, axis=1)[:, :KEPT], axis=1)
        chosen = kmers[at]
    else:
        chosen = np.broadcast_to(kmers, (SKETCHES, len(kmers)))
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for j in range(chosen.shape[1]):
        out = mixed(out * np.uint64(BASE) + chosen[:, j])
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity m / (|a| + |b| - m), m the k-mers of the longest alignment inside the band; 0 if it can't reach `least`.

    Labelled k-mers are unique in a text, so the longest common subsequence is the longest increasing run of partner
    positions. Whatever reaches `least` skips at most a fixed share of both texts, which gives the band.
    """
    total = len(a) + len(b)
    need = least * total / (1 + least)
    if not total or min(len(a), len(b)) < need - 1e-9:
        return 0.0
    order = np.argsort(b, kind="stable")
    place = np.searchsorted(b, a, sorter=order)
    partner = order[np.minimum(place, len(b) - 1)]
    i = np.flatnonzero(b[partner] == a)
    j = partner[i]
    band = total - 2 * need + 1
    inside = np.abs(i - j) <= band
    j = j[inside]
    if len(j) < need - 1e-9:
        return 0.0
    if np.all(j[1:] > j[:-1]):
        m = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        m = len(tails)
    return m / (total - m)


def sketch_rows(texts: DataFrame) -> DataFrame:
    """(text_id, sketch array, n k-mers, cells) of (text_id, body), row by row; an empty array for texts without words."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = batch["body"].tolist()
            out, sizes, cells = [], [], []
            for start, end in in_batches(bodies):
                kmers, at = labelled_kmers(*word_hashes(bodies[start:end], PLAIN))
                for x, y in zip(at[:-1], at[1:]):
                    out.append(sketches(kmers[x:y]).view(np.int64) if y > x else np.zeros(0, np.int64))
                    cells.append(cells_of(kmers[x:y]).tobytes())
                sizes += np.diff(at).tolist()
            yield pd.DataFrame({"text_id": batch["text_id"], "sketch": out, "n": sizes, "cells": cells})

    return texts.select("text_id", "body").mapInPandas(rows, "text_id string, sketch array<bigint>, n int, cells binary")


def cells_of(kmers: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((kmers >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8)


def possible(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether texts with these cells and numbers of k-mers can reach `least`: false only where they can't.

    Their cells differ by at most the k-mers that only one of them has, and these are a fixed share of both at most.
    """
    apart = np.abs(a[:, None, :].astype(np.int16) - b[None, :, :]).sum(axis=2, dtype=np.int64)
    both = n_a[:, None].astype(np.int64) + n_b[None, :]
    return apart <= both * (1 - least) / (1 + least) + 1e-6


def left_pairs(apart: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of texts in one bucket with different roots that can be similar; apart has bucket, text_id, root, main, n, cells.

    Of two texts with different roots one is outside of the main component, so blocks of those meet all blocks of the bucket.
    A block has texts of like length, so that most blocks don't meet; the cells tell the pairs of two blocks apart.
    """
    rows = apart.withColumns({"out": F.col("root") != F.col("main"), "span": F.floor(F.log2("n") * 8).cast("int")})
    sizes = rows.groupBy("bucket", "out", "span").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = salted_join(rows, sizes, ["bucket", "out", "span"], F.col("text_id"), "inner")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text_id", F.lit(7)), "parts").cast("int"))
    member = F.struct("text_id", "root", "n", "cells")
    blocks = rows.groupBy("bucket", "out", "span", "part").agg(F.collect_list(member).alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    blocks = stored(blocks.select("bucket", "out", F.xxhash64("span", "part", "out").alias("id"), "low", "high", "m"), "blocks")
    index = blocks.select("bucket", "out", "id", "low", "high")
    right = index.select("bucket", *[F.col(c).alias(f"y_{c}") for c in ("out", "id", "low", "high")])
    meet = (F.col("high") >= least * F.col("y_low") - 1e-6) & (F.col("y_high") >= least * F.col("low") - 1e-6)
    once = ~F.col("y_out") | (F.col("id") <= F.col("y_id"))
    pairs = index.where("out").join(right, "bucket").where(meet & once).select("bucket", "id", "y_id")
    left = blocks.select("bucket", "id", F.col("m").alias("x"))
    pairs = pairs.join(left, ["bucket", "id"]).join(blocks.select("bucket", F.col("id").alias("y_id"), F.col("m").alias("y")), ["bucket", "y_id"])

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = lambda m: (
            [r["text_id"] for r in m], np.array([r["root"] for r in m], object), np.array([r["n"] for r in m], np.int64),
            np.frombuffer(b"".join(bytes(r["cells"]) for r in m), np.uint8).reshape(-1, CELLS),
        )
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"]):
                (i, ri, n, c), (j, rj, k, d) = parts(x), parts(y)
                got = set()
                for at in range(0, len(i), 16):
                    at_once = slice(at, at + 16)
                    fit = possible(c[at_once], n[at_once], d, k, least) & (ri[at_once][:, None] != rj[None, :])
                    got |= {(min(i[at + p], j[q]), max(i[at + p], j[q])) for p, q in zip(*np.nonzero(fit))}
                yield pd.DataFrame(sorted(got), columns=["a", "b"]).astype(object)

    out = stored(pairs.select("x", "y").mapInPandas(compared, "a string, b string").distinct(), "leftovers")
    discard(blocks)
    return out


def distinct_bodies(texts: DataFrame) -> DataFrame:
    """One row per text_id; a task hands on one of the copies it holds, so a text that a third of all rows have is no hot key."""
    return texts.groupBy("text_id").agg(F.first("body").alias("body"))


def verified(pairs: DataFrame, bodies: DataFrame, least: float, together: int = 50) -> DataFrame:
    """Pairs (a, b) of text ids whose texts (one row per id) reach the similarity `least`, with similarity.

    A text with many partners is copied once per `together` of them, so that its pairs are several tasks' work.
    """
    partners = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("parts"))
    pairs = salted_join(pairs, partners, ["a"], F.col("b"), "inner")
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    right = bodies.select(F.col("text_id").alias("b"), F.col("body").alias("body_b"))
    left = bodies.select(F.col("text_id").alias("a"), F.col("body").alias("body_a")).join(partners, "a")
    left = left.select("a", "body_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = pairs.join(right, "b").join(left, ["a", "part"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for batch in batches:
            got = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["body_a"], batch["body_b"]):
                if a != last:
                    last, kept = a, labelled_kmers(*word_hashes([x], PLAIN))[0]
                similarity = aligned(kept, labelled_kmers(*word_hashes([y], PLAIN))[0], least)
                if similarity >= least:
                    got.append((a, b, similarity))
            yield pd.DataFrame(got, columns=["a", "b", "similarity"]).astype({"a": object, "b": object, "similarity": float})

    return both.mapInPandas(rows, "a string, b string, similarity double")


def near_links(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between different texts of (text_id, body), enough to connect those that share a sketch and are similar.

    Rows that repeat a text count once. In each group of texts with an equal sketch, all are compared with the text in the
    middle, and those unlike it with DRAWN of those like it. What is then outside of the group's largest component is compared
    with all members of other components, each pair once, but for pairs whose counts of k-mers rule the similarity out.
    Components known before that are handed on as links of their smallest text to each other one.
    """
    per_text = sketch_rows(texts).groupBy("text_id").agg(*[F.first(c).alias(c) for c in ("sketch", "n", "cells")])
    per_text = stored(per_text, "texts")
    members = per_text.select("text_id", F.posexplode("sketch").alias("n", "h"))
    members = stored(members.select("text_id", F.xxhash64("n", "h").alias("bucket")), "sketches")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    together = stored(salted_join(members, sizes, ["bucket"], F.col("text_id"), "inner"), "shared")
    discard(members)
    # the text whose sketches most others have stands in the middle of its group, and leads it
    weight = together.groupBy("text_id").agg(F.sum("size").alias("weight"))
    shared = together.drop("size").join(weight, "text_id")
    leaders = shared.groupBy("bucket").agg(F.max(F.struct("weight", "text_id")).alias("top")).select("bucket", F.col("top.text_id").alias("leader"))
    led = stored(salted_join(together.drop("size"), leaders, ["bucket"], F.col("text_id"), "inner"), "groups")
    discard(together)
    bodies = distinct_bodies(texts).join(led.select("text_id").distinct(), "text_id", "left_semi")
    bodies = stored(bodies, "bodies")
    spark = texts.sparkSession
    others = led.where("text_id <> leader")
    first = others.select(F.col("leader").alias("a"), F.col("text_id").alias("b")).distinct()  # a has the partners
    forget(spark)
    links = stored(verified(first, bodies, least), "links")
    forget(spark)
    like = links.select(F.col("a").alias("leader"), F.col("b").alias("text_id"), F.lit(True).alias("like"))
    met = stored(others.join(like, ["leader", "text_id"], "left").drop("leader"), "met")
    draw = lambda turn: F.max(F.struct(F.xxhash64("text_id", F.lit(turn)), "text_id"))["text_id"]
    drawn = met.where("like").groupBy("bucket").agg(F.array_distinct(F.array(*map(draw, range(DRAWN)))).alias("drawn"))
    again = salted_join(met.where("like is null").drop("like"), drawn, ["bucket"], F.col("text_id"), "inner")
    again = again.select(F.explode("drawn").alias("a"), F.col("text_id").alias("b")).distinct()
    more = stored(verified(again, bodies, least), "links")
    discard(met)
    forget(spark)
    roots = components(links.select("a", "b").unionByName(more.select("a", "b")))
    for done in (links, more):
        discard(done)
    placed = led.drop("leader").join(roots.withColumnRenamed("node", "text_id"), "text_id", "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "text_id")), "placed")
    discard(led)
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts"))
    main = main.where("parts > 1").drop("parts")
    apart = stored(salted_join(placed, main, ["bucket"], F.col("text_id"), "inner"), "apart")
    discard(placed)
    forget(spark)
    counts = per_text.select("text_id", "n", "cells")
    rest = left_pairs(apart.join(counts, "text_id"), least)
    discard(apart)
    discard(per_text)
    forget(spark)
    last = verified(rest, bodies, least).select("a", "b")
    every = stored(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(last), "links")
    for done in (roots, rest, bodies):
        discard(done)
    return every


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """`docs` without the text, with class_id (smallest `key` of its group of copies and near copies) and is_first.

    Groups are the components of exact copies (equal characters) and of links of `least` similarity on five-word k-mers. Of
    each group the rows with the smallest key are is_first. A NULL text is no copy of anything; texts without words are
    copies only if equal. A NULL key is larger than any key. Columns of `docs` called like the new ones are replaced.
    """
    new = ("class_id", "is_first")
    own = F.coalesce(F.md5(text), F.concat(F.lit("none-"), F.col(key).cast("string")), F.lit("none"))
    rows = packed(docs, (*new, text), text_id=own, body=F.col(text), k=F.col(key))
    some = rows.where("body is not null").select("text_id", "body", "k")
    links = near_links(some.select("text_id", "body"), least)
    forget(docs.sparkSession)
    roots = components(links.select("a", "b"))
    discard(links)
    heads = some.groupBy("text_id").agg(F.min("k").alias("k"))
    heads = heads.join(roots.withColumnRenamed("node", "text_id"), "text_id", "left")
    classes = stored(heads.withColumn("root", F.coalesce("root", "text_id")), "classes")
    discard(roots)
    first = classes.groupBy("root").agg(F.min("k").alias("class_id"))
    classes = salted_join(classes.select("text_id", "root"), first, ["root"], F.col("text_id"), "inner").select("text_id", "class_id")
    rows = salted_join(rows.drop("body"), classes, ["text_id"], F.col("row"), "left")
    rows = rows.withColumn("class_id", F.coalesce("class_id", "k"))
    return unpacked(rows.withColumn("is_first", F.col("class_id").eqNullSafe(F.col("k"))), *new)
