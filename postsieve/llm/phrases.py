"""Benchmark decontamination with a distributed positional inverted index.

The index holds a row per term and block of documents with all its postings (document, position). A search takes
the two rarest terms of each window of a test item, shifts their lists by their place in the item, keeps what meets, and reads the
rest of the phrase in the texts found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import packed, row_key, salted_join, stored, unpacked
from postsieve.llm.hashing import PLAIN, in_batches, word_hashes

WINDOW = 10
SLOP = 3
BLOCK_BYTES = 8_000_000

INDEX = "block string, term bigint, docs array<int>, positions array<int>, keys array<string>, sizes array<int>"


def build_index(docs: DataFrame) -> DataFrame:
    """Index of docs (key, text): postings rows (block, term, docs, positions), and a row per block with its keys and sizes in words."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "term", "docs", "positions", "keys", "sizes"]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
        keys, texts, held = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            hashes, offsets = word_hashes(texts, PLAIN)
            block = uuid.uuid4().hex  # rows are stored before use, and a lost task writes all of its blocks anew
            sizes = np.diff(offsets)
            nothing = [pa.nulls(1, k) for k in kinds]
            nothing[0] = pa.array([block])
            nothing[4], nothing[5] = pa.array([keys], kinds[4]), pa.array([sizes.astype(np.int32)], kinds[5])
            yield pa.RecordBatch.from_arrays(nothing, names)
            doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
            position = (np.arange(len(hashes)) - np.repeat(offsets[:-1], sizes)).astype(np.int32)
            order = np.argsort(hashes, kind="stable")
            terms = hashes[order]
            start = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
            for a in range(0, len(start), 20_000):
                part = start[a : a + 20_000]
                end = start[a + 20_000] if a + 20_000 < len(start) else len(terms)
                at = pa.array(np.append(part, end) - part[0], pa.int32())
                own = order[part[0] : end]
                lists = [pa.ListArray.from_arrays(at, pa.array(x[own])) for x in (doc, position)]
                n = len(part)
                columns = [pa.array([block] * n), pa.array(terms[part].view(np.int64)), *lists, pa.nulls(n, kinds[4]), pa.nulls(n, kinds[5])]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            all_texts, all_keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in in_batches(all_texts, BLOCK_BYTES):
                keys += all_keys[a:b]
                texts += all_texts[a:b]
                held += sum(map(len, all_texts[a:b]))
                if held >= BLOCK_BYTES:
                    yield from rows()
                    keys, texts, held = [], [], 0
        if texts:
            yield from rows()

    return docs.select("key", "text").mapInArrow(blocks, INDEX)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item_row, item_id as text, n, terms array) of items with at least one word; rows that repeat an item stay apart only if they differ."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, offsets = word_hashes(batch["text"].tolist(), PLAIN)
            terms = [hashes[a:b].view(np.int64) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pd.DataFrame({"item_row": batch["item_row"], "item_id": batch["item_id"], "terms": terms})[np.diff(offsets) > 0]

    ready = items.select(F.col(item).cast("string").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    ready = ready.withColumn("item_row", F.md5(F.concat(F.coalesce("item_id", F.lit("\x00")), F.lit("|"), "text")))
    return ready.mapInPandas(rows, "item_row string, item_id string, terms array<bigint>")


def rare_places(terms: np.ndarray, counts: np.ndarray, window: int) -> list[int]:
    """Places in an item such that every window has its two rarest terms (all, if it has one) among them."""
    n = min(window, len(terms))
    views = np.lib.stride_tricks.sliding_window_view(counts, n)
    first = np.argsort(views, axis=1, kind="stable")[:, :2] + np.arange(len(views))[:, None]
    return sorted(set(first.ravel().tolist()))


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Places worth reading (key, item_row, shift), where the two rarest terms of a window meet, and (key, item_row) of proximity
    matches, where two such terms stand at most `slop` words off their distance.

    `items` has item_row and terms. Nothing that holds a window is missed: its two rarest terms have the same shift.
    """
    asked = items.select(F.explode("terms").alias("term")).distinct()
    lists = index.where("term is not null").select("block", "term", "docs", "positions")
    counts = lists.select("term", F.size("docs").alias("n")).join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    placed = items.select("item_row", F.posexplode("terms").alias("place", "term"))
    placed = placed.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def rare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        out = group.iloc[rare_places(group["term"].to_numpy(), group["n"].to_numpy(), window)]
        return out[["item_row", "place", "term"]].assign(least=min(2, window, len(group)))

    anchors = stored(placed.groupBy("item_row").applyInPandas(rare, "item_row string, place int, term bigint, least int"), "anchors")
    found = lists.join(anchors, "term").select("block", "item_row", "place", "least", F.explode(F.arrays_zip("docs", "positions")).alias("p"))
    found = found.select("block", "item_row", "place", "least", "p.docs", (F.col("p.positions") - F.col("place")).alias("shift"))
    found = stored(found, "anchor-postings")
    exact = found.groupBy("block", "docs", "item_row", "shift").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
    exact = exact.where("n >= least").select("block", "docs", "item_row", "shift")
    # shifts in bands of the slop, each also in the next band, so that near ones share one
    bands = found.select("block", "docs", "item_row", "place", "shift", F.explode(F.array(F.floor(F.col("shift") / (slop + 1)), F.floor(F.col("shift") / (slop + 1)) + 1)).alias("band"))
    near = bands.groupBy("block", "docs", "item_row", "band").agg((F.min("place") < F.max("place")).alias("two"), F.min("shift").alias("low"), F.max("shift").alias("high"))
    near = near.where("two and low < high").select("block", "docs", "item_row").distinct()
    keys = index.where("term is null").select("block", F.posexplode("keys").alias("docs", "key"))
    exact = keys.join(exact, ["block", "docs"]).select("key", "item_row", "shift").distinct()
    near = keys.join(near, ["block", "docs"]).select("key", "item_row").distinct()
    return exact, near


def read_phrases(places: DataFrame, items: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, n_hit, item_ids, spans) of texts (key, text) in which a window of an item stands, from places worth reading.

    A window is `window` words of an item, or all words of a shorter one. spans are the word ranges hit.
    """
    wanted = salted_join(places, items, ["item_row"], F.struct("key", "shift"), "inner")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("item_id", "shift", "terms")).alias("wanted"))
    both = wanted.join(texts.select("key", "text"), "key")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for key, text, wanted in zip(batch["key"], batch["text"], batch["wanted"]):
                words = word_hashes([text], PLAIN)[0].view(np.int64)
                hit, ids = np.zeros(len(words), bool), set()
                for w in wanted:
                    terms = np.asarray(w["terms"], np.int64)
                    low, high = max(0, w["shift"]), min(len(words), w["shift"] + len(terms))
                    n = min(window, len(terms))
                    if high - low < n:
                        continue
                    equal = words[low:high] == terms[low - w["shift"] : high - w["shift"]]
                    runs = np.flatnonzero(np.convolve(equal, np.ones(n, np.int64), "valid") == n)
                    for r in runs.tolist():
                        hit[low + r : low + r + n] = True
                    if len(runs):
                        ids.add(w["item_id"])
                if ids:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                    got.append((key, int(hit.sum()), sorted(i for i in ids if i is not None), spans))
            yield pd.DataFrame(got, columns=["key", "n_hit", "item_ids", "spans"])

    return both.mapInPandas(rows, "key string, n_hit bigint, item_ids array<string>, spans array<struct<start:int,end:int>>").dropDuplicates(["key"])


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP
) -> DataFrame:
    """`docs` without the text, with n_words, n_hit, n_items, items_sha256, contaminated, n_near, item_ids and spans.

    Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased. A word is hit if it lies in an occurrence of a
    window of an item; n_near counts items with a proximity match and no exact one. NULL texts have no words; items without words match
    nothing, an item id that is NULL counts as contamination but has no place in the list. Every row stays, repeated ones with equal
    results; no documents give no rows, no items no hits. Columns of `docs` called like the new ones are replaced.
    """
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "item_ids", "spans")
    rows = packed(docs, (*new, text), text=F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn("key", row_key(F.col("text")))
    texts = rows.select("key", "text")
    index = stored(build_index(texts), "index")
    asked = stored(item_terms(items, item, item_text), "items")
    exact, near = search(index, asked, window, slop)
    exact = stored(exact, "places")
    hits = read_phrases(exact, asked, texts, window)
    only_near = near.join(exact.select("key", "item_row").distinct(), ["key", "item_row"], "left_anti")
    only_near = only_near.groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))
    sizes = index.where("term is null").select(F.explode(F.arrays_zip("keys", "sizes")).alias("d"))
    sizes = sizes.groupBy(F.col("d.keys").alias("key")).agg(F.max("d.sizes").cast("long").alias("n_words"))
    rows = rows.drop("text").join(sizes, "key").join(hits, "key", "left").join(only_near, "key", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0)), "n_near": F.coalesce("n_near", F.lit(0)),
            "item_ids": F.coalesce("item_ids", none), "n_items": F.size(F.coalesce("item_ids", none)).cast("long"),
            "items_sha256": F.sha2(F.array_join(F.coalesce("item_ids", none), ","), 256),
            "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False)),
        }
    )
    return unpacked(rows, *new)
