"""Resampling of documents towards a target distribution by hashed word n-grams.

Features of documents and of the target are counted in buckets of their CRC-32, which `crc` takes for all n-grams of a batch
at once. A document weighs the mean log ratio of its features' buckets; a draw without replacement takes the highest weights
after Gumbel noise that depends on the seed and the document's id alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.common import packed, stored, unpacked
from postsieve.llm.crc import span_crcs
from postsieve.llm.hashing import PIECE, PLAIN, in_batches

NEW = ("n_words", "n_features", "weight", "score", "rank")


def _spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some bytes, one space behind each: that buffer, the words' first and end places in it, their first places in `data`."""
    kept = PLAIN[data]
    word = kept != 0
    after = np.concatenate(([False], word[:-1])) & ~word
    first = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    ends = np.flatnonzero(after)
    sizes = (ends if len(ends) == len(first) else np.append(ends, len(data))) - first
    buffer = kept[word | after]
    buffer[buffer == 0] = 0x20
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(sizes)].astype(np.int64)
    return buffer, starts, starts + sizes, first


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[bytes, list[tuple[int, int]], int]]:
    """(bytes, (number, length in bytes) of the texts in them, words that an earlier piece had): short texts together, long ones cut between words.

    A piece starts with the last `most` - 1 words of the piece before, so that no n-gram is cut.
    """
    together: list[tuple[int, bytes]] = []
    for i, t in enumerate(texts):
        if len(t) <= PIECE:
            together.append((i, t))
            continue
        data, at, again = np.frombuffer(t, np.uint8), 0, 0
        while at < len(data):
            stop = at + PIECE
            while stop < len(data) and PLAIN[data[stop]]:
                stop += 1
            own = data[at:stop]
            yield own.tobytes(), [(i, len(own))], again
            if stop >= len(data):
                break
            first = _spaced(own)[3]
            again = min(most - 1, len(first))
            at = at + int(first[len(first) - again]) if again else stop
    yield b"\n".join([*(t for _, t in together), b""]), [(i, len(t) + 1) for i, t in together], 0


def features(texts: list[str | None], most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(text numbers, buckets, whether they are single words) of all runs of 1 to `most` consecutive words of the texts."""
    for data, parts, again in _pieces([(t or "").encode("utf-8", "surrogatepass") for t in texts], most):
        buffer, first, end, at = _spaced(np.frombuffer(data, np.uint8))
        bounds = np.cumsum([n for _, n in parts])
        owner = np.array([i for i, _ in parts], np.int64)[np.searchsorted(bounds, at, side="right")] if len(at) else np.zeros(0, np.int64)
        for n in range(1, most + 1):
            starts = np.arange(max(0, again - n + 1), len(first) - n + 1)
            starts = starts[owner[starts] == owner[starts + n - 1]]
            crcs = span_crcs(buffer, first[starts], end[starts + n - 1])
            yield owner[starts], (crcs % np.uint32(buckets)).astype(np.int64), n == 1


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows of `texts` (text): one histogram per task, added up. `buckets` bounds what reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for a, b in in_batches(rows):
                for _, found, _ in features(rows[a:b], most, buckets):
                    out += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of target share over source share), each count one more than seen."""
    buckets, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: object, seed: str) -> int:
    """Gumbel noise in thousandths, drawn by the hash of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(text: Column, key: Column, gain: np.ndarray, most: int, seed: str) -> Column:
    """Struct of n_words, n_features, weight and score per text; `key` is cast to a string for the noise."""
    buckets = len(gain)

    @F.pandas_udf("n_words bigint, n_features bigint, weight bigint, score bigint")
    def weighed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            rows = texts.tolist()
            words, counts, sums = (np.zeros(len(rows), np.int64) for _ in range(3))
            for a, b in in_batches(rows):
                for owner, found, single in features(rows[a:b], most, buckets):
                    n = np.bincount(owner, minlength=b - a)
                    counts[a:b] += n
                    words[a:b] += n if single else 0
                    np.add.at(sums, owner + a, gain[found])
            weight = sums // np.maximum(counts, 1)
            drawn = np.array([noise(None if k is None or k != k else k, seed) for k in keys], np.int64)
            yield pd.DataFrame({"n_words": words, "n_features": counts, "weight": weight, "score": weight + drawn})

    return weighed(F.coalesce(text, F.lit("")), key.cast("string"))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """`docs` without the text, with n_words, n_features, weight, score and rank (1 for the first drawn; NULL if not drawn).

    Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased; features all runs of 1 to `most` words. Drawn
    are `percent` of the documents with `least_words` words or more (rounded down), the highest scores first, ties to the smaller
    key, NULL keys last; rows that repeat get a rank each. NULL and empty texts have no features and weight 0. No documents give no
    rows; a target without features weighs all documents by smoothing alone. Columns of `docs` called like the new ones are
    replaced. Ranks need no global sort: scores are whole numbers whose range depends on logarithms of counts, so rows are
    counted per score, and only drawn rows are lined up within theirs.
    """
    rows = packed(docs, (*(n for n in NEW if n != key), text), text=F.col(f"`{text}`"), key=F.col(f"`{key}`"))
    source = bucket_counts(rows, most, buckets)
    gain = gains(source, bucket_counts(target.select(F.col(f"`{target_text}`").alias("text")), most, buckets))
    weighed = rows.withColumn("w", weigh(F.col("text"), F.col("key"), gain, most, seed)).select("row", "key", "w.*")
    weighed = stored(weighed, "weighed")
    able = F.col("n_words") >= least_words
    per_score = weighed.where(able).groupBy(F.col("score").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    higher = Window.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_score = per_score.withColumns({"before": F.coalesce(F.sum("n").over(higher), F.lit(0)), "all": F.sum("n").over(Window.partitionBy())})
    per_score = per_score.withColumn("draw", F.floor(F.col("all") * percent / F.lit(100))).where("before < draw")
    per_score = stored(per_score.select("at", "before", "draw"), "drawn-scores")
    placed = weighed.withColumn("at", F.when(able, F.col("score"))).join(per_score, "at", "left")
    by_key = Window.partitionBy("at").orderBy(F.col("key").asc_nulls_last())
    drawn = placed.where("before is not null").withColumn("place", F.col("before") + F.row_number().over(by_key))
    drawn = drawn.withColumn("rank", F.when(F.col("place") <= F.col("draw"), F.col("place")).cast("long"))
    others = placed.where("before is null").withColumn("rank", F.lit(None).cast("long"))
    return unpacked(drawn.select("row", *NEW).unionByName(others.select("row", *NEW)), *NEW)
