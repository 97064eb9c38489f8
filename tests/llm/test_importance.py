"""Importance resampling (12) against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import same
from postsieve.llm import importance
from postsieve.llm.crc import REACH, span_crcs

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, most):
    words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, targets, most, buckets, percent, least, seed):
    """Tuples of doc_id, n_words, n_features, weight, score, rank."""
    found = [(key, *runs(text, most)) for key, text in docs]
    bucket = {f: zlib.crc32(f.encode()) % buckets for _, _, fs in found for f in fs}
    s, t = Counter(bucket[f] for _, _, fs in found for f in fs), Counter(zlib.crc32(f.encode()) % buckets for x in targets for f in runs(x, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for key, words, fs in found:
        weight = sum(gain[bucket[f]] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    rank, left = {}, Counter(rows)
    for i, r in enumerate(drawn):
        rank.setdefault(r, []).append(i + 1)
    return [(*r, place) for r, n in left.items() for place in (rank.get(r, []) + [None] * n)[:n]]


def test_crcs():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 9000, dtype=np.uint8)
    sizes = np.array([0, 1, 2, REACH - 1, REACH, REACH + 1, 2 * REACH, 3 * REACH + 5, 8999, *rng.integers(0, 300, 400)])
    first = np.array([int(rng.integers(0, 9001 - n)) for n in sizes])
    expected = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(first, sizes)]
    assert span_crcs(data, first, first + sizes).tolist() == expected


@pytest.mark.parametrize("most, percent, piece", [(1, 10, None), (3, 50, 700), (2, 100, 64)])
def test_resample(spark, docs, monkeypatch, most, percent, piece):
    if piece:  # long texts cut at many places; tasks see it through the pickled function only if it is a default
        monkeypatch.setattr(importance, "PIECE", piece)
        texts = [r["text"] for r in docs.collect()]
        got = Counter()
        for owner, bucket, _ in importance.features(texts, most, 97):
            got.update(zip(owner.tolist(), bucket.tolist()))
        assert got == Counter((i, zlib.crc32(f.encode()) % 97) for i, x in enumerate(texts) for f in runs(x, most)[1])
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = importance.resample(docs, target, most=most, percent=percent, seed="x")
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], most, 10_000, percent, 20, "x")
    same(out, expected, ["doc_id", "n_words", "n_features", "weight", "score", "rank"])
    assert [c for c in out.columns if c in ("source", "spans", "key", "size", "h", "taken")] == ["source", "spans", "key", "size", "h", "taken"]


def test_resample_empty(spark, docs, empty):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert importance.resample(empty, target).count() == 0
    out = importance.resample(docs, target.where("false"))
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [], 1, 10_000, 10, 20, "2024")
    same(out, expected, ["doc_id", "n_words", "n_features", "weight", "score", "rank"])
