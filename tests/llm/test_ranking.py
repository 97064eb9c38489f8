"""Ranked search (11) against a plain version."""

import math
import re
from collections import Counter, defaultdict

import pytest

from helpers import same
from postsieve.llm import ranking

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, queries, best):
    bags = [(key, Counter(terms(text))) for key, text in docs]
    n_docs, n_all = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = defaultdict(Counter)
    for item, text in queries:
        asked[item].update(terms(text))
    out = []
    for item, bag in asked.items():
        scores = []
        for key, b in bags:
            m = 25 + 75 * b.total() * n_docs // (n_all or 1)
            score = sum(k * w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, k in bag.items() if t in b)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:best])]
    return out


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows += [(500, None), (501, ""), (502, "zzzzqqqq nowhere"), (503, "the THE the of"), (504, "repeat"), (None, "the repeat"), (505, "one"), (505, "hello")]
    return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "1 as rank", "2 as score", "3 as doc_id")


@pytest.mark.parametrize("best, depths, known", [(10, ranking.DEPTHS, 10**6), (1, (1 / 500, 1 / 50), 10**6), (10, (1 / 50,), 0), (3, (), 10**6)])
def test_search(docs, queries, monkeypatch, best, depths, known):
    monkeypatch.setattr(ranking, "DEPTHS", depths)
    monkeypatch.setattr(ranking, "KNOWN_TERMS", known)
    out = ranking.search(docs, queries, best=best)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in queries.collect()], best)
    same(out, expected, ["item_id", "rank", "doc_id", "score"])


def test_copies_tie(spark, docs):
    """Many equal scores: the smallest ids win, whichever was read first."""
    rows = [(i, "alpha beta gamma") for i in range(300, 0, -1)] + [(1000 + i, f"delta{i} alpha") for i in range(300)] + [(0, "beta " * 50)]
    copies = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    asked = [(1, "Alpha gamma"), (2, "beta"), (3, "delta7 alpha beta beta")]
    out = ranking.search(copies, spark.createDataFrame(asked, "item_id bigint, text string"))
    same(out, plain(rows, asked, 10), ["item_id", "rank", "doc_id", "score"])


def test_no_rows(docs, empty, queries):
    assert ranking.search(empty, queries).count() == 0
    assert ranking.search(docs, queries.where("false")).count() == 0
    assert ranking.search(docs.where("text is null"), queries).count() == 0
