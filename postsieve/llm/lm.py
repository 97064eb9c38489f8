"""Language-model scores: deleted interpolation of bigram, unigram and uniform estimates.

Every word is a context of its own. In its text a word is followed by one more token, so a context's count is its word's
(the start's is that of the ends). Pairs are counted where their word's count is complete, then meet their context's count.
Weights of the mixture depend on the context's frequency and are learned by expectation-maximisation on counts of a part
that the estimates left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import delete, discard, forget, packed, row_key, stored, unpacked
from postsieve.llm.hashing import SPACED, in_batches, mixed, word_hashes

TOP = 4096  # words (and word pairs) with at least the share 1 / TOP of all tokens are known to every task: at most TOP of them
END_WORD, START = np.uint64(0x0E2D), np.uint64(0x57A7)  # the end of a text, and what is before its first token
OTHER = 0xFFFF  # code of a word that not every task knows
BUCKET_BYTES = 5_000_000  # text per group of words
PIECE_CHARS = 3_000_000  # text that a task packs at once
ROUNDS, FINE = 30, 1e-4
WORD_TURNS, TURNS = 2, 3  # parts of the groups by word, by context that are shuffled one after the other, so that disk holds a part of all pairs


def part_of(key: Column) -> Column:
    """crc32 of the key as text modulo 5: 1 is scored only, 4 is left out of the estimates that the weights are learned on."""
    return F.coalesce(F.crc32(key.cast("string")) % 5, F.lit(0)).cast("int")


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends of texts in order, and their text's number."""
    h, offsets = word_hashes(texts, SPACED)
    return np.insert(h, offsets[1:], END_WORD), np.repeat(np.arange(len(texts)), np.diff(offsets) + 1)


def context_of(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each token, or START."""
    out = np.full(len(h), START, np.uint64)
    if len(h) > 1:
        out[1:] = np.where(doc[1:] == doc[:-1], h[:-1], START)
    return out


def pair_id(h: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(h + context * np.uint64(0xD6E8FEB86659FD93))


def _place(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _starts(fresh: np.ndarray) -> np.ndarray:
    return np.flatnonzero(fresh)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def _raw(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), kind)


def _bucket_of(own: np.ndarray, other: np.ndarray, known: np.ndarray, buckets: int) -> np.ndarray:
    """Group of a pair by one of its words, whose pairs are then all there; those of a word in `known` spread by the other too."""
    spread = np.where(_place(own, known) >= 0, other | np.uint64(1), np.uint64(0))
    return (mixed(own + spread * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def _coded(h: np.ndarray, known: np.ndarray) -> tuple[bytes, bytes]:
    """Words as places in `known`, and the hashes of the others."""
    place = _place(h, known)
    return _raw(np.where(place >= 0, place, OTHER), "u2"), h[place < 0].tobytes()


def _decoded(codes: bytes, rest: bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that `_coded` put away, and their places in `known` or -1."""
    place = np.frombuffer(codes, "u2").astype(np.int64)
    place[place == OTHER] = -1
    h = np.empty(len(place), np.uint64)
    h[place >= 0] = known[place[place >= 0]]
    h[place < 0] = np.frombuffer(rest, "u8")
    return h, place


def _by_bucket(bucket: np.ndarray, buckets: int, first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Stable order by bucket, and by leading bits of two hashes within: one sort instead of three. Equal hashes mostly meet."""
    bits = np.uint64(buckets.bit_length())
    within = (first & ~np.uint64(0xFFFFFFFF)) | (then >> np.uint64(32))
    return np.argsort((bucket.astype(np.uint64) << (np.uint64(64) - bits)) | (within >> bits), kind="stable")


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    edges = np.append(_starts(np.diff(bucket, prepend=-1) != 0), len(bucket))
    return ((int(bucket[a]), a, b) for a, b in zip(edges[:-1], edges[1:]))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start, end in in_batches(batch["text"].tolist(), PIECE_CHARS):
            yield batch.iloc[start:end]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n_fit, n_left_out) of all training tokens of docs (part, text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _pieces(batches):
            piece = piece[piece["part"] != 1]
            h, doc = tokens_of(piece["text"].tolist())
            if not len(h):
                continue
            words, back = np.unique(h, return_inverse=True)
            out = (piece["part"].to_numpy() == 4)[doc]
            left_out = np.bincount(back, weights=out, minlength=len(words)).astype(np.int64)
            yield pd.DataFrame({"h": words.view(np.int64), "n_fit": np.bincount(back, minlength=len(words)) - left_out, "n_left_out": left_out})

    counts = docs.select("part", "text").mapInPandas(rows, "h bigint, n_fit bigint, n_left_out bigint")
    return counts.groupBy("h").agg(F.sum("n_fit").alias("n_fit"), F.sum("n_left_out").alias("n_left_out"))


CODED = "bucket int, word binary, word_rest binary, context binary, context_rest binary, fit binary, left_out binary"
COUNTED = CODED + ", word_fit binary, word_all binary"
PAIRS = "bucket int, kind int, ids binary, pairs binary, words binary, contexts binary, b int, id bigint, n_pair bigint, n_word bigint, n_context bigint, w bigint"
GROUP, LEFT_OUT, LARGE = 0, 1, 2


def pair_counts(docs: DataFrame, known: np.ndarray, known_fit: np.ndarray, known_all: np.ndarray, total: int, buckets: int) -> list[DataFrame]:
    """Counts of all pairs of a context and a word in docs (part, text), with the counts of both, in rows of three kinds: a table a turn.

    GROUP: the pairs of a group (ids sorted) with the counts of pair, word and context in training tokens, packed. LEFT_OUT: w
    left-out tokens with these counts of pair, word and context without the part left out; b is the context's frequency bucket.
    LARGE: a pair with a share of 1 / TOP, which is in no group. `known` are the words (and START) that every task knows.
    The groups by word, then those by context, are shuffled in turns; what a turn has read goes with its shuffle files.
    """
    number = "u4" if total < 1 << 32 else "u8"

    def sent(batches: Iterator[pd.DataFrame], turn: int) -> Iterator[pd.DataFrame]:
        for piece in _pieces(batches):
            h, doc = tokens_of(piece["text"].tolist())
            context, part = context_of(h, doc), piece["part"].to_numpy()
            here = _bucket_of(h, context, known, buckets) % WORD_TURNS == turn
            h, doc, context = h[here], doc[here], context[here]
            ids = pair_id(h, context)
            order = np.argsort(ids)
            at = _starts(np.diff(ids[order], prepend=~ids[order[:1]]) != 0)
            fit, out = ((x[doc].astype(np.int64))[order] for x in ((part != 1) & (part != 4), part == 4))
            fit, out, h, context = _sums(fit, at), _sums(out, at), h[order][at], context[order][at]
            bucket = _bucket_of(h, context, known, buckets)
            order = _by_bucket(bucket, buckets, h, context)
            h, context, fit, out, bucket = h[order], context[order], fit[order], out[order], bucket[order]
            got = [(i, *_coded(h[a:b], known), *_coded(context[a:b], known), _raw(fit[a:b], "u4"), _raw(out[a:b], "u4")) for i, a, b in _slices(bucket)]
            yield pd.DataFrame(got, columns=[c.split()[0] for c in CODED.split(", ")])

    def read(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
        join = lambda c: b"".join(map(bytes, group[c]))
        return *_decoded(join("word"), join("word_rest"), known), *_decoded(join("context"), join("context_rest"), known)

    def with_words(group: pd.DataFrame) -> pd.DataFrame:
        """All pairs of the group's words, once, with the counts of words that not every task knows."""
        h, _, context, _ = read(group)
        ids = pair_id(h, context)
        order = np.argsort(ids)
        at = _starts(np.diff(ids[order], prepend=~ids[order[:1]]) != 0)
        del ids
        fit, out = (_sums(_joined(group[c], "u4").astype(np.int64)[order], at) for c in ("fit", "left_out"))
        h, context = h[order][at], context[order][at]
        words, back = np.unique(h, return_inverse=True)
        word_fit, word_out = (np.bincount(back, weights=x, minlength=len(words)).astype(np.int64) for x in (fit, out))
        unknown = _place(words, known) < 0
        word_fit, word_all = np.where(unknown, word_fit, 0)[back], np.where(unknown, word_fit + word_out, 0)[back]
        bucket = _bucket_of(context, h, known, buckets)
        order = _by_bucket(bucket, buckets, context, h)
        h, context, bucket = h[order], context[order], bucket[order]
        fit, out, word_fit, word_all = (_raw(x[order], number) for x in (fit, out, word_fit, word_all))
        size = np.dtype(number).itemsize
        got = [
            (i, *_coded(h[a:b], known), *_coded(context[a:b], known), *(x[a * size : b * size] for x in (fit, out, word_fit, word_all)))
            for i, a, b in _slices(bucket)
        ]
        return pd.DataFrame(got, columns=[c.split()[0] for c in COUNTED.split(", ")])

    def with_contexts(group: pd.DataFrame) -> pd.DataFrame:
        """All pairs of the group's contexts, with the counts of contexts."""
        h, word_at, context, context_at = read(group)
        fit, out, word_fit, word_all = (_joined(group[c], number).astype(np.int64) for c in ("fit", "left_out", "word_fit", "word_all"))
        contexts, back = np.unique(context, return_inverse=True)
        context_fit, context_out = (np.bincount(back, weights=x, minlength=len(contexts)).astype(np.int64)[back] for x in (fit, out))
        if len(known):
            word_fit, word_all = np.where(word_at >= 0, known_fit[word_at], word_fit), np.where(word_at >= 0, known_all[word_at], word_all)
            context_fit, context_all = (
                np.where(context_at >= 0, table[context_at], n) for table, n in ((known_fit, context_fit), (known_all, context_fit + context_out))
            )
        ids, every = pair_id(h, context), fit + out
        large = (every * TOP >= total) & (every > 0)
        order = np.argsort(ids)
        order = order[~large[order]]
        rows = [pd.DataFrame({
            "bucket": group["bucket"].iloc[:1].to_numpy(), "kind": GROUP, "ids": [ids[order].tobytes()], "pairs": [_raw(every[order], number)],
            "words": [_raw(word_all[order], number)], "contexts": [_raw(context_all[order], number)],
        })]
        left = pd.DataFrame({
            "b": np.log2(context_fit + 1.0).astype(np.int64), "n_pair": fit, "n_word": word_fit,
            "n_context": np.where(fit > 0, context_fit, 0), "w": out,
        })[out > 0]
        left = left.groupby(["b", "n_pair", "n_word", "n_context"], as_index=False)["w"].sum()
        rows.append(left.assign(kind=LEFT_OUT))
        rows.append(pd.DataFrame({
            "kind": LARGE, "id": ids[large].view(np.int64), "n_pair": every[large], "n_word": word_all[large], "n_context": context_all[large],
        }))
        names = [c.split()[0] for c in PAIRS.split(", ")]
        out_rows = pd.concat([r.reindex(columns=names).astype(object) for r in rows if len(r)])
        return out_rows.where(out_rows.notna(), None)

    spark, texts = docs.sparkSession, docs.select("part", "text")
    counted, pairs = [], []
    for turn in range(WORD_TURNS):
        rows = texts.mapInPandas(partial(sent, turn=turn), CODED).groupBy("bucket").applyInPandas(with_words, COUNTED)
        counted.append(stored(rows.withColumn("turn", F.col("bucket") % TURNS), "counted", "turn"))
        del rows
        forget(spark)
    for turn in range(TURNS):
        rows = _union([_folder(x, turn) for x in counted]).groupBy("bucket").applyInPandas(with_contexts, PAIRS)
        pairs.append(stored(rows, "pairs"))
        del rows
        for x in counted:
            delete(spark, f"{x.stored_at}/turn={turn}")
        forget(spark)
    for x in counted:
        discard(x)
    return pairs


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _folder(rows: DataFrame, turn: int) -> DataFrame:
    """The rows that a table of `stored` has for a turn."""
    return rows.where(F.col("turn") == turn).drop("turn")


def learned_weights(pairs: DataFrame, n_fit: int, vocabulary: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per frequency bucket of the context, by expectation-maximisation in Spark.

    Each round is one aggregate over the left-out counts; three sums per bucket come back, at most 64 rows.
    """
    rows = pairs.where(F.col("kind") == LEFT_OUT).select(
        "b", F.col("w").cast("double").alias("w"),
        F.when(F.col("n_context") > 0, F.col("n_pair") / F.col("n_context")).otherwise(0.0).alias("p2"),
        (F.col("n_word") / F.lit(float(max(n_fit, 1)))).alias("p1"),
    )
    rows = stored(rows.groupBy("b", "p2", "p1").agg(F.sum("w").alias("w")), "left-out")
    weights = np.tile([0.4, 0.5, 0.1], (64, 1))
    p0 = 1.0 / (vocabulary + 1)
    for _ in range(ROUNDS):
        at = lambda i: F.element_at(F.lit(weights[:, i].tolist()), F.col("b") + 1)  # noqa: E731, B023
        parts = [at(0) * F.col("p2"), at(1) * F.col("p1"), at(2) * F.lit(p0)]
        whole = parts[0] + parts[1] + parts[2]
        sums = rows.groupBy("b").agg(*[F.sum(F.col("w") * p / whole).alias(f"s{i}") for i, p in enumerate(parts)]).collect()
        fresh = weights.copy()
        for r in sums:
            share = np.maximum(np.array([r["s0"], r["s1"], r["s2"]]), 1e-9)
            fresh[r["b"]] = np.maximum(share / share.sum(), 1e-6)
            fresh[r["b"]] /= fresh[r["b"]].sum()
        moved = np.abs(fresh - weights).max()
        weights = fresh
        if moved < FINE:
            break
    return weights


SCORED = (
    "bucket int, piece bigint, n_docs int, ids binary, pairs binary, words binary, contexts binary, word binary, word_rest binary, "
    "context binary, context_rest binary, posts binary, doc binary, times binary, keys binary, base binary, score binary, known binary, tokens binary"
)
SUMMED = "piece bigint, n_docs int, doc binary, keys binary, base binary, score binary, known binary, tokens binary"
ADDED = "piece bigint, heads int, keys binary, base binary, score binary, known binary, tokens binary"


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` without the text, with held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words of the text (A-Z lower-cased) and one end. Documents whose crc32(key as text) mod 5 is 1 are
    scored only, all others are learned from, and every document is scored. base_score is the smoothed unigram score
    log10((c + 0.5) / (N + 0.5 (V + 1))), score the mixture's log10 probability. NULL and empty texts are the end alone; a NULL key is
    learned from. Repeated rows get equal results. If there is nothing to learn from, every
    word has the uniform estimate. Columns of `docs` called like the new ones are replaced.
    """
    new = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = packed(docs, (*new, text), text=body, part=part_of(F.col(f"`{key}`"))).withColumn("key", row_key(F.col("text")))
    read = rows.select("part", "text", "key")
    size = read.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = int(size // BUCKET_BYTES) + 6

    words = stored(word_counts(read), "words")
    n_fit, n_out, vocabulary = (int(x or 0) for x in words.agg(F.sum("n_fit"), F.sum("n_left_out"), F.count(F.lit(1))).head())
    total = n_fit + n_out
    # at most TOP words have so large a share; the start is as frequent as the end
    is_end = F.col("h") == int(END_WORD)
    frequent = words.where(is_end | ((F.col("n_fit") + F.col("n_left_out")) * TOP >= total)).collect()
    frequent = [(r["h"] % (1 << 64), r["n_fit"], r["n_fit"] + r["n_left_out"]) for r in frequent]
    starts = [f[1:] for f in frequent if f[0] == int(END_WORD)] or [(0, 0)]
    frequent = sorted([*frequent, (int(START), *starts[0])])
    top = np.array([f[0] for f in frequent], np.uint64)
    top_fit, top_all = np.array([f[1] for f in frequent], np.int64), np.array([f[2] for f in frequent], np.int64)
    discard(words)

    counts_of_turns = pair_counts(read, top, top_fit, top_all, total, buckets)
    pairs = _union(counts_of_turns)
    weights = learned_weights(pairs, n_fit, vocabulary)
    # at most TOP pairs have so large a share
    large = sorted((r["id"] % (1 << 64), r["n_pair"], r["n_word"], r["n_context"]) for r in pairs.where(F.col("kind") == LARGE).collect())
    large_ids = np.array([r[0] for r in large], np.uint64)
    large_n = np.array([r[1:] for r in large], np.int64).reshape(-1, 3)
    number = "u4" if total < 1 << 32 else "u8"
    del pairs
    forget(docs.sparkSession)

    def log_base(n_word: np.ndarray) -> np.ndarray:
        return np.log10((n_word + 0.5) / (total + 0.5 * (vocabulary + 1)))

    def log_mixed(n_context: np.ndarray, n_pair: np.ndarray, n_word: np.ndarray) -> np.ndarray:
        w = weights[np.minimum(np.log2(n_context + 1.0).astype(np.int64), 63)]
        return np.log10(w[:, 0] * n_pair / np.maximum(n_context, 1) + w[:, 1] * n_word / max(total, 1) + w[:, 2] / (vocabulary + 1))

    columns = [c.split()[0] for c in SCORED.split(", ")]

    def words_sent(batches: Iterator[pd.DataFrame], turn: int) -> Iterator[pd.DataFrame]:
        for piece in _pieces(batches):
            h, doc = tokens_of(piece["text"].tolist())
            n = len(piece)
            keys = b"".join(map(bytes.fromhex, piece["key"]))
            # a piece is known by its rows: pieces of equal rows are summed up, and divided by their number
            name = int.from_bytes(hashlib.blake2b(keys, digest_size=8).digest(), "little", signed=True)
            context = context_of(h, doc)
            here = _place(pair_id(h, context), large_ids)
            got = []
            if turn == 0:  # each piece has one head, whose bucket is of that turn
                base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
                large = here >= 0
                if large.any():
                    n_pair, n_word, n_context = large_n[here[large]].T
                    base = np.bincount(doc[large], weights=log_base(n_word), minlength=n)
                    score = np.bincount(doc[large], weights=log_mixed(n_context, n_pair, n_word), minlength=n)
                    known = np.bincount(doc[large], minlength=n)
                got = [{
                    "bucket": name % buckets // TURNS * TURNS, "piece": name, "n_docs": n, "keys": keys, "base": base.tobytes(),
                    "score": score.tobytes(), "known": _raw(known, "u4"), "tokens": _raw(np.bincount(doc, minlength=n), "u4"),
                }]
            bucket = _bucket_of(context, h, top, buckets)
            here = (here < 0) & (bucket % TURNS == turn)
            h, doc, context, bucket = h[here], doc[here], context[here], bucket[here]
            order = _by_bucket(bucket, buckets, context, h)  # texts stay in order
            h, doc, context, bucket = h[order], doc[order], context[order], bucket[order]
            new_pair = np.ones(len(h), bool)
            new_pair[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
            new_post = new_pair.copy()
            new_post[1:] |= doc[1:] != doc[:-1]
            for i, a, b in _slices(bucket):
                new_pair[a] = new_post[a] = True
                p, q = _starts(new_pair[a:b]), _starts(new_post[a:b])
                word, word_rest = _coded(h[a:b][p], top)
                before, before_rest = _coded(context[a:b][p], top)
                got.append({
                    "bucket": i, "piece": name, "n_docs": n, "word": word, "word_rest": word_rest, "context": before, "context_rest": before_rest,
                    "posts": _raw(np.diff(np.append(np.searchsorted(q, p), len(q))), "u4"), "doc": _raw(doc[a:b][q], "u4"),
                    "times": _raw(np.diff(np.append(q, b - a)), "u4"),
                })
            yield pd.DataFrame(got, columns=columns)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        """Sums of the texts of each piece that have words in the group; the pieces are looked up one by one."""
        counted = group[group["ids"].notna()]
        ids = _joined(counted["ids"], "u8")
        counts = [_joined(counted[c], number) for c in ("pairs", "words", "contexts")]
        got = []
        for r in group[group["ids"].isna()].itertuples(index=False):
            if r.keys is not None:
                got.append((r.piece, r.n_docs, _raw(np.arange(r.n_docs), "u4"), r.keys, r.base, r.score, r.known, r.tokens))
                continue
            at = np.searchsorted(ids, pair_id(_decoded(r.word, r.word_rest, top)[0], _decoded(r.context, r.context_rest, top)[0]))
            n_pair, n_word, n_context = (c[at].astype(np.int64) for c in counts)
            posts, doc, times = (np.frombuffer(x, "u4") for x in (r.posts, r.doc, r.times))
            there, doc = np.unique(doc, return_inverse=True)
            sum_ = lambda x: np.bincount(doc, weights=np.repeat(x, posts) * times, minlength=len(there))  # noqa: B023, E731
            base, score, known = (sum_(x) for x in (log_base(n_word), log_mixed(n_context, n_pair, n_word), (n_word > 0).astype(float)))
            got.append((r.piece, r.n_docs, _raw(there, "u4"), None, base.tobytes(), score.tobytes(), _raw(known, "u4"), None))
        return pd.DataFrame(got, columns=[c.split()[0] for c in SUMMED.split(", ")])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        """Sums of all texts of a piece over the groups of a turn."""
        sums, tokens = {"base": "f8", "score": "f8", "known": "u4"}, 0
        sums = {c: (kind, np.zeros(group["n_docs"].iloc[0])) for c, kind in sums.items()}
        for r in group.itertuples(index=False):
            doc = np.frombuffer(r.doc, "u4")
            for c, (kind, sum_) in sums.items():
                sum_[doc] += np.frombuffer(getattr(r, c), kind)
            if r.keys is not None:
                tokens = tokens + np.frombuffer(r.tokens, "u4").astype("f8")
        heads = group["keys"].dropna()
        keys, tokens = (heads.iloc[0], tokens.tobytes()) if len(heads) else (None, None)
        out = {"piece": group["piece"].iloc[:1].to_numpy(), "heads": len(heads), "keys": [keys], "tokens": [tokens]}
        return pd.DataFrame(out | {c: [sum_.tobytes()] for c, (_, sum_) in sums.items()})[[c.split()[0] for c in ADDED.split(", ")]]

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["keys"].notna()].iloc[0]
        total_of = lambda c: sum(np.frombuffer(x, "f8") for x in group[c] if x is not None) / head["heads"]
        return pd.DataFrame({
            "key": _cut(bytes(head["keys"])), "_base": total_of("base"), "_score": total_of("score"),
            "_known": total_of("known").astype(np.int64), "_tokens": total_of("tokens").astype(np.int64),
        })

    # without a NULL, whole numbers stay whole numbers in pandas
    none = [F.lit(0).cast("long").alias("piece"), F.lit(0).alias("n_docs")]
    parts = []
    for turn, counts in enumerate(counts_of_turns):
        groups = counts.where(F.col("kind") == GROUP).select("bucket", *none, "ids", "pairs", "words", "contexts")
        sent = read.mapInPandas(partial(words_sent, turn=turn), SCORED).unionByName(groups, allowMissingColumns=True)
        sums = sent.groupBy("bucket").applyInPandas(summed, SUMMED).groupBy("piece").applyInPandas(added, ADDED)
        parts.append(stored(sums, "sums"))
        del groups, sent, sums
        discard(counts)
        forget(docs.sparkSession)
    parts = _union(parts)
    sums = parts.groupBy("piece").applyInPandas(merged, "key binary, _base double, _score double, _known bigint, _tokens bigint")
    # rows that repeat may lie in different pieces, which sum up in different order
    sums = sums.groupBy("key").agg(*[F.max(n).alias(n) for n in ("_base", "_score", "_known", "_tokens")])
    rows = rows.select("row", "part", F.unhex("key").alias("key")).join(sums, "key")
    rows = rows.withColumns(
        {
            "held_out": F.col("part") == 1, "n_tokens": F.col("_tokens"), "n_known": F.col("_known"), "train_tokens": F.lit(total).cast("long"),
            "base_score": F.col("_base"), "score": F.col("_score"),
        }
    )
    return unpacked(rows, *new)


def _cut(keys: bytes) -> list[bytes]:
    return [keys[i : i + 16] for i in range(0, len(keys), 16)]
