"""Packing (13): pieces against a plain version, sequences without gaps, bins against volume and exact minima."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from struct import pack as bytes_of

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import same
from postsieve.llm import packing
from postsieve.llm.configurations import fractional, knapsack, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        at, piece = 0, 0
        while at < len(ids):
            own = ids[at : at + (capacity if at else first)]
            out.append((key, piece, at, len(own), zlib.crc32(bytes_of(f"<{len(own)}I", *own))))
            at, piece = at + len(own), piece + 1
    return out


@pytest.mark.parametrize("capacity", [2048, 100, 1])
def test_pack_documents(docs, capacity):
    if capacity == 1:
        docs = docs.where("length(text) < 100 or text is null")
    out = packing.pack_documents(docs, PATH, capacity=capacity).persist()
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], capacity)
    same(out, expected, ["doc_id", "piece", "start", "length", "ids_crc32"])
    sequences = defaultdict(list)
    for r in out.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    volume = -(-sum(r[3] for r in expected) // capacity)
    assert len(sequences) <= volume * 1.01 + 1
    assert "text" not in out.columns and {"source", "key", "size"} <= set(out.columns)
    out.unpersist()


def test_no_documents(empty):
    assert packing.pack_documents(empty, PATH).count() == 0


def test_encoders_agree(docs):
    texts = [r["text"] or "" for r in docs.collect()]
    own = packing.Encoder(PATH)
    assert own.ranks is not None
    fast = own.ids(texts)
    own.ranks = None
    assert all(a.tolist() == b.tolist() for a, b in zip(fast, own.ids(texts)))


def test_other_files_use_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.Encoder(path)
    assert own.ranks is None
    assert own.ids(["Hello there", ""])[0].tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(12, 14))
def test_few_lengths(histogram, capacity):
    """Every length is packed; no more bins than one above the exact minimum, and none below the bound."""
    bins = pack(histogram, capacity)
    held = Counter()
    for lengths, n in bins:
        assert n > 0 and sum(lengths) <= capacity
        for length in lengths:
            held[length] += n
    assert held == Counter(histogram)
    items = tuple(sorted(Counter(histogram).elements(), reverse=True))
    used = sum(n for _, n in bins)
    if items:
        counts = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            counts[length] = n
        assert used >= fractional(counts)[1] - 1e-9
    if len(items) <= 9:
        assert used <= fewest(items, capacity) + 1


def fewest(items, capacity):
    """Exact minimum, by trying all places."""

    @lru_cache(maxsize=None)
    def search(i, rooms):
        if i == len(items):
            return len(rooms)
        best = search(i + 1, tuple(sorted((*rooms, capacity - items[i]))))
        for room in set(rooms):
            if room >= items[i]:
                left = list(rooms)
                left.remove(room)
                best = min(best, search(i + 1, tuple(sorted((*left, room - items[i])))))
        return best

    return search(0, ())


def test_knapsack():
    price = np.zeros(11)
    price[[3, 4, 7]] = [3.0, 4.5, 8.5]
    best, take = knapsack(price)
    assert best[10] == 11.5 and best[8] == 9.0 and best[2] == 0
    assert take[8] == 4


def test_program_beats_best_fit():
    """Triples that fill a bin, which longest-first packing tears apart."""
    histogram = {44: 600, 30: 600, 26: 600}
    assert sum(n for _, n in pack(histogram, 100)) == 600
    histogram = {51: 300, 27: 300, 26: 300, 23: 600}  # (51, 26, 23) and (51, 27, ...) by turns
    assert sum(n for _, n in pack(histogram, 100)) <= 460
