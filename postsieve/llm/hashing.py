"""Whole batches of texts cut into word hashes with array operations, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted modulo 2^64
BATCH_BYTES = 2_000_000
PIECE = 1 << 19


def byte_classes(separators: Iterable[int]) -> np.ndarray:
    """Per byte: 0 for a separator, else the byte itself, A-Z lower-cased."""
    classes = np.arange(256, dtype=np.uint8)
    classes[65:91] += 32
    classes[list(separators)] = 0
    return classes


#: Words end at white space, or at everything in ASCII that is no letter or digit.
SPACED = byte_classes([0x20, *range(0x09, 0x0E)])
SPACED[0] = 1  # NUL is a word character there
PLAIN = byte_classes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str | None], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of `texts` in order, and the offsets of the texts in them (one more than texts)."""
    hashes, offsets, _ = words_and_ends(texts, classes)
    return hashes, offsets


def words_and_ends(texts: list[str | None], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `word_hashes`, and a number below 2^16 made of the last two bytes of each word."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    hashes, firsts, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        # a piece ends between words, so that the arrays for a piece stay small beside those for a text
        stop = at + PIECE
        while stop < len(data) and classes[data[stop]]:
            stop += 1
        h, first, end = _piece(data[at:stop], classes)
        hashes.append(h)
        firsts.append(first + at)
        ends.append(end)
        at = stop
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    offsets = np.searchsorted(np.concatenate(firsts), np.concatenate(([0], np.cumsum(lengths))))
    return np.concatenate(hashes), offsets, np.concatenate(ends)


def _piece(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end numbers of the words of some bytes."""
    kept = classes[data]
    edges = np.diff(np.concatenate(([0], (kept != 0).view(np.int8), [0])))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(max(PIECE * 2, 1 << (len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(kept * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    ends = kept[end - 1].astype(np.int64) * 256 + kept[np.maximum(end - 2, first)] if len(end) else np.zeros(0, np.int64)
    return hashes, first, ends


def in_batches(texts: list[str | None], size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `size` characters; a longer text has a range of its own."""
    start, sum_ = 0, 0
    for i, t in enumerate(texts):
        if i > start and sum_ + len(t or "") > size:
            yield start, i
            start, sum_ = i, 0
        sum_ += len(t or "")
    if start < len(texts):
        yield start, len(texts)
