"""Packing of lengths into bins by the configuration linear program over their histogram.

A configuration is a multiset of lengths that fits into one bin. The program (fewest bins, each length covered as often as it
occurs) has too many configurations to list: prices on the lengths are kept by multiplicative weights, and a knapsack table over
the capacity finds the best configurations at those prices. What is kept here depends on the capacity and the number of rounds,
not on the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np

ROUNDS = 60
PASSES = 6
ETA = 2.0
STEP = 0.25
SLACK = 0.002

Pattern = tuple[int, ...]


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, take) by room: the highest sum of prices of lengths that fit, and the length to put in first. price[n] is that of length n,
    0 for lengths that do not occur and stand for room left empty."""
    best, take = np.zeros(len(price)), np.zeros(len(price), np.int64)
    for room in range(1, len(price)):
        sums = best[:room] + price[room:0:-1]  # lengths from `room` down to 1, the longest of equal ones first
        k = int(sums.argmax())
        best[room], take[room] = sums[k], room - k
    return best, take


def _filled(first: np.ndarray, take: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of lengths per `first`, which starts it, filled up by `take`; 0 for none. No length stands in a row more often than it occurs."""
    room, columns = len(counts) - 1 - first, [first]
    while room.any():
        columns.append(take[room])
        room = room - columns[-1]
    rows = -np.sort(-np.stack(columns, 1), axis=1)
    start = np.concatenate((np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]), axis=1)
    place = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    copy = place - np.maximum.accumulate(np.where(start, place, 0), axis=1)
    return np.where(copy < counts[rows], rows, 0)


def fractional(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[Pattern, float], float]:
    """(bins per configuration, a lower bound on the bins) for `counts` by length; the bins are about as many as the bound, but
    lengths may be covered somewhat less or more often than they occur.

    A round prices lengths by their size and by how far they are covered, and adds all configurations within `SLACK` of the best one,
    so that no length's cover grows by more than `STEP`.
    """
    sizes = np.flatnonzero(counts)
    covered, bins, bound = np.zeros(len(counts)), Counter(), 0.0
    for _ in range(rounds):
        price = np.zeros(len(counts))
        price[sizes] = sizes * np.exp(-ETA * (covered[sizes] - covered[sizes].mean()))
        best, take = knapsack(price)
        bound = max(bound, float((counts * price).sum() / best[-1]))
        value = price[sizes] + best[len(counts) - 1 - sizes]
        rows = _filled(sizes[value >= (1 - SLACK) * best[-1]], take, counts)
        rows = np.unique(-np.sort(-rows, axis=1), axis=0)
        use = np.bincount(rows.ravel(), minlength=len(counts))
        share = np.where(rows > 0, counts[rows] / np.maximum(use[rows], 1), np.inf).min(axis=1) * STEP
        covered += np.bincount(rows.ravel(), np.repeat(share, rows.shape[1]), len(counts)) / np.maximum(counts, 1)
        for row, n in zip(rows.tolist(), share.tolist()):
            bins[tuple(x for x in row if x)] += n
    scale = bound / sum(bins.values())
    return {p: n * scale for p, n in bins.items()}, bound


def _best_fit(left: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Bins per pattern for `left` (count by length): longest first, into the fullest bin with room; equal bins are filled together."""
    rooms: list[int] = []
    open_: dict[int, Counter[Pattern]] = {}

    def put(pattern: Pattern, n: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][pattern] += n

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(n, capacity // size)
                put((size,) * each, n // each)
                n %= each
                continue
            room = rooms[at]
            pattern, have = next(iter(open_[room].items()))
            each = min(n, room // size)
            used = min(have, n // each)
            if used == have:
                del open_[room][pattern]
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                open_[room][pattern] -= used
            put(pattern + (size,) * each, used)
            n -= used * each
    return sum(open_.values(), Counter())


def _rounded(counts: np.ndarray, least_fill: float) -> Counter[Pattern]:
    """Bins that hold `counts` exactly: the program's, rounded down, then the program's for what is left, at last best fit.

    Bins less full than `least_fill` of the bound's are not taken from the program.
    """
    out: Counter[Pattern] = Counter()
    counts = counts.copy()
    for _ in range(PASSES):
        if not counts.any():
            break
        found, bound = fractional(counts)
        usual, packed = float((counts * np.arange(len(counts))).sum()) / bound, 0
        for pattern, n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if sum(pattern) < least_fill * usual:
                continue
            need = Counter(pattern)
            whole = min(int(n), *(int(counts[size]) // k for size, k in need.items()))
            if whole:
                out[pattern] += whole
                packed += whole
                for size, k in need.items():
                    counts[size] -= whole * k
        if not packed:
            break
    return out + _best_fit({int(size): int(counts[size]) for size in np.flatnonzero(counts)}, len(counts) - 1)


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(lengths of a bin, number of such bins) that hold each length of `histogram` (1 to `capacity`) exactly as often as it occurs.

    The program's solution is rounded in two ways, with all of its bins (best where many are alike) and without those that rare
    lengths left less full (best where few are); the one with fewer bins is kept.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    full = Counter({(capacity,): int(counts[capacity])} if counts[capacity] else {})
    counts[capacity] = 0
    ways = [_rounded(counts, least_fill) for least_fill in (1 - SLACK, 0.0)]
    return sorted((full + min(ways, key=lambda bins: bins.total())).items(), reverse=True)
