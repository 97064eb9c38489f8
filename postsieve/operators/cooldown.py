"""Fixed windows per key: an accepted row blocks its key for a TTL, blocked rows do
not extend it. The rule of expiring dedup keys and of incident cool-downs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# TTLs in a segment of time; the segments of a key are walked side by side.
SEGMENT_TTLS = 16


def _stretch(t: str, length: int) -> Column:
    """Number of the stretch of `length` microseconds that a time lies in, without rounding."""
    return F.expr(f"({t} - pmod({t}, {length}L)) div {length}L")


def accept_per_ttl(
    rows: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    ttl_seconds: int,
    blocked: DataFrame | None = None,
    segment_ttls: int = SEGMENT_TTLS,
) -> DataFrame:
    """Accepted rows as (key, ts, row_id); equal times are settled by the lower id.

    `blocked` (key, blocked_until) carries earlier acceptances into this call; each blocks
    its key for the TTL before `blocked_until`. Rows inside of a block are dropped first
    and the rest depends on this input only, so a late row before all blocks is accepted.

    The walk along a key is sequential, so time is cut into segments of `segment_ttls` TTLs
    that are walked side by side: a first pass tells which block leaves a segment for each
    block that may enter it, these are chained per key, and a second pass walks each segment
    from the block that does enter it.
    """
    ttl = ttl_seconds * 1_000_000
    slim = rows.select(
        F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(row_id).alias("id")
    ).where("k is not null")
    if blocked is not None:
        # a block lies in two stretches of a TTL at most: equal stretches meet, which spreads a hot key over time;
        # only blocks of stretches at hand matter, as the state outgrows the input
        slim = slim.withColumn("w", _stretch("t", ttl))
        blocks = blocked.select(F.col(key).alias("k"), F.unix_micros("blocked_until").alias("u")).distinct()
        first = _stretch("u", ttl) - 1
        blocks = blocks.select("k", "u", F.explode(F.array(first, first + 1)).alias("w"))
        blocks = blocks.join(slim.select("k", "w").distinct(), ["k", "w"], "left_semi")
        blocks = blocks.select(F.col("k").alias("bk"), F.col("w").alias("bw"), "u")
        inside = F.expr(f"k = bk and w = bw and t >= u - {ttl} and t < u")
        slim = slim.join(blocks, inside, "left_anti").select("k", "t", "id")

    # dealt once: both passes read the same shuffle, so both take all its columns
    slim = slim.withColumn("s", _stretch("t", ttl * segment_ttls)).repartition("k", "s")
    entries = _entries(_exits(slim, ttl, segment_ttls), ttl * segment_ttls)
    accepted = _walk(slim, entries, ttl)
    return accepted.select(
        F.col("k").alias(key), F.timestamp_micros("t").alias(ts), F.col("id").alias(row_id)
    )


class _Segment:
    """The blocks that leave a segment, by the time of the first row a chain of acceptances
    has in it. Rows come from the last to the first; neighbours with the same outcome are
    one piece, named by its last time."""

    def __init__(self, ttl: int):
        self.ttl, self.window = ttl, None
        self.now = self.later = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, t: np.ndarray) -> None:
        """Take in falling times. A row of a TTL-long window is followed by one of a later window."""
        window = t // self.ttl
        edges = [0, *(np.flatnonzero(window[1:] != window[:-1]) + 1), len(t)]
        for a, b in zip(edges, edges[1:]):
            if window[a] != self.window:
                self.window, self.later = window[a], self.pieces()
                self.now = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            times = t[a:b][::-1]
            ends, (starts, outcome) = times + self.ttl, self.later
            at = np.searchsorted(starts, ends)
            if len(starts):
                ends = np.where(at < len(starts), outcome[np.minimum(at, len(starts) - 1)], ends)
            times, ends = np.concatenate((times, self.now[0])), np.concatenate((ends, self.now[1]))
            last = np.append(ends[1:] != ends[:-1], True)
            self.now = times[last], ends[last]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Times and outcomes of the earliest window, and the first of the window after it."""
        (t, u), (later_t, later_u) = self.now, self.later
        return np.concatenate((t, later_t[:1])), np.concatenate((u, later_u[:1]))


def _whole_segments(group: np.ndarray, t: np.ndarray, s: np.ndarray, ttl: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and outcomes of the pieces of segments (numbered from 0 by `group`, with rising times) that lie here as a whole.

    Each row points at the first row that it does not block; a chain has at most a step per TTL, and pointers are doubled.
    """
    place = group * (span + ttl) + (t - s * span)
    after = np.searchsorted(place, place + ttl)
    inside = np.minimum(after, len(t) - 1)
    onward = np.where((after < len(t)) & (group[inside] == group), inside, np.arange(len(t)))
    while (further := onward[onward]).tobytes() != onward.tobytes():
        onward = further
    outcome = t[onward] + ttl
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    window = t // ttl
    earliest = window == window[starts][group]
    # the last row of each outcome in the earliest window, and the first row after that window
    last = np.append((outcome[1:] != outcome[:-1]) | ~earliest[1:] | (group[1:] != group[:-1]), True)
    later = ~earliest & np.append(False, earliest[:-1] & (group[1:] == group[:-1]))
    rows = np.flatnonzero((earliest & last) | later)
    return rows, outcome[rows]


def _exits(slim: DataFrame, ttl: int, segment_ttls: int) -> DataFrame:
    """(k, s, t, u): a chain whose first row in segment s is at t, or between the time before
    and t, leaves a block until u. Segments that no block leaves have no rows here."""
    span = ttl * segment_ttls

    def pieces(group: tuple, segment: _Segment) -> pd.DataFrame:
        t, u = segment.pieces()
        return pd.DataFrame({"k": [group[0]] * len(t), "s": group[1], "t": t, "u": u})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, segment = None, None
        for batch in batches:
            if batch.empty:
                continue
            k, s, t = (batch[c].to_numpy() for c in ("k", "s", "t"))
            edges = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]), [True])))
            starts, ends = edges[:-1], edges[1:]
            # a block leaves if the last row's does
            leaves = t[starts] + ttl > (s[starts] + 1) * span
            if (k[0], s[0]) == group:
                leaves[0] = segment is not None
            elif segment is not None:
                yield pieces(group, segment)
                segment = None
            whole = leaves.copy()
            whole[[0, -1]] = False  # these may go on in the batches before and after
            chosen = np.flatnonzero(whole)
            most = max(1, (1 << 62) // (span + ttl))  # segments told apart by one number
            for at in range(0, len(chosen), most):
                some = chosen[at : at + most]
                sizes = ends[some] - starts[some]
                group_of = np.repeat(np.arange(len(some)), sizes)
                first = np.cumsum(sizes) - sizes
                # rising times: each segment's rows from the last to the first
                row = ends[some][group_of] - 1 - (np.arange(len(group_of)) - first[group_of])
                kept, u = _whole_segments(group_of, t[row], s[row], ttl, span)
                yield pd.DataFrame({"k": k[row[kept]], "s": s[row[kept]], "t": t[row[kept]], "u": u})
            for i in np.flatnonzero(leaves & ~whole):
                if (here := (k[starts[i]], s[starts[i]])) != group or segment is None:
                    if segment is not None:
                        yield pieces(group, segment)
                    group, segment = here, _Segment(ttl)
                segment.add(t[starts[i] : ends[i]])
            if (k[-1], s[-1]) != group:
                if segment is not None:
                    yield pieces(group, segment)
                group, segment = (k[-1], s[-1]), None
        if segment is not None:
            yield pieces(group, segment)

    falling = slim.sortWithinPartitions("k", "s", F.col("t").desc())
    kind = slim.schema["k"].dataType.simpleString()
    return falling.mapInPandas(rows, f"k {kind}, s bigint, t bigint, u bigint")


def _entries(exits: DataFrame, span: int) -> DataFrame:
    """(k, s, u): the block that enters segment s of a key, where one does."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, entry, left = None, None, None
        for batch in batches:
            got = []
            for k, s, t, u in zip(batch["k"], batch["s"], batch["t"], batch["u"]):
                if (k, s) != group:
                    entry = left if group == (k, s - 1) else None
                    group, left = (k, s), None
                if left is None and (entry is None or t >= entry):
                    left = u
                    if u > (s + 1) * span:
                        got.append((k, s + 1, u))
            yield pd.DataFrame(got, columns=["k", "s", "u"])

    kind = exits.schema["k"].dataType.simpleString()
    by_key = exits.repartition("k").sortWithinPartitions("k", "s", "t")
    return by_key.mapInPandas(rows, f"k {kind}, s bigint, u bigint")


def _walk(slim: DataFrame, entries: DataFrame, ttl: int) -> DataFrame:
    """One pass over rows sorted by key, segment and time, each with the end of its segment's entering block, if any;
    only the current segment and the end of its block are remembered, across Arrow batches too."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, until = None, 0
        for batch in batches:
            k, s, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "s", "t"))
            entering = batch.column("u").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            new, kept = (k[1:] != k[:-1]) | (s[1:] != s[:-1]), []
            edges = [0, *(np.flatnonzero(new) + 1), len(k)] if len(k) else []
            for pos, end in zip(edges, edges[1:]):
                if (k[pos], s[pos]) != current:
                    current, until = (k[pos], s[pos]), entering[pos]
                # one step per accepted row, past all rows it blocks
                while (pos := pos + np.searchsorted(t[pos:end], until)) < end:
                    kept.append(pos)
                    until = t[pos] + ttl
            yield batch.take(pa.array(kept, pa.int64()))

    both = slim.join(entries.hint("merge"), ["k", "s"], "left")
    by_segment = both.sortWithinPartitions("k", "s", "t", "id")
    return by_segment.mapInArrow(keep, by_segment.schema).select("k", "t", "id")
