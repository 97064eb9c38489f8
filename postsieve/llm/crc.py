"""CRC-32 of many spans of a byte buffer at once, by a table of what each byte adds at each distance from the end.

A CRC is linear but for a constant: the CRC of a span is the XOR of what its bytes add, each by its value and its distance from
the span's end, and of a constant of its length. Spans longer than the table are cut into blocks from their end, and neighbouring
blocks are folded into each other.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320  # reflected, as in zip archives
REACH = 64
AT_ONCE = 1 << 19


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


STEP = _byte_table()


def position_table(reach: int = REACH) -> np.ndarray:
    """[distance from the end, byte]: what the byte adds there. A step further from the end is a zero byte more behind it."""
    rows = [STEP]
    for _ in range(reach - 1):
        rows.append((rows[-1] >> 8) ^ STEP[rows[-1] & 255])
    return np.stack(rows)


TABLE = position_table()


def _moved(shift: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`x` with the zero bytes of `shift` behind it; [k, byte] of a shift says where byte k of a value goes."""
    return shift[0][x & 255] ^ shift[1][(x >> 8) & 255] ^ shift[2][(x >> 16) & 255] ^ shift[3][x >> 24]


def _shifts(bits: int = 48) -> list[np.ndarray]:
    """Shifts by 1, 2, 4, ... zero bytes, each by doing the one before twice."""
    bytes_ = np.arange(256, dtype=np.uint32)
    values = np.stack([bytes_ << np.uint32(8 * k) for k in range(4)])
    out = [(values >> 8) ^ STEP[values & 255]]
    while len(out) < bits:
        out.append(_moved(out[-1], out[-1]))
    return out


SHIFTS = _shifts()


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """What the CRC of that many zero bytes is: the start value, moved over the length, and inverted."""
    out = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    left, bit = lengths.astype(np.int64), 0
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _moved(SHIFTS[bit], out[odd])
        left, bit = left >> 1, bit + 1
    return ~out


CONSTANTS = length_constants(np.arange(REACH + 1))


def _added(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of what the bytes of each span add; spans are not empty and not longer than the table."""
    sizes = end - first
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(len(first), np.uint32)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + AT_ONCE, side="right")) - 1)
        own = starts[a:b] - starts[a]
        at = np.arange(starts[b] - starts[a]) + np.repeat(first[a:b] - own, sizes[a:b])
        distance = np.repeat(end[a:b] - 1, sizes[a:b]) - at
        out[a:b] = np.bitwise_xor.reduceat(TABLE[distance, data[at]], own)
        a = b
    return out


def _folded(data: np.ndarray, first: int, end: int) -> int:
    """What a long span adds: blocks of the table's length from its end, neighbours folded until one is left."""
    ends = np.arange(end, first, -REACH)
    blocks = _added(data, np.maximum(ends - REACH, first), ends)
    bit = REACH.bit_length() - 1
    while len(blocks) > 1:
        nearer, farther = blocks[0::2].copy(), blocks[1::2]
        nearer[: len(farther)] ^= _moved(SHIFTS[bit], farther)
        blocks, bit = nearer, bit + 1
    return int(blocks[0])


def span_crcs(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 (unsigned) of data[first:end] for each span; spans may overlap, an empty one has 0."""
    sizes = end - first
    out = np.zeros(len(first), np.uint32)
    short = (sizes > 0) & (sizes <= REACH)
    out[short] = _added(data, first[short], end[short]) ^ CONSTANTS[sizes[short]]
    long_ = np.flatnonzero(sizes > REACH)
    for i in long_:
        out[i] = _folded(data, int(first[i]), int(end[i]))
    out[long_] ^= length_constants(sizes[long_])
    return out
