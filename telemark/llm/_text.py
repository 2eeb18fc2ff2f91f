"""Vectorised kernels over Arrow text columns, shared by the text operators.

Everything here works on one block of whole texts: the concatenated UTF-8 bytes
of some rows and the offsets of each row.  Blocks are about a megabyte, so the
memory of a task doesn't depend on the size of its partition (one text larger
than a block is a block of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
#: Low bits of a packed minimum that hold a position; the others order anchors.
POSITION_BITS = 24

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Block(NamedTuple):
    first: int  #: row of the batch that the block starts with
    data: np.ndarray  #: uint8
    offsets: np.ndarray  #: int64, one more than rows


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole rows of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield Block(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.view(np.uint8) << 5)


def _table(spans: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for lo, hi in spans:
        table[lo : hi + 1] = False
    return table


#: Bytes of words that are separated by ASCII white space.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of words of ASCII letters, digits and any other character over U+007F.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  #: of each row's words


def words(block: Block, table: np.ndarray) -> Words:
    """Maximal runs of the table's bytes within each row (all multi-byte characters are in both tables)."""
    data, offsets = block.data, block.offsets
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return Words(starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Sequences are hashed modulo this prime.
PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_U30, _U31, _U61 = np.uint64(30), np.uint64(31), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & PRIME) + (x >> _U61)
    return x - np.where(x >= PRIME, PRIME, np.uint64(0))


def _shifted31(x: np.ndarray) -> np.ndarray:
    """x * 2 ** 31, under 2 ** 62 and right modulo the prime; x is under 2 ** 62."""
    return ((x & _LOW30) << _U31) + (x >> _U30)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo the prime, from halves."""
    a1, a0, b1, b0 = a >> _U31, a & _LOW31, b >> _U31, b & _LOW31
    return _reduced(((a1 * b1) << np.uint64(1)) + _shifted31(a1 * b0 + a0 * b1) + a0 * b0)


_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int, base: int, kind: str) -> np.ndarray:
    """1, base, base ** 2 ... : modulo the prime, or with kind "wrap" modulo 2 ** 64."""
    key = f"{kind}{base}"
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, BLOCK_BYTES + 1) if kind == "wrap" else n + (n >> 2) + 1024
        if kind == "wrap":
            p = np.full(size, base, np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
        else:
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate((p, times(p, np.uint64(pow(base, len(p), int(PRIME))))))
        _powers[key] = p
    return _powers[key][:n]


class Roll:
    """Hashes of any stretches of a sequence of 64-bit units: a polynomial modulo a prime, from prefix sums.

    Two different sequences have the same hash by chance alone, whatever repeats in them.
    """

    _BASE = int(_BASE) % int(PRIME)
    _INVERSE = pow(_BASE, -1, int(PRIME))

    def __init__(self, units: np.ndarray):
        n = len(units) + 1
        self._down = _powers_to(n, self._INVERSE, "prime")
        terms = times(_reduced(units), _powers_to(n, self._BASE, "prime")[:-1])
        self._high, self._low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.cumsum(terms >> _U31, out=self._high[1:])
        np.cumsum(terms & _LOW31, out=self._low[1:])

    def _of(self, high: np.ndarray, low: np.ndarray, down: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(times(_reduced(_shifted31(high) + low), down) + size * _BASE)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._of(self._high[ends] - self._high[starts], self._low[ends] - self._low[starts], self._down[starts], (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of the k units from each place on."""
        n = len(self._low) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return self._of(self._high[k:] - self._high[:n], self._low[k:] - self._low[:n], self._down[:n], np.array([k], np.uint64))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class ByteMarks:
    """Cheap hashes of the grams of a block's bytes: a polynomial modulo 2 ** 64.

    Periodic and other regular sequences can collide, so they only propose: whoever uses
    them compares the bytes themselves, or a hash of another kind.
    """

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self._down = _powers_to(n, int(_BASE_INVERSE), "wrap")
        self._sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _powers_to(n, int(_BASE), "wrap")[:-1], out=self._sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self._sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[k:] - self._sums[:n]) * self._down[:n] + np.uint64(k))


def byte_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit XXH3 hashes of stretches of bytes."""
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


#: Words are hashed in lanes of eight bytes up to this length, longer ones one by one.
LANE_BYTES = 64


def word_hashes(block: Block, w: Words) -> np.ndarray:
    """64-bit hashes of words: every lane is mixed into all bits before the next one."""
    size = w.ends - w.starts
    out = mix(size.astype(np.uint64) * _BASE)
    padded = np.concatenate((block.data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(block.data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero(size <= LANE_BYTES)
    for k in range(0, LANE_BYTES, 8):
        left = left[size[left] > k] if k else left
        if not len(left):
            break
        lane = lanes[w.starts[left] + k]
        part = size[left] - k
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(8 - part, 0).astype(np.uint64))
        out[left] = mix(out[left] ^ (lane * np.uint64(0xD1342543DE82EF95)))
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(block.data[w.starts[i] : w.ends[i]], digest_size=8).digest(), "little")
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the width values from each place on, by minima from both ends of fixed stretches."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Stretches(NamedTuple):
    """Runs of consecutive windows that share their anchor's place; units count from the block's start."""

    start: np.ndarray  #: first window's first unit
    windows: np.ndarray  #: number of windows
    anchor: np.ndarray  #: first unit of the anchor
    key: np.ndarray  #: the anchor's hash
    row: np.ndarray


def stretches(roll: Roll | ByteMarks, offsets: np.ndarray, window: int, anchor: int) -> Stretches:
    """Deal all windows of each row to the least anchor gram inside them, leftmost on ties.

    The anchor is a function of a window's content alone, so equal windows have
    equal anchors at equal distances from their start.  A run holds at most
    window - anchor + 1 windows.
    """
    grams = roll.grams(anchor)
    width = window - anchor + 1
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    parts: list[tuple[np.ndarray, ...]] = []
    piece = (1 << POSITION_BITS) - width
    low = np.uint64((1 << POSITION_BITS) - 1)
    for lo in range(0, max(len(grams) - width + 1, 0), piece):
        hi = min(lo + piece, len(grams) - width + 1)
        part = grams[lo : hi + width - 1]
        packed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        least = (sliding_min(packed, width) & low).astype(np.int64) + lo
        valid = np.zeros(hi - lo, bool)
        first = np.searchsorted(offsets, [lo, hi], "right") - 1
        rows = np.arange(max(first[0], 0), min(first[1] + 1, len(count)))
        change = np.zeros(hi - lo + 1, np.int64)
        begin, end = np.clip(offsets[rows] - lo, 0, hi - lo), np.clip(offsets[rows] + count[rows] - lo, 0, hi - lo)
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        valid = np.cumsum(change[:-1]) > 0
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        places = least[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (places[1:] != places[:-1]) | (at[1:] != at[:-1] + 1)
        begins = np.flatnonzero(fresh)
        parts.append((at[begins] + lo, np.diff(np.append(begins, len(at))), places[begins]))
    if not parts:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, np.zeros(0, np.uint64), none)
    start, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Stretches(start, n, place, grams[place], np.searchsorted(offsets, start, "right") - 1)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n units that lie in any of the half-open stretches."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
