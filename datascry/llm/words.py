"""Words and hashes of whole texts, vectorised over the bytes of Arrow batches.

Texts are handled as the UTF-8 bytes that Arrow already holds, a small part
of a batch at a time (one longer text alone), so memory follows the longest text and not
the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17

_U = np.uint64
#: Runs of codes are hashed by polynomials modulo the prime 2**61 - 1 in bases
#: fixed here: modulo a power of two there are runs that collide for every odd base.
PRIME = (1 << 61) - 1
_BASE, _OTHER_BASE = 0x16E8FEB86659FD93, 0x0A0761D6478BD642


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: Bytes hashed at once, and for each of their places a number for each byte.
BLOCK = 64
_BYTES, _OTHER_BYTES = (_mixed((np.arange(1, BLOCK * 256 + 1, dtype=_U) + _U(salt << 20)) * _U(0x9E3779B97F4A7C15)) for salt in (1, 2))

#: Bytes that belong to words: all but space and \t to \r.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII digits and lower-case letters, and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

class _Powers(dict):
    """Tables of powers by base; a copy sent to a worker starts empty."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def _folded(x: np.ndarray) -> np.ndarray:
    """Modulo the prime."""
    p = _U(PRIME)
    x = (x & p) + (x >> _U(61))
    return np.where(x >= p, x - p, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, in halves of 31 bits."""
    low, half = _U((1 << 31) - 1), _U(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    return _folded(((a1 * b1) << _U(1)) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << half) + a0 * b0)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base modulo the prime, and their inverses."""
    held = _powers.get(base)
    if held is None or len(held[0]) <= n:
        size = max(n + 1, 1 << 16)
        rows = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, dtype=_U)
            while len(p) < size:
                p = np.concatenate([p, _times(p, _U(pow(b, len(p), PRIME)))])
            rows.append(p[:size])
        held = _powers[base] = (rows[0], rows[1])
    return held


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each ``codes[start:end]``, by content alone."""
    up, down = _power(base, len(codes))
    term = _times(_folded(codes), up[: len(codes)])
    half = _U(30)
    value = _U(0)
    # sums of the upper and lower halves of the terms stay below 2**64
    for part, unit in ((term >> half, 1 << 30), (term & _U((1 << 30) - 1), 1)):
        total = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(part, out=total[1:])
        value = value + _times(_folded(total[ends] - total[starts]), _U(unit))
    return _mixed(_times(_folded(value), down[starts]) + ((ends - starts).astype(_U) << _U(61)))


class Texts:
    """The words of some texts.

    ``starts``/``ends`` are byte offsets of words in ``data``; words ``first[i]``
    to ``first[i + 1]`` are those of text i, which begins at byte ``offsets[i]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = kind[self.data]
        n = len(data)
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self)), self.n_words)

    def hashes(self) -> np.ndarray:
        return byte_spans(self.data, self.starts, self.ends)

    def other_hashes(self) -> np.ndarray:
        return byte_spans(self.data, self.starts, self.ends, _OTHER_BYTES)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of byte spans of ``data`` that ascend and do not overlap."""
        return byte_spans(self.data, starts, ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def byte_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of each ``data[start:end]``; spans ascend and do not overlap.

    Each byte stands for a number of its own at each place of a block; longer
    spans are runs of blocks.
    """
    if not len(starts):
        return np.zeros(0, dtype=_U)
    lo, n = int(starts[0]), len(data)
    place = np.arange(lo, n) - np.repeat(starts, np.diff(np.append(starts, n)))
    place &= BLOCK - 1
    place <<= 8
    place |= data[lo:]
    total = np.zeros(n - lo + 1, dtype=_U)
    np.cumsum(table[place], out=total[1:])
    size = ends - starts
    out = _mixed(total[np.minimum(ends, starts + BLOCK) - lo] - total[starts - lo] + size.astype(_U))
    long = np.flatnonzero(size > BLOCK)
    if len(long):
        blocks = -(-size[long] // BLOCK)
        last = np.cumsum(blocks)
        at = np.repeat(starts[long], blocks) + BLOCK * (np.arange(last[-1]) - np.repeat(last - blocks, blocks))
        upto = np.minimum(at + BLOCK, np.repeat(ends[long], blocks))
        each = _mixed(total[upto - lo] - total[at - lo] + (upto - at).astype(_U))
        out[long] = span_hash(each, last - blocks, last)
    return out


def word_spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of words ``starts`` to ``ends``."""
    return span_hash(hashes, starts, ends)


def other_word_spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same in another base: the two together tell runs apart by 122 bits."""
    return span_hash(hashes, starts, ends, _OTHER_BASE)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, across texts too: mask what straddles."""
    n = max(0, len(hashes) - k + 1)
    at = np.arange(n)
    return word_spans(hashes, at, at + k)


def whole(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n runs of k words lie within one text."""
    ok = np.ones(n, dtype=bool)
    for back in range(1, k):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive values, the leftmost of equal ones.

    Values are compared by their upper 40 bits.
    """
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    if len(values) >= 1 << 24:
        at = np.lib.stride_tricks.sliding_window_view(values >> _U(24), w).argmin(axis=1)
        return at + np.arange(n)
    low = _U((1 << 24) - 1)
    least = (values & ~low) | np.arange(len(values), dtype=_U)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[:n], least[w - width : w - width + n])
    return (least[:n] & low).astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, bytes, offsets)`` for runs of texts of about ``limit`` bytes; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
