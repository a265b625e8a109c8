"""Words of whole Arrow text columns as arrays of 64-bit hashes.

A word is a longest run of bytes other than ASCII white space (20, 09-0D),
after A-Z are lower-cased. UTF-8 never uses those bytes inside another
character, so bytes and characters give the same words. All work is on the
column's byte buffer; no Python object is made for a word.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R, _R_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_power: dict[int, np.ndarray] = {}
#: Bytes of text that are worked on at a time; one longer text goes alone.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE + 1), base, np.uint64)
        full[0] = 1
        np.multiply.accumulate(full, out=full)
        if len(full) > 8 * SLICE:
            return full
        have = _power[base] = full
    return have[:n]


class Words:
    """Words of a slice of a column: `hash[bounds[i]:bounds[i + 1]]` are row i's;
    `start` and `end` are their places in `data`."""

    def __init__(self, column: pa.Array, lower: bool = True, cut_tail: bool = False):
        """cut_tail: a full stop or comma that ends a word after an ASCII letter is a word of its own."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.raw = raw[edges[0] : edges[-1]]
        self.edges = edges - edges[0]
        self.data = (_LOWER if lower else _SAME)[self.raw]
        solid = np.zeros(len(self.data) + 2, bool)
        solid[1:-1] = ~_SPACE[self.data]
        first = solid[1:] & ~solid[:-1]
        last = solid[:-1] & ~solid[1:]
        inner = self.edges[1:-1]
        first[inner] = solid[inner + 1]
        last[inner] |= solid[inner]
        if cut_tail:
            stop = last[1:] & _STOP[self.data]
            stop[1:] &= _LETTER[self.data[:-1]] & solid[1:-2] & ~first[1:-1]
            stop[:1] = False
            cut = np.flatnonzero(stop)
            first[cut] = last[cut] = True
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last)
        self.bounds = np.searchsorted(self.start, self.edges)
        self._sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_R, len(self.data)), out=self._sums[1:])
        self._back = _powers(_R_INVERSE, len(self.data) + 1)[self.start]
        self.hash = mix((self._sums[self.end] - self._sums[self.start]) * self._back)

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of the words' first k bytes; a word of at most k bytes has its own hash."""
        short = self.end - self.start <= k
        head = (self._sums[np.minimum(self.start + k, self.end)] - self._sums[self.start]) * self._back
        return np.where(short, self.hash, mix(head ^ _U(k << 56)))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about SLICE bytes of text."""
    if not len(batch):
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def shingles(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, and each row's bounds in
    them. A row of 1 to k-1 words has its whole sequence as one shingle."""
    h, b = words.hash, words.bounds
    counts = np.diff(b)
    many = np.maximum(counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - b[:-1], many)
    left = np.repeat(b[1:], many) - at
    value = np.full(len(at), mix(np.array([seed + k], np.uint64))[0])
    for j in range(k):
        there = left > j
        step = mix(value * _U(_R) + h[np.minimum(at + j, max(len(h) - 1, 0))]) if len(h) else value
        value = np.where(there, step, value)
    return value, out
