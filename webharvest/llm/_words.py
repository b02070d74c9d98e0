"""Vectorised word hashing over Arrow string columns, shared by the word-based operators.

A word is a maximal run of ASCII letters, ASCII digits, underscores and non-ASCII characters of the
lower-cased text; everything else separates words.  Hashes depend on the bytes alone, so they agree
between executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), 95, *range(97, 123), *range(128, 256)]] = True
_TERM = _WORD.copy()
_TERM[95] = False
_SOLID = np.ones(256, dtype=bool)
_SOLID[[*range(9, 14), 32]] = False
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text that one vectorised step handles; bounds the scratch memory of a Python worker: some forty times as much.
STEP_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            row = np.full(size, np.uint64(base), np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def hash_strings(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each string, the same in every process; a null counts as an empty one."""
    raw, offs = text_buffers(texts)
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return mix((sums[offs[1:]] - sums[offs[:-1]]) * inverse[offs[:-1]])


def count_terms(texts: pa.Array) -> np.ndarray:
    """Terms of each text, as Words finds them with `terms`."""
    raw, offs = text_buffers(texts)
    w = _TERM[raw | ((raw >= 65) & (raw <= 90)) * np.uint8(32)]
    first = w.copy()
    first[1:] &= ~w[:-1]
    inner = offs[offs < len(raw)]
    first[inner] = w[inner]
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(first, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text gets a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield lo, k
            lo, total = k, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


class Words:
    """The words of a string array: hash, row, byte range.

    By default words of the lower-cased texts; with `spaced`, the tokens between white space as they stand; with
    `terms`, words without underscores of the texts lower-cased in A-Z only.
    """

    def __init__(self, texts: pa.Array, spaced: bool = False, terms: bool = False):
        texts = pc.fill_null(texts, "")
        raw, offs = text_buffers(texts if spaced else pc.ascii_lower(texts) if terms else pc.utf8_lower(texts))
        n = len(raw)
        self.rows = len(offs) - 1
        w = (_SOLID if spaced else _TERM if terms else _WORD)[raw]
        first, last = w.copy(), w.copy()
        if n:
            first[1:] &= ~w[:-1]
            last[:-1] &= ~w[1:]
            inner = offs[(offs > 0) & (offs < n)]
            first[inner] = w[inner]
            last[inner - 1] = w[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, self._inverse = _powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sums[1:])
        self.hash = self.span(self.start, self.end)
        #: word index at which each row begins; the last entry is the number of words
        self.first = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        self.raw, self.offsets = raw, offs

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, word position in the row) of every run of n words.

        A text of 1 to n-1 words has one shingle made of all its words; a text without words has none.
        """
        h, row = self.hash, self.row
        m = max(0, len(h) - n + 1)
        g = np.zeros(m, np.uint64)
        for k in range(n):
            g += h[k : k + m] * np.uint64(2 * pow(0x632BE59BD9B4E019, k + 1, 1 << 63) + 1)
        whole = row[:m] == row[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        g, of = mix(g[at]), row[at]
        pos = at - self.first[:-1][of]
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            extra = np.array(
                [
                    mix(np.array([np.sum(h[a:b] * np.arange(3, 3 + 2 * (b - a), 2, dtype=np.uint64)) + np.uint64(n)], np.uint64))[0] for a,
                    b in zip(self.first[short], self.first[short + 1])
                ],
                np.uint64
            )
            g, of, pos = np.concatenate([g, extra]), np.concatenate([of, short]), np.concatenate([pos, np.zeros(len(short), pos.dtype)])
            order = np.argsort(of, kind="stable")
            g, of, pos = g[order], of[order], pos[order]
        return g, of, pos
