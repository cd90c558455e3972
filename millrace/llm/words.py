"""Vectorised word segmentation and hashing over Arrow string columns.

A *word* is a maximal run of letters, digits, marks and other non-separator characters of the lower-cased text;
``WORD`` is the same definition as a regular expression, for brute-force tests and SQL. Everything here works on
whole Arrow buffers in bounded pieces, so the cost is a few nanoseconds a byte and the memory does not follow the
length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x00-/:-@\[-`{-¿ -ⁿ　-〿]+"
WORD_RE2 = r"[^\x00-/:-@\[-`{-\x{bf}\x{2000}-\x{207f}\x{3000}-\x{303f}]+"

U64 = np.uint64
_SEGMENT = 1 << 17
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_NGRAM = U64(0xD6E8FEB86659FD93)

_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW = _powers(_BASE, _SEGMENT + 1)
_INV = _powers(pow(_BASE, -1, 2**64), _SEGMENT + 1)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (a null text is an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(column: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of at most ``limit`` bytes, a longer text alone."""
    offs = offsets(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_string array."""
    offs = offsets(column)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _word_bytes(buf: np.ndarray) -> np.ndarray:
    ok = _ASCII_WORD[buf]
    if len(buf) and buf.max() >= 0x80:
        for lead, second, width in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
            at = np.flatnonzero(buf == lead)
            at = at[at + width <= len(buf)]
            if second is not None:
                at = at[np.isin(buf[at + 1], second)]
            for k in range(width):
                ok[at + k] = False
    return ok


class Words:
    """Words of a column of texts: ``row`` (of each word), ``start``/``end`` (bytes in ``buf``), ``hash``, and
    ``first`` (index of each row's first word, with the total at the end)."""

    __slots__ = ("buf", "end", "first", "hash", "offs", "row", "start")

    def __init__(self, column: pa.Array, lower: bool = True):
        column = strings(column)
        if lower:
            column = pc.utf8_lower(column)
        self.buf, self.offs = raw(column)
        buf, n = self.buf, len(self.buf)
        starts, ends, hashes = [], [], []
        at = 0
        while at < n:
            to = min(n, at + _SEGMENT)
            if to < n:  # cut where a text or an ASCII separator lies, else inside a word that fills the segment
                row = int(np.searchsorted(self.offs, to, side="right")) - 1
                if self.offs[row] > at:
                    to = int(self.offs[row])
                else:
                    gaps = np.flatnonzero(~_ASCII_WORD[buf[at:to]])
                    to = at + int(gaps[-1]) + 1 if len(gaps) else to
            piece = buf[at:to]
            ok = _word_bytes(piece)
            cuts = self.offs[np.searchsorted(self.offs, at) : np.searchsorted(self.offs, to)] - at
            before = np.empty(len(ok), dtype=bool)
            before[0] = False
            before[1:] = ok[:-1]
            before[cuts] = False
            after = np.empty(len(ok), dtype=bool)
            after[-1] = False
            after[:-1] = ok[1:]
            after[cuts[cuts > 0] - 1] = False
            s = np.flatnonzero(ok & ~before)
            e = np.flatnonzero(ok & ~after) + 1
            sums = np.zeros(len(piece) + 1, dtype=U64)
            np.cumsum(_MIX[piece] * _POW[: len(piece)], out=sums[1:])
            hashes.append(finish((sums[e] - sums[s]) * _INV[s]))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        none = [np.zeros(0, np.int64)]
        self.start = np.concatenate(starts or none)
        self.end = np.concatenate(ends or none)
        self.hash = np.concatenate(hashes or [np.zeros(0, U64)])
        self.first = np.searchsorted(self.start, self.offs)
        self.row = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def text(self, a: int, b: int) -> str:
        """Words a to b - 1, joined by single spaces."""
        return " ".join(self.buf[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[a:b], self.end[a:b]))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of all runs of n words within a text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        return at, ngram_hash(self.hash, n)[at]


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values of ``h``, runs across texts included."""
    m = len(h) - n + 1
    g = h[:m].copy()
    for j in range(1, n):
        g *= _NGRAM
        g += h[j : j + m]
    return finish(g)


def ngram_of(words: list[str]) -> int:
    """Hash of one n-gram of words, the same as ``Words.ngrams`` gives."""
    w = Words(pa.array([" ".join(words)], pa.large_string()), lower=False)
    return int(ngram_hash(w.hash, len(words))[0])


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def char_starts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of characters before each byte position."""
    n = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=n[1:])
    return n[at]


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array; ``first`` has each row's start and, last, the total."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
