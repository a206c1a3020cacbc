"""Vectorised word splitting and hashing shared by the text operators.

A batch of texts is one byte buffer.  Words are the maximal runs outside the
ASCII white space ``[\\x20\\x09-\\x0D]``, or those of letters and digits
(:func:`letter_bounds`).  A word's hash is a polynomial over its
bytes modulo 2**64, read off prefix sums and then mixed, so a batch needs a few
numpy passes and no Python loop over words.  Runs of words are hashed the same
way over their words' hashes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

_BYTE_BASE = 0x9E3779B97F4A7C15
_RUN_BASE = 0xD1342543DE82EF95
_BLOCK = 1 << 20
_TABLES: dict = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64; kept and grown per process."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        size = max(_BLOCK // 4, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _TABLES[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _space_table() -> np.ndarray:
    if "space" not in _TABLES:
        t = np.zeros(256, dtype=bool)
        t[[0x20, *range(0x09, 0x0E)]] = True
        _TABLES["space"] = t
    return _TABLES["space"]


def word_bounds(texts: list[bytes]):
    """``(buffer, starts, ends, counts)``: every word of the batch in order, and the words per text."""
    joined = b" ".join([*texts, b""])
    edge = np.diff(_space_table()[np.frombuffer(joined, dtype=np.uint8)].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return joined, starts, ends, _per_text(texts, starts)


def _per_text(texts: list[bytes], starts: np.ndarray) -> np.ndarray:
    firsts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
    return np.diff(np.searchsorted(starts, firsts))


GAP, LETTER, ALONE, MARK = range(4)
# Blocks of scripts that are written without spaces between words.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)


def _kinds() -> np.ndarray:
    """By code point: a gap, a letter or digit, a letter that is a word by itself, or a mark on the character before."""
    if "kinds" not in _TABLES:
        first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], dtype=np.uint8)
        t = np.zeros(0x110000, dtype=np.uint8)
        t[(first == ord("L")) | (first == ord("N"))] = LETTER
        t[first == ord("M")] = MARK
        for a, b in UNSPACED:
            t[a : b + 1][first[a : b + 1] == ord("L")] = ALONE
        t[[0x3007, *range(0x3021, 0x302A), *range(0x3038, 0x303B)]] = ALONE  # Han numerals
        _TABLES["kinds"] = t
    return _TABLES["kinds"]


def letter_bounds(texts: list[bytes]):
    """As :func:`word_bounds`, words being the runs of Unicode letters and digits with their marks.

    A letter of a script without spaces is a word by itself.
    """
    joined = b" ".join([*texts, b""])
    buf, table = np.frombuffer(joined, dtype=np.uint8), _kinds()
    kind = table[buf]
    begins = np.ones(len(buf), dtype=bool)
    if not joined.isascii():
        kind[buf >= 0x80] = LETTER  # bytes that are no UTF-8
        begins[(buf & 0xC0) == 0x80] = False
        for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
            at = np.flatnonzero((buf >= low) & (buf < high))
            at = at[at + size <= len(buf)]
            for i in range(1, size):
                at = at[(buf[at + i] & 0xC0) == 0x80]
            code = buf[at].astype(np.int64) & (0x7F >> size)
            for i in range(1, size):
                code = code << 6 | buf[at + i] & 0x3F
            found = table[np.minimum(code, 0x10FFFF)]
            for i in range(size):
                kind[at + i] = found
        marks = kind == MARK
        if marks.any():
            begins &= ~marks
            kind = kind[np.maximum.accumulate(np.where(marks, 0, np.arange(len(buf))))]
            kind[kind == MARK] = GAP  # at the very start
    inside = kind != GAP
    alone = kind == ALONE
    was = np.concatenate([[False], inside[:-1]])
    first = inside & (~was | begins & (alone | np.concatenate([[False], alone[:-1]])))
    starts, ends = np.flatnonzero(first), np.flatnonzero(was & (~inside | first))
    return joined, starts, ends, _per_text(texts, starts)


def word_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray, block: int = _BLOCK) -> np.ndarray:
    """A 64-bit hash for each word, in blocks of bytes so that memory stays bounded by the block and the longest word."""
    data = np.frombuffer(buf, dtype=np.uint8)
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + block, "right")))
        hi = ends[b - 1]
        up, down = _power_tables(_BYTE_BASE, int(hi - lo))
        sums = np.zeros(int(hi - lo) + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * down[s]
        a = b
    return mix64(out)


def run_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`run_hash` reads the hash of any run of words."""
    up, _ = _power_tables(_RUN_BASE, max(1, len(hashes)))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words [start, end); equal runs have equal hashes wherever they stand."""
    _, down = _power_tables(_RUN_BASE, len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(texts: list[bytes], most: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text is a range by itself."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as byte strings, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
