"""Words and word n-grams of Arrow text columns as 64-bit hashes, computed on whole buffers in numpy.

A word is a run of ASCII letters, digits and underscores and of any characters beyond ASCII, in lower
case: in SQL, [0-9A-Za-z_\\x{80}-\\x{10FFFF}]+ over lower(text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words for regular expressions of Java, RE2 and Python's re (the last with \\x80-\\U0010ffff).
WORD_SQL = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+"

_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
LOW48 = np.uint64((1 << 48) - 1)


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _INVERSE
        size = max(n, 1 << 20)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _POWERS[kind] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each hash over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, most: int = 1 << 18, rows: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of so many rows at most and of about that many bytes; a longer text makes a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case texts: a hash for each word, its first and last byte (exclusive), and n + 1 offsets of the texts in words."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _WORD[raw]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    ends = inside[:n] & ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", n), dtype=np.uint64, out=sums[1:])
    h = (sums[last] - sums[first]) * _powers("down", n)[first]
    return mix(h), first, last, np.searchsorted(first, offsets)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each n-gram of words and the index of its text. A text of fewer words has one gram, of all of them."""
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(hashes))
    left = offsets[1:][text] - at
    total = np.zeros(len(hashes), np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            part = np.zeros(len(hashes), np.uint64)
            if j < len(hashes):
                part[: len(hashes) - j] = hashes[j:]
            part[left <= j] = 0
            total += part * factor
            factor *= _STEP
    keep = (left >= n) | ((lengths[text] < n) & (at == offsets[:-1][text]))
    return mix(total[keep]), text[keep]


def pack48(h: np.ndarray) -> bytes:
    """48-bit values as 6 bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def settle() -> None:
    """Gives freed memory back to the system: a worker stays for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no glibc
        pass
