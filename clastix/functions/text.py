"""String distances that Spark lacks, as functions of two texts and as Arrow-batched user functions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Jaro similarity, without Winkler's bonus."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken = [False] * m
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [b[j] for j in range(m) if taken[j]]
    k = len(first)
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    return (k / n + k / m + (k - swaps) / k) / 3


def edits(a: str, b: str, swaps: str = "") -> int:
    """Edit distance; swaps: "" none, "osa" of neighbours that no other edit touches, "dl" unrestricted."""
    n, m = len(a), len(b)
    d = {(-1, -1): n + m}
    last: dict[str, int] = {}
    for i in range(n + 1):
        d[i, -1], d[i, 0] = n + m, i
    for j in range(m + 1):
        d[-1, j], d[0, j] = n + m, j
    for i in range(1, n + 1):
        match = 0
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (not same))
            if swaps == "osa" and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 2, j - 2] + 1)
            if swaps == "dl":
                p, q = last.get(b[j - 1], 0), match
                if p and q:
                    best = min(best, d[p - 1, q - 1] + (i - p - 1) + 1 + (j - q - 1))
            if same:
                match = j
            d[i, j] = best
        last[a[i - 1]] = i
    return d[n, m]


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _grams(s: str, q: int) -> Counter:
    return Counter(s[i : i + q] for i in range(len(s) - q + 1))


_SOUND = {c: d for d, letters in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in letters}


def soundex(s: str) -> str:
    s = "".join(c for c in s.lower() if "a" <= c <= "z")
    if not s:
        return ""
    out, last = s[0].upper(), _SOUND.get(s[0])
    for c in s[1:]:
        code = _SOUND.get(c)
        if code and code != last:
            out += str(code)
        if c not in "hw":
            last = code
    return (out + "000")[:4]


def distance(a: str, b: str, method: str = "jaccard", q: int = 1) -> float:
    """Distance of two texts by one of METHODS; an undefined one is infinite."""
    if method in ("osa", "lv", "dl"):
        return float(edits(a, b, "" if method == "lv" else method))
    if method == "hamming":
        return float(sum(x != y for x, y in zip(a, b))) if len(a) == len(b) else float("inf")
    if method == "lcs":
        return float(len(a) + len(b) - 2 * common_subsequence(a, b))
    if method == "soundex":
        return float(soundex(a) != soundex(b))
    x, y = _grams(a, q), _grams(b, q)
    if method == "qgram":
        return float(sum(abs(x[k] - y[k]) for k in x.keys() | y.keys()))
    if method == "jaccard":
        return 1 - len(x.keys() & y.keys()) / len(x.keys() | y.keys()) if x or y else 0.0
    if method in ("cosine", "running_cosine"):
        size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return max(0.0, 1 - sum(v * y[k] for k, v in x.items()) / size) if size else 1.0
    raise ValueError(f"unknown method {method!r}")


METHODS = tuple("jaccard qgram cosine running_cosine lcs lv osa dl hamming soundex".split())


def nearest_window(text: str, pattern: str, method: str = "jaccard", q: int = 1) -> float:
    """The least distance of pattern from any stretch of text of its length; from the whole of a shorter text."""
    w = len(pattern)
    return min(distance(text[i : i + w], pattern, method, q) for i in range(max(0, len(text) - w) + 1))


def jaro_of(a: list[str], b: list[str]) -> np.ndarray:
    """jaro() of each pair of two lists, the pairs side by side."""
    out = np.zeros(len(a))
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    order = np.argsort(size.max(1), kind="stable")
    at = 0
    while at < len(order):
        # a slice of pairs of like lengths, its tables of a few million cells
        some = order[at : at + max(1, 2_000_000 // max(1, int(size[order[min(len(order), at + 4096) - 1]].max()))) ][:4096]
        at += len(some)
        out[some] = _jaro([a[k] for k in some.tolist()], [b[k] for k in some.tolist()], size[some])
    return out


def _letters(x: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(x), width), pad, np.int64)
    flat = np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(s) for s in x])
    out[np.arange(width) < size[:, None]] = flat
    return out


def _jaro(a: list[str], b: list[str], size: np.ndarray) -> np.ndarray:
    n, m = size[:, 0], size[:, 1]
    x, y = _letters(a, max(1, int(n.max())), -1), _letters(b, max(1, int(m.max())), -2)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    free = np.arange(y.shape[1]) < m[:, None]
    first = np.zeros(x.shape, bool)
    row, place = np.arange(len(a)), np.arange(y.shape[1])
    for i in range(x.shape[1]):
        fits = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach[:, None])
        j = fits.argmax(1)
        first[:, i] = fits[row, j]
        free[row[first[:, i]], j[first[:, i]]] = False
    second = (place < m[:, None]) & ~free
    k = first.sum(1)
    one, two = x[first], y[second]  # matched letters of all pairs in their order
    other = np.add.reduceat(np.append((one != two), False).astype(np.int64), np.append(0, np.cumsum(k)[:-1])) if len(k) else k
    swaps = np.where(k > 0, other, 0) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        got = (k / n + k / m + (k - swaps) / k) / 3
    return np.where(k > 0, got, np.where((n == 0) & (m == 0), 1.0, 0.0))


def _pairwise(f: Callable[[list[str], list[str]], np.ndarray]):
    @F.pandas_udf("double")
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[ok] = f(a[ok].tolist(), b[ok].tolist())
        return pd.Series(out).where(ok, None)

    return each


def jaro_similarity():
    """A user function of two text columns."""
    return _pairwise(jaro_of)


_CHARS = "regexp_extract_all({}, '(?s).', 0)"


def letter_mask(x: str) -> Column:
    """A 64-bit mask of the letters of a text column: letters whose bits differ differ."""
    return F.expr(f"aggregate(transform({_CHARS.format(x)}, c -> shiftleft(1L, ascii(c) % 64)), 0L, (a, b) -> a | b)")


def window_distance(method: str, q: int) -> Callable[[Column, Column], Column]:
    """A function of the columns text and pattern: an expression where Spark has the distance, else a user function."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method in ("lv", "hamming") or method == "jaccard" and q == 1:
        return lambda a, b: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(0), F.length(a) - F.length(b)) + 1), lambda i: _built_in(method, F.substr(a, i, F.length(b)), b)))
    return _pairwise(lambda a, b: np.array([nearest_window(x, y, method, q) for x, y in zip(a, b)]))


def _built_in(method: str, a: Column, b: Column) -> Column:
    if method == "lv":
        return F.levenshtein(a, b).cast("double")
    x, y = (F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)) for c in (a, b))
    if method == "hamming":
        unlike = F.aggregate(F.zip_with(x, y, lambda u, v: (u != v).cast("double")), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(x) == F.size(y), unlike).otherwise(float("inf"))
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, 0.0).otherwise(1 - F.size(F.array_intersect(x, y)) / every)
