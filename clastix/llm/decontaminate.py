"""Verbatim benchmark passages in training texts, by suffix arrays over the words of the training texts.

Each shard of the training texts (at most SHARD_WORDS words in one task) gets a suffix array, by prefix
doubling to the depth of the longest test item, beyond which no comparison with a test suffix reaches.
Every suffix of every test item is binary-searched in every shard. A shard holds the words of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .scratch import bounded, fresh, sized, written

#: A match of so many words condemns a text; test items of fewer words are matched whole, from LEAST words on.
MIN_WORDS = 13
LEAST = 5
#: Words in a shard, about (a longer text is one shard): 22 bits hold a position.
SHARD_WORDS = 1_000_000
#: Bytes of test items that tasks get at once; a larger benchmark is searched in several passes, one after the other.
TEST_BYTES = 64 << 20

#: Test suffixes that are searched at a time, and places of them that are compared at a time.
SUFFIXES_AT_ONCE = 50_000
PLACES_AT_ONCE = 1_000_000

_FOUND = "doc_id long, item_id long, n_words long, doc_word long, item_word long"


def suffix_array(code: np.ndarray, depth: int) -> np.ndarray:
    """Positions of code (int, >= 0) in the order of their suffixes' first depth values; equal ones by position. Shorter suffixes come first."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    pad = np.zeros(n + 2, np.uint64)
    pad[:n] = np.minimum(code, (1 << 21) - 2).astype(np.uint64) + np.uint64(1)
    key = (pad[:n] << np.uint64(42)) | (pad[1 : n + 1] << np.uint64(21)) | pad[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.append(True, s[1:] != s[:-1])
    h = 3
    if int(code.max()) >= (1 << 21) - 2:  # more values than 21 bits hold: start from single values
        order = np.argsort(code, kind="stable")
        s = code[order]
        first, h = np.append(True, s[1:] != s[:-1]), 1
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    start = np.flatnonzero(first)
    group = np.repeat(start, np.diff(np.append(start, n)))
    rank[order] = group + 1
    tied = np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n)))
    at = np.flatnonzero(tied)
    while h < depth and len(at):
        pos = order[at]
        after = rank[np.minimum(pos + h, n)]
        k = (group[at].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        by = np.argsort(k, kind="stable")
        k, pos = k[by], pos[by]
        order[at] = pos
        new = np.append(True, k[1:] != k[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(k)))
        head = at[np.repeat(begin, size)]
        group[at] = head
        rank[pos] = head + 1
        at = at[np.repeat(size > 1, size)]
        h *= 2
    return order


class Tests:
    """Words of the test items, one after the other."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int, least: int):
        raw, off = T.buffers(T.lower(pa.array(texts, pa.string())))
        self.hash, _, _, self.off = T.words(raw, off)
        self.ids = np.array(ids, np.int64)
        size = np.diff(self.off)
        self.item = np.repeat(np.arange(len(ids)), size)
        self.left = self.off[1:][self.item] - np.arange(len(self.hash))
        need = np.minimum(min_words, size)
        self.need = np.where(need >= least, need, 1 << 30)[self.item]
        self.start = np.flatnonzero(self.left >= self.need)
        self.depth = int(size.max()) if len(size) else 0


def search(t: Tests, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one shard: for each text and item that share a match long enough the longest, as (text, item, words, position, position in the item)."""
    none = (np.zeros(0, np.int64),) * 5
    if not len(hashes) or not len(t.start):
        return none
    vocabulary, code = np.unique(hashes, return_inverse=True)
    test = np.minimum(np.searchsorted(vocabulary, t.hash), len(vocabulary) - 1)
    known = vocabulary[test] == t.hash
    bad = np.append(0, np.cumsum(~known))
    start = t.start[(bad[t.start + t.need[t.start]] - bad[t.start]) == 0]
    if not len(start):
        return none
    sa = suffix_array(code, t.depth + 1)
    # a longest match has another word (or nothing) before it in the text than in the item; -1 is no word, -2 none either
    before = np.full(len(code), -2, np.int64)
    before[1:] = np.where(text[1:] == text[:-1], code[:-1], -2)
    before = before[sa]
    inside = start > t.off[t.item[start]]
    word = np.where(inside & known[start - 1], test[start - 1], -1)
    best = none
    for i in range(0, len(start), SUFFIXES_AT_ONCE):
        part = slice(i, i + SUFFIXES_AT_ONCE)
        s = start[part]
        lo, hi = (_bound(sa, code, test, s, t.need[s], right) for right in (False, True))
        some = np.flatnonzero(hi > lo)
        # places where all the rest of the item follows need no more comparing
        low, high = (_bound(sa, code, test, s[some], t.left[s[some]], right) for right in (False, True))
        # suffixes alike in their first words, and in the word before them, have the same places
        same, of = np.unique(np.column_stack([lo[some], hi[some], word[part][some]]), axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")
        alike = np.append(np.searchsorted(of[order], np.arange(len(same))), len(of))
        for u, k in _places(same, before):
            many = (alike[u + 1] - alike[u]).astype(np.int64)
            for x, z in _pieces(many):
                m = many[x:z]
                row = np.repeat(np.arange(x, z), m)
                mine = order[alike[u[row]] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)]
                whole = (low[mine] <= k[row]) & (k[row] < high[mine])
                best = _longest(best, _extended(t, hashes, text, s[some[mine]], sa[k[row]], whole))
    return best


def _bound(sa: np.ndarray, code: np.ndarray, test: np.ndarray, start: np.ndarray, need: np.ndarray, right: bool) -> np.ndarray:
    """The first place in the array whose suffix is not before (right: is after) the first need words of each test suffix."""
    n, wide = len(code), np.arange(16)
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), n)
    go = np.arange(len(start))
    while len(go):
        mid = (lo[go] + hi[go]) // 2
        before = np.full(len(go), right)
        row, done = np.arange(len(go)), 0
        while len(row):  # 16 words at a time, of those that are equal so far
            p = sa[mid[row]][:, None] + done + wide
            have = np.where(p < n, code[np.minimum(p, n - 1)], -1)
            want = test[np.minimum(start[go[row]][:, None] + done + wide, len(test) - 1)]
            diff = (have != want) & (done + wide < need[go[row]][:, None])
            at, each = diff.argmax(1), np.arange(len(row))
            other = diff[each, at]
            before[row[other]] = have[each, at][other] < want[each, at][other]
            done += 16
            row = row[~other & (need[go[row]] > done)]
        lo[go], hi[go] = np.where(before, mid + 1, lo[go]), np.where(before, hi[go], mid)
        go = go[lo[go] < hi[go]]
    return lo


def _pieces(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes sum to PLACES_AT_ONCE, about; a larger one makes a range by itself."""
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PLACES_AT_ONCE, "right")))
        yield i, j
        i = j


def _places(same: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of same, place in the array) for same (first place, last + 1, word before), without places that the same word is before."""
    size = same[:, 1] - same[:, 0] if len(same) else np.zeros(0, np.int64)
    for i, j in _pieces(size):
        c = size[i:j]
        u = np.repeat(np.arange(i, j), c)
        k = same[u, 0] + np.arange(len(u)) - np.repeat(np.cumsum(c) - c, c)
        other = before[k] != same[u, 2]
        yield u[other], k[other]


def _extended(t: Tests, hashes: np.ndarray, text: np.ndarray, s: np.ndarray, p: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """The matches of test suffixes s with places p, as far as they go within a text and an item: (text, item, words, position, position in the item). whole: all the item's rest follows."""
    end = np.searchsorted(text, text[p], "right")  # where the text of this place ends
    ok = p + t.need[s] <= end
    s, p, end, whole = s[ok], p[ok], end[ok], whole[ok]
    most = np.minimum(t.left[s], end - p)
    length = np.where(whole, most, t.need[s])
    more = np.flatnonzero(~whole)
    while len(more):
        more = more[length[more] < most[more]]
        more = more[hashes[p[more] + length[more]] == t.hash[s[more] + length[more]]]
        length[more] += 1
    return text[p], t.item[s], length, p, s - t.off[t.item[s]]


def _longest(*found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of several results one: for each text and item the longest match, of equal ones the first in the text, then in the item."""
    x, item, length, p, s = (np.concatenate(v) for v in zip(*found))
    _, of = np.unique(x * (int(item.max(initial=0)) + 1) + item, return_inverse=True)
    for k in range(3):
        value = (-length, p, s)[k]
        least = np.full(int(of.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, of, value)
        keep = value == least[of]
        x, item, length, p, s, of = (v[keep] for v in (x, item, length, p, s, of))
    return x, item, length, p, s


def _shards(ids: list[int], texts: list[str], min_words: int, least: int):
    schema = pa.schema([(x.split()[0], pa.int64()) for x in _FOUND.split(", ")])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(ids, texts, min_words, least)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate([h for h, _, _ in held])
            length = np.concatenate([k for _, k, _ in held])
            doc = np.concatenate([i for _, _, i in held])
            text = np.repeat(np.arange(len(length)), length)
            begin = np.append(0, np.cumsum(length))
            x, item, words, p, s = search(tests, hashes, text)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (doc[x], tests.ids[item], words, p - begin[x], s)], schema=schema)

        for b in batches:
            doc, column = b.column(0).to_numpy(zero_copy_only=False), T.lower(b.column(1))
            raw, off = T.buffers(column)
            for i, j in T.chunks(off):
                h, _, _, word = T.words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                if size and size + len(h) > SHARD_WORDS:
                    yield from flush()
                    held, size, count = [], 0, 0
                    T.settle()
                held.append((h, np.diff(word), doc[i:j]))
                size, count = size + len(h), count + j - i
        if size:
            yield from flush()
        held.clear()
        T.settle()

    return go


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: int = LEAST, test_id: str = "item_id", test_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): for each document and test item that share min_words words or more, the longest match.

    doc_word and item_word count the words before it, from 0; of equally long matches the one earliest in
    the document, then in the item. An item of fewer words (but least or more) must occur whole; a shorter
    one is not searched. Words are compared in lower case, without what stands between them.
    Rows with a null id or text are left out on both sides. Repeated rows of docs that fall in one shard
    and id are reported for each; the result is made distinct. Empty tables give no rows.
    Other columns are not read. Training texts are never cut; the tests go to the tasks in parts of
    TEST_BYTES, each of which is one pass over docs.
    """
    docs = bounded(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    tests = benchmark.select(F.col(test_id).cast("long").alias("id"), F.col(test_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // TEST_BYTES))
    parts = []
    for k in range(passes):
        part = (tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k) if passes > 1 else tests).orderBy("id", "text").collect()
        one = texts.mapInArrow(_shards([r[0] for r in part], [r[1] for r in part], min_words, least), _FOUND)
        parts.append(written(one, "matches") if passes > 1 else one)
    out = reduce(DataFrame.unionByName, parts)
    best = F.max_by(F.struct("n_words", "doc_word", "item_word"), F.struct("n_words", -F.col("doc_word"), -F.col("item_word"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """docs without those that share a passage with a test item (see matches()). A document without an id or a text stays; columns are kept."""
    (name,) = fresh(docs, "id")
    found = written(matches(docs, benchmark, id_col, text_col, min_words, least).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(sized(found), F.col(id_col).cast("long") == F.col(name), "left_anti")
