"""Exact self-join of texts by the Jaccard similarity of their word n-gram sets.

The join is by prefixes. All n-grams are counted over the whole table; each text's n-grams are put in
one global order, rare first; two texts of similarity t or more share an n-gram among the first
|x| - ceil(t |x|) + 1 of each. Only those are joined. Length, positional and suffix filters then drop
pairs that cannot reach t, and each pair left is verified once, on the whole sets.

N-grams travel as blocks of 64-bit hashes, not as rows: a row for each n-gram would take several times
the input in shuffle files. An n-gram that a single text has (two thirds of them, in prose) goes no
further than the count. Identical texts are found first and enter the join as one. No task holds more than
blocks of a bounded size: the texts of a frequent n-gram are cut into parts, each two of which are a unit of
work, and so are the texts that share their least n-gram.

A group of n near copies has n^2 / 2 similar pairs, which no filter drops. Where no more than the groups and links of
texts are asked for (linked()), texts that share most of their frequent n-grams with one text are its family: the
join by prefixes leaves out pairs within a family, and all of them are counted by products of matrices, tile by tile.
Any division into families gives the same result; it only decides which of the two ways counts a pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .groups import runs
from .scratch import bounded, collected, drop, fresh, row_key, sized, written

N = 5
THRESHOLD = 0.4
#: N-grams in a bucket of the count, and in the block of one map task, about; more if the table is so large that blocks would fall to crumbs.
BLOCK_GRAMS = 1_000_000
#: Shuffles of blocks have so many partitions at most; each then takes its buckets one after the other.
PARTITIONS = 50_000
#: Texts that share a prefix n-gram are cut into parts of so many, about, if they may be more.
HOT_TEXTS = 2_000
#: Texts, and bytes of their sets, of one unit of pairs.
CELL_TEXTS, CELL_BYTES = 2_500, 4 << 20
#: Bytes of sets that a verifying task reads, about.
VERIFY_BYTES = 4 << 20
#: Texts that a family has at least, and an n-gram that counts for families; texts of families altogether, at most (the largest ones; their numbers are broadcast, 12 bytes each).
FAMILY, FAMILY_TEXTS = 64, 1_000_000
#: Numbers in a text's sketch of its frequent n-grams, and how many of them a text and the first of its family have in common.
SKETCH, ALIKE = 16, 4
#: Texts, and bytes of their sets, of each side of a tile.
TILE_TEXTS, TILE_BYTES = 2_500, 8 << 20
#: A tile's n-grams that so many of its texts have are columns of matrices, so many at a time; rarer ones are counted pair by pair.
DENSE, COLUMNS = 32, 1024
#: Pairs that a task makes at a time.
PAIRS_AT_ONCE = 500_000

_BLOCK = "bucket long, src long, texts binary, counts binary, grams binary, ranks binary"
#: Parts of the hash range in each of which the suffix filter counts n-grams; a count is sent as the place of a value not below it.
_TAILS = 8
_LEVELS = [0]
while len(_LEVELS) < 255:
    _LEVELS.append(max(_LEVELS[-1] + 1, int(_LEVELS[-1] * 1.06)))
_LEVELS = np.array([*_LEVELS, 1 << 31])
_SIDE = 30


@dataclass(frozen=True)
class Similar:
    """What join() found, in linear size.

    copies: (id, member): texts that are equal character by character, a row for each; id is the least of them.
    pairs: (a, b, shared, n_a, n_b, jaccard), a < b: similar texts, for each set of equal ones its least id.
    """

    copies: DataFrame
    pairs: DataFrame


@dataclass(frozen=True)
class Linked:
    """What linked() found, in linear size but for pairs of texts that are in no common family.

    copies, pairs: as in Similar, without the pairs within a family.
    within: (kind, a, b): kind 0: a text a of a family and how many documents b are similar to it by its family's texts, in a tile; kind 1: pairs a < b
    that connect whatever the family's similar pairs connect.
    """

    copies: DataFrame
    pairs: DataFrame
    within: DataFrame


def _bytes(x: np.ndarray, dtype: str) -> bytes:
    return x.astype(dtype).tobytes()


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ints, floats and bytes as batches of about that many bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if size >= most:
            yield _batch(dict(zip(schema.names, zip(*held))), schema)
            held, size = [], 0
    if held:
        yield _batch(dict(zip(schema.names, zip(*held))), schema)


def _layout(grams: int) -> tuple[int, int, int]:
    """(n-grams in a block, buckets, partitions): a block meets at least a few n-grams of each bucket, so blocks grow as the root of a large table."""
    block = max(BLOCK_GRAMS, math.isqrt(16 * grams))
    buckets = max(1, math.ceil(grams / block))
    return block, buckets, math.ceil(buckets / math.ceil(buckets / PARTITIONS))


def _grams(n: int, block: int, buckets: int):
    """Texts to blocks: n-gram hashes by bucket; with a negative bucket the block's ids and set sizes."""
    schema = _arrow(_BLOCK)

    def flush(part: int, turn: int, held: list[tuple[np.ndarray, np.ndarray]], ids: list[np.ndarray]) -> Iterator[tuple]:
        src, ids_ = (part << 24) | turn, np.concatenate(ids)
        text, gram = (np.concatenate(x) for x in zip(*held))
        yield -1 - src % buckets, src, _bytes(ids_, "<i8"), _bytes(np.bincount(text, minlength=len(ids_)), "<u4"), b"", b""
        bucket = gram % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
        bucket, text, gram = bucket[order], text[order], gram[order]
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                yield int(bucket[i]), src, *_coded(text[i:j]), _bytes(gram[i:j], "<u8"), b""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[np.ndarray] = []
        size = count = turn = 0
        for b in batches:
            id_, column = b.column(0).to_numpy(zero_copy_only=False), T.lower(b.column(1))
            raw, off = T.buffers(column)
            for i, j in T.chunks(off):
                h, _, _, word = T.words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                gram, text = T.ngrams(h, word, n)
                if count + j - i > 65535 or size > block:
                    if size:
                        yield from flush(part, turn, held, ids)
                    held, ids, size, count, turn = [], [], 0, 0, turn + 1
                    T.settle()
                text = text.astype(np.uint16)
                order = np.argsort(gram)
                order = order[np.argsort(text[order], kind="stable")]
                gram, text = gram[order], text[order]
                new = np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1]))[: len(gram)]
                held.append((text[new] + np.uint16(count), gram[new]))
                ids.append(id_[i:j])
                size, count = size + len(held[-1][1]), count + j - i
        if size:
            yield from flush(part, turn, held, ids)
        held.clear()
        T.settle()

    return lambda batches: _emit(rows(batches), schema)


def _coded(text: np.ndarray) -> tuple[bytes, bytes]:
    """Run lengths of sorted text numbers."""
    at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    return _bytes(text[at], "<u2"), _bytes(np.diff(np.append(at, len(text))), "<u4")


def _decoded(table: pa.Table, kind: str = "<u2") -> np.ndarray:
    return np.concatenate([np.repeat(np.frombuffer(a.as_py(), kind), np.frombuffer(c.as_py(), "<u4")) for a, c in zip(table["texts"], table["counts"])])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by bucket to blocks by source, of the n-grams that two texts or more have, with the rarity rank of each."""

    def rows() -> Iterator[tuple]:
        for bucket, t in runs(batches, "bucket"):
            if bucket < 0:
                for r in t.to_pylist():
                    yield tuple(r.values())
                continue
            grams = [np.frombuffer(x.as_py(), "<u8") for x in t["grams"]]
            gram = np.concatenate(grams)
            order = np.argsort(gram)
            s = gram[order]
            first = np.append(True, s[1:] != s[:-1])
            run = np.cumsum(first) - 1
            df = np.bincount(run)
            rank = np.zeros(len(s), np.uint8)
            rank[order] = np.where(df > 1, np.minimum(255, 4 * np.log2(df)), 0).astype(np.uint8)[run]
            text, at = _decoded(t), 0
            for src, g in zip(t["src"].to_pylist(), grams):
                r = rank[at : at + len(g)]
                keep = r > 0
                if keep.any():
                    yield bucket, src, *_coded(text[at : at + len(g)][keep]), _bytes(g[keep], "<u8"), r[keep].tobytes()
                at += len(g)

    return _emit(rows(), _arrow(_BLOCK))


_PREFIX = "kind int, key long, n long, cell long, texts binary, ns binary, shared binary, cells binary, counts binary, grams binary, places binary, before binary, tails binary"


def _parts_of(rank: np.ndarray, most: int) -> np.ndarray:
    """Into how many parts the texts of an n-gram of this rarity rank are cut: the rank bounds how many texts have it."""
    return np.maximum(1, np.ceil(2.0 ** ((np.arange(256) + 1) / 4) / most).astype(np.int64))[rank]


def _units(gram: np.ndarray, rank: np.ndarray, id_: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posting, unit, side) of each posting in each unit of work that it belongs to.

    The texts of an n-gram that few have are one unit, side 0, and all pairs in it are made. Else a text is in one
    of so many parts, and in a unit for each two of them: with its own part as side 0, with another as side 1 or 2, of
    which only the pairs across are made.
    """
    many = _parts_of(rank, most)
    of = np.repeat(np.arange(len(gram)), many)
    other = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    own = (T.mix(id_.astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64)[of]
    low, high, m = np.minimum(own, other), np.maximum(own, other), many[of]
    unit = np.where(m == 1, gram[of], T.mix(gram[of] + (low * m + high + 1).astype(np.uint64) * T._STEP))
    return of, unit, np.where(own == other, 0, np.where(own < other, 1, 2))


def _sketches(t: float, family: int, text: np.ndarray, gram: np.ndarray, rank: np.ndarray, sizes: np.ndarray) -> dict[int, bytes]:
    """Of each text of whose n-grams a share of t or more are frequent: the least value of those by each of SKETCH hash functions."""
    hot = rank >= math.floor(4 * math.log2(family))
    often = np.bincount(text[hot], minlength=len(sizes))
    hot &= ((often > 0) & (often >= t * sizes))[text]
    text, gram = text[hot], gram[hot]
    if not len(text):
        return {}
    at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    least = [np.minimum.reduceat(T.mix(gram + np.uint64(k + 1) * T._STEP), at) >> np.uint64(32) for k in range(SKETCH)]
    return dict(zip(text[at].tolist(), (x.tobytes() for x in np.stack(least, 1).astype("<u4"))))


def _prefixes(t: float, buckets: int, most: int, family: int = 0):
    """Blocks by source to kind 0: the shared n-grams of a text, and kind 1: blocks of prefix n-grams by bucket.

    If families have a least size, kind 0 has a text's sketch too, if it may be in one.

    A prefix n-gram has its place in its text's order, the hash of the shared one before it, and how many shared ones
    follow it in each part of the hash range.
    """
    schema = _arrow(_PREFIX)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, b in runs(batches, "src"):
            bucket = b["bucket"].to_numpy()
            head = b.filter(pa.array(bucket < 0))
            body = b.filter(pa.array(bucket >= 0))
            if not body.num_rows:
                continue
            ids, sizes = np.frombuffer(head["texts"][0].as_py(), "<i8"), np.frombuffer(head["counts"][0].as_py(), "<u4").astype(np.int64)
            text = _decoded(body)
            gram = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in body["grams"]])
            rank = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in body["ranks"]])
            order = np.lexsort((gram, rank, text))
            text, gram, rank = text[order], gram[order], rank[order]
            begin = np.searchsorted(text, np.arange(len(ids) + 1))
            shared = np.diff(begin)
            place = np.arange(len(text)) - begin[text] + (sizes - shared)[text]
            length = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
            prefix = np.flatnonzero(place < length[text])
            active = np.bincount(text[prefix], minlength=len(ids)) > 0
            cells = np.zeros(len(ids), np.uint32)
            none = (b"",) * 9
            sketch = _sketches(t, family, text, gram, rank, sizes) if family else {}
            for k in np.flatnonzero(active).tolist():
                g = np.sort(gram[begin[k] : begin[k + 1]])
                cells[k] = int(g[0]) % 2147483647
                yield 0, int(ids[k]), int(sizes[k]), int(cells[k]), sketch.get(k, b""), *none[:4], _bytes(g, "<u8"), *none[:3]
            tails = np.empty((len(prefix), _TAILS), np.uint8)
            for q in range(_TAILS):
                so_far = np.append(0, np.cumsum((gram >> np.uint64(61)) == q, dtype=np.int32))
                tails[:, q] = np.searchsorted(_LEVELS, so_far[begin[text[prefix] + 1]] - so_far[prefix + 1])
            before = np.where(prefix > begin[text[prefix]], gram[prefix - 1] & T.LOW48, 0).astype(np.uint64)
            of, unit, side = _units(gram[prefix], rank[prefix], ids[text[prefix]], most)
            to = unit % np.uint64(buckets)
            order = np.lexsort((text[prefix[of]], to))
            of, unit, side, to = of[order], unit[order], side[order], to[order]
            text, place = text[prefix[of]], place[prefix[of]] | (side << _SIDE)
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    x, c = _coded(text[i:j])
                    k = np.frombuffer(x, "<u2")
                    yield 1, int(to[i]), 0, 0, _bytes(ids[k], "<i8"), _bytes(sizes[k], "<u4"), _bytes(shared[k], "<u4"), _bytes(cells[k], "<u4"), c, _bytes(unit[i:j], "<u8"), _bytes(place[i:j], "<u4"), T.pack48(before[of[i:j]]), tails[of[i:j]].tobytes()

    return lambda batches: _emit(rows(batches), schema)


_FOUND_PAIRS = "to int, target long, ids binary, shared binary, a binary, b binary"


def _cells(cells: np.ndarray, a: np.ndarray, b: np.ndarray, hot: dict[int, int], targets: int) -> np.ndarray:
    """The unit of each pair of ids (a, b), a the shorter text, of this cell: that of the cell; a hot cell has one for each two of so many parts of its texts."""
    part = np.zeros(len(cells), np.uint64)
    if hot:
        known = np.array(sorted(hot))
        at = np.minimum(np.searchsorted(known, cells), len(known) - 1)
        many = np.where(known[at] == cells, np.array([hot[c] for c in known.tolist()])[at], 1).astype(np.uint64)
        pa_, pb = (T.mix(x.astype(np.uint64)) % many for x in (a, b))
        part = pa_ * many + pb
    return (T.mix(T.mix(cells.astype(np.uint64) + np.uint64(1)) + part) % np.uint64(targets)).astype(np.int64)


def _made(t: float, unit: np.ndarray, side: np.ndarray, n: np.ndarray, place: np.ndarray, before: np.ndarray, tails: np.ndarray, most_pairs: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings, sorted by unit, side and size, that pass the filters.

    Length: only sizes within the threshold are paired. Positional: the n-grams from this one on must suffice. Suffix:
    so must this one and, in each part of the hash range, as many as both texts have after it. A pair whose n-gram before this
    is the same was made at that one. The first n-gram in common passes if the pair is similar.
    """
    new = np.append(True, (unit[1:] != unit[:-1]) | ((side[1:] > 0) != (side[:-1] > 0)))[: len(unit)]
    group = (np.cumsum(new) - 1) * 2
    key = (group + (side == 2)) << 32 | n
    at, partner = np.arange(len(unit)), (group + (side == 1)) << 32
    hi = np.searchsorted(key, partner | np.floor(n / t + 1e-9).astype(np.int64), "right")
    lo = np.where(side == 0, at + 1, np.searchsorted(key, partner | np.ceil(n * t - 1e-9).astype(np.int64), "left"))
    after = np.where(side == 2, 0, np.maximum(hi - lo, 0))
    yield from _ranges(t, lo, after, n, place, before, tails, most_pairs)


def _across(t: float, unit: np.ndarray, side: np.ndarray, family: np.ndarray, n: np.ndarray, place: np.ndarray, before: np.ndarray, tails: np.ndarray, most_pairs: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings, sorted by unit, side and family (0: none), of which one or both are in a family, but not both in the same; filtered as in _made, where the positional filter holds the lengths too."""
    new = np.append(True, (unit[1:] != unit[:-1]) | ((side[1:] > 0) != (side[:-1] > 0)))[: len(unit)]
    segment, width = (np.cumsum(new) - 1) * 2 + (side == 2), int(family.max(initial=0)) + 1
    key = segment * width + family
    other = (segment + (side == 1)) * width
    end = np.searchsorted(key, other + width)
    lo = np.searchsorted(key, other + family, "right")
    yield from _ranges(t, lo, np.where(side == 2, 0, end - lo), n, place, before, tails, most_pairs)
    lo = np.searchsorted(key, other)
    yield from _ranges(t, lo, np.where((side == 1) & (family > 0), np.searchsorted(key, other + family) - lo, 0), n, place, before, tails, most_pairs)


def _ranges(t: float, lo: np.ndarray, count: np.ndarray, n: np.ndarray, place: np.ndarray, before: np.ndarray, tails: np.ndarray, most_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each posting with the count of postings from lo on, if the pair passes the positional and suffix filters."""
    left = n - place
    total, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most_pairs, "right")))
        c = count[i:j]
        x = np.repeat(np.arange(i, j), c)
        y = lo[x] + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
        need = np.ceil(t / (1 + t) * (n[x] + n[y]) - 1e-9)
        keep = (np.minimum(left[x], left[y]) >= need) & ((before[x] != before[y]) | (before[x] == 0))
        x, y, need = x[keep], y[keep], need[keep]
        most = np.ones(len(x))
        for q in range(_TAILS):
            most += _LEVELS[np.minimum(tails[x, q], tails[y, q])]
        yield x[most >= need], y[most >= need]
        i = j


def _candidates(t: float, targets: int, parts: int, hot: dict[int, int], most_pairs: int, families=None):
    """Prefix blocks by bucket to blocks of pairs by unit, the shorter text (of equal ones that of the lower id) first; none within a family of the broadcast ids, in order, and their families from 1 on."""
    schema = _arrow(_FOUND_PAIRS)

    def family_of(ids: np.ndarray) -> np.ndarray:
        if families is None or not len(ids):
            return np.zeros(len(ids), np.int64)
        known, number = families.value
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where(known[at] == ids, number[at], 0).astype(np.int64)

    def made(unit, side, family, n, place, before, tails) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not family.any():
            yield from _made(t, unit, side, n, place, before, tails, most_pairs)
            return
        alone = np.flatnonzero(family == 0)
        for x, y in _made(t, *(v[alone] for v in (unit, side, n, place, before, tails)), most_pairs):
            yield alone[x], alone[y]
        some = np.flatnonzero(np.isin(unit, np.unique(unit[family > 0])))
        some = some[np.lexsort((family[some], side[some], unit[some]))]
        for x, y in _across(t, *(v[some] for v in (unit, side, family, n, place, before, tails)), most_pairs):
            yield some[x], some[y]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, b in runs(batches, "key"):
            raw = {k: [x.as_py() for x in b[k]] for k in ("texts", "ns", "shared", "cells", "counts", "grams", "places", "before", "tails")}
            join = lambda k, kind, raw=raw: np.concatenate([np.frombuffer(x, kind) for x in raw[k]])
            ids, at, of = np.unique(join("texts", "<i8"), return_index=True, return_inverse=True)
            n, shared, cells = join("ns", "<u4").astype(np.int64)[at], join("shared", "<u4")[at], join("cells", "<u4")[at]
            text = np.repeat(of, join("counts", "<u4"))
            unit, place = join("grams", "<u8"), join("places", "<u4").astype(np.int64)
            before, tails = np.concatenate([T.unpack48(x) for x in raw["before"]]), join("tails", np.uint8).reshape(-1, _TAILS)
            raw.clear()
            side, place = place >> _SIDE, place & ((1 << _SIDE) - 1)
            order = np.lexsort((text, n[text], side, unit))
            text = text[order]
            found, held = np.zeros(0, np.int64), []
            for x, y in made(unit[order], side[order], family_of(ids)[text], n[text], place[order], before[order], tails[order]):
                x, y = text[x], text[y]
                swap = (n[x] > n[y]) | ((n[x] == n[y]) & (x > y))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                held.append((x * len(ids) + y)[x != y])
                if sum(map(len, held)) > 4 * most_pairs:
                    found, held = np.unique(np.concatenate([found, *held])), []
            found = np.unique(np.concatenate([found, *held]))
            x, y = found // max(1, len(ids)), found % max(1, len(ids))
            target = _cells(cells[x], ids[x], ids[y], hot, targets)
            order = np.argsort(target, kind="stable")
            x, y, target = x[order], y[order], target[order]
            cuts = [0, *(np.flatnonzero(target[1:] != target[:-1]) + 1).tolist(), len(target)]
            for i, j in zip(cuts, cuts[1:]):
                for k in range(i, j, 1_000_000):
                    both = np.concatenate([x[k : min(j, k + 1_000_000)], y[k : min(j, k + 1_000_000)]])
                    own, where = np.unique(both, return_inverse=True)
                    yield int(target[i]) % parts, int(target[i]), _bytes(ids[own], "<i8"), _bytes(shared[own], "<u4"), _bytes(where[: len(both) // 2], "<u4"), _bytes(where[len(both) // 2 :], "<u4")

    return lambda batches: _emit(rows(batches), schema)


def _distinct(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of pairs as one, each pair once, in order."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    a, b = (np.concatenate(x) for x in zip(none, *blocks))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new]


_PAIR = "kind int, sub long, id long, w long, a binary, b binary"


def _halves(w: np.ndarray, most: int) -> np.ndarray:
    """Numbers of groups, in order, of entries of so many bytes: about half of most in each."""
    return (np.cumsum(w) - w) // max(1, most // 2)


def _once(most: int, most_pairs: int):
    """Blocks of pairs by unit to kind 1: each pair once, by sub-units whose sets have a bounded size, and kind 0: the texts that a sub-unit needs."""
    schema = _arrow(_PAIR)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for target, p in runs(batches, "target"):
            held, size, ids, shared = [_distinct([])], 0, [], []
            for own, w, x, y in zip(p["ids"], p["shared"], p["a"], p["b"]):
                own = np.frombuffer(own.as_py(), "<i8")
                held.append(tuple(own[np.frombuffer(v.as_py(), "<u4")] for v in (x, y)))
                ids.append(own)
                shared.append(np.frombuffer(w.as_py(), "<u4"))
                size += len(held[-1][0])
                if size > most_pairs:
                    held, size = [_distinct(held)], 0
            a, b = _distinct(held)
            ids, at = np.unique(np.concatenate(ids), return_index=True)
            w = 8 * np.concatenate(shared)[at].astype(np.int64) + 64
            x, y, seq = np.searchsorted(ids, a), np.searchsorted(ids, b), 0
            own = np.unique(x)
            group = np.zeros(len(ids), np.int64)
            group[own] = _halves(w[own], most)
            edge = [0, *(np.flatnonzero(np.diff(group[x])) + 1).tolist(), len(x)]
            for i, j in zip(edge, edge[1:]):
                mine, theirs = x[i:j], y[i:j]
                other = np.unique(theirs)
                half = np.zeros(len(ids), np.int64)
                half[other] = _halves(w[other], most)
                order = np.argsort(half[theirs], kind="stable")
                mine, theirs = mine[order], theirs[order]
                cut = [0, *(np.flatnonzero(np.diff(half[theirs])) + 1).tolist(), len(theirs)]
                for k, m in zip(cut, cut[1:]):
                    if k == m:
                        continue
                    sub, seq = (target << 24) | seq, seq + 1
                    for z in np.unique(np.concatenate([mine[k:m], theirs[k:m]])).tolist():
                        yield 0, sub, int(ids[z]), int(w[z]), b"", b""
                    for z in range(k, m, 1_000_000):
                        yield 1, sub, 0, 0, _bytes(ids[mine[z : min(m, z + 1_000_000)]], "<i8"), _bytes(ids[theirs[z : min(m, z + 1_000_000)]], "<i8")

    return lambda batches: _emit(rows(batches), schema)


_FOUND = "a long, b long, shared long, n_a long, n_b long, jaccard double"


def _verify(t: float):
    """Sets (kind 0) and pairs (kind 1) of one sub-unit to the pairs of similarity t or more."""
    schema = _arrow(_FOUND)

    def check(pairs: tuple[np.ndarray, np.ndarray], ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = np.searchsorted(ids, pairs[0]), np.searchsorted(ids, pairs[1])
        need = np.ceil(t / (1 + t) * (n[a] + n[b]) - 1e-9)
        shared = np.zeros(len(a), np.int64)
        cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                own = sets[a[i]]
                for k in range(i, j, 500):
                    many = [sets[x] for x in b[k : min(j, k + 500)].tolist()]
                    flat = np.concatenate(many)
                    at = np.searchsorted(own, flat)
                    at[at == len(own)] = 0
                    starts = np.cumsum([0, *map(len, many[:-1])])
                    shared[k : k + len(many)] = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
        ok = shared >= need
        x, y, shared = a[ok], b[ok], shared[ok]
        if len(x):
            swap = ids[x] > ids[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[x], ids[y], shared, n[x], n[y], shared / (n[x] + n[y] - shared))], schema=schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in runs(batches, "sub"):
            kind = r["kind"].to_numpy()
            s, p = r.filter(pa.array(kind == 0)), r.filter(pa.array(kind == 1))
            ids, at = np.unique(s["id"].to_numpy(), return_index=True)
            n = s["n"].to_numpy()[at]
            sets = [np.frombuffer(s["a"][i].as_py(), "<u8") for i in at.tolist()]
            for x in p.to_pylist():
                yield from check((np.frombuffer(x["a"], "<i8"), np.frombuffer(x["b"], "<i8")), ids, n, sets)

    return go


_WITHIN = "kind int, a long, b long"


def _shared(flat: np.ndarray, text: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many n-grams each text of first has in common with each of second: flat has the n-grams, text the number of the text of each."""
    row, column = (np.full(int(max(first.max(), second.max())) + 1, -1) for _ in range(2))
    row[first], column[second] = np.arange(len(first)), np.arange(len(second))
    _, gram, df = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(first), len(second)), np.float32)
    dense = np.flatnonzero(df >= DENSE)
    for k in range(0, len(dense), COLUMNS):
        at = np.full(len(df), -1)
        at[dense[k : k + COLUMNS]] = np.arange(len(dense[k : k + COLUMNS]))
        mine = at[gram] >= 0
        sides = []
        for place, size in ((row, len(first)), (column, len(second))):
            use = mine & (place[text] >= 0)
            x = np.zeros((size, len(dense[k : k + COLUMNS])), np.float32)
            x[place[text[use]], at[gram[use]]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    rare = np.flatnonzero((df[gram] > 1) & (df[gram] < DENSE))
    rare = rare[np.argsort(gram[rare], kind="stable")]
    text, gram = text[rare], gram[rare]
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))[: len(gram)]
    lo, count = (np.repeat(v, np.diff(np.append(begin, len(gram)))) for v in (begin, np.diff(np.append(begin, len(gram)))))
    for k in range(0, len(text), 100_000):
        c = count[k : k + 100_000]
        x = np.repeat(np.arange(k, k + len(c)), c)
        y = lo[x] + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
        x, y = row[text[x]], column[text[y]]
        use = (x >= 0) & (y >= 0)
        np.add.at(out.reshape(-1), x[use] * len(second) + y[use], np.float32(1))
    return out


def _forest(near: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs that connect what the matrix connects: rows with columns, or, if both are the same texts, rows with rows; else columns count on from the rows."""
    n = len(near)
    back, shift = (near, 0) if same else (np.ascontiguousarray(near.T), n)
    todo = np.ones(n if same else n + near.shape[1], bool)
    for start in range(n):
        stack = [start] if todo[start] else []
        todo[start] = False
        while stack:
            v = stack.pop()
            row, base = (near[v], shift) if v < n else (back[v - n], 0)
            new = np.flatnonzero(row & todo[base : base + len(row)]) + base
            todo[new] = False
            for w in new.tolist():
                yield v, w
            stack += new.tolist()


def _tiles(t: float):
    """The texts of a tile, all of side 0 or of sides 1 and 2, to _WITHIN, by its similar pairs; those across if it has two sides."""
    schema = _arrow(_WITHIN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, b in runs(batches, "tile"):
            side, id_, n, w = (b[k].to_numpy() for k in ("side", "id", "n", "w"))
            sets = [np.frombuffer(x.as_py(), "<u8") for x in b["grams"]]
            same = not side.any()
            first, second = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
            if not len(first) or not len(second):
                continue
            near = _shared(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), first, second)
            by_row, by_column = np.zeros(len(first)), np.zeros(len(second))
            close = np.zeros(near.shape, bool)
            for k in range(0, len(first), 256):
                mine = first[k : k + 256]
                close[k : k + 256] = near[k : k + 256] >= np.ceil(t / (1 + t) * (n[mine][:, None] + n[second][None]) - 1e-9)
                if same:
                    close[mine, mine] = False
                here = close[k : k + 256].astype(np.float64)
                by_row[k : k + 256] = here @ w[second]
                by_column += w[mine] @ here
            del near
            for who, links in ((first, by_row),) if same else ((first, by_row), (second, by_column)):
                for k in np.flatnonzero(links).tolist():
                    yield 0, int(id_[who[k]]), int(links[k])
            place = id_[first] if same else np.concatenate([id_[first], id_[second]])
            for v, u in _forest(close, same):
                yield 1, *sorted((int(place[v]), int(place[u])))

    return lambda batches: _emit(rows(batches), schema)


def _families(sets: DataFrame) -> DataFrame | None:
    """(id, family): texts whose sketches are like that of one text, by the id of that; None if there are no families.

    Texts of a family have one of the SKETCH values in common with its first, the least id of those that have the value,
    and ALIKE of them; a text is in the family that it has the most in common with. What families can't take is joined by prefixes.
    """
    keys = sets.where(F.octet_length("sketch") > 0).select("id", F.explode(F.sequence(F.lit(0), F.lit(SKETCH - 1))).alias("slot"), "sketch")
    keys = written(keys.select("id", "slot", F.expr("substring(sketch, 4 * slot + 1, 4)").alias("value")), "sketches")
    first = keys.groupBy("slot", "value").agg(F.min("id").alias("family"), F.count("*").alias("c")).where(F.col("c") > 1).drop("c")
    alike = keys.join(first, ["slot", "value"]).groupBy("id", "family").agg(F.count("*").alias("c")).where(F.col("c") >= ALIKE)
    of = written(alike.groupBy("id").agg(F.max(F.struct("c", (-F.col("family")).alias("f"))).alias("m")).select("id", (-F.col("m.f")).alias("family")), "families")
    sizes = of.groupBy("family").agg(F.count("*").alias("c")).where(F.col("c") >= FAMILY)
    least = taken = 0
    for size, many in sorted(map(tuple, sizes.groupBy("c").count().collect()), reverse=True):
        if (taken := taken + size * many) > FAMILY_TEXTS:
            break
        least = size
    drop(keys)
    if not least:
        drop(of)
        return None
    out = written(of.join(sizes.where(F.col("c") >= least).drop("c"), "family").select("id", "family"), "families")
    drop(of)
    return out


def _within(families: DataFrame, sets: DataFrame, copies: DataFrame, t: float) -> DataFrame:
    """_WITHIN of all families: each is cut into parts of a bounded size, each two of which are a tile."""
    weights = copies.groupBy("id").agg(F.count("*").alias("w"))
    texts = families.join(sets.select("id", "n", "grams"), "id").join(weights, "id", "left").withColumn("w", F.coalesce("w", F.lit(1)))
    texts = written(texts, "members")
    bytes_ = F.sum(F.octet_length("grams") + 64)
    many = texts.groupBy("family").agg(bytes_.alias("size"), F.count("*").alias("c"))
    many = many.select("family", "size", F.greatest(F.ceil(F.col("c") / TILE_TEXTS), F.ceil(F.col("size") / TILE_BYTES)).cast("int").alias("parts"))
    tasks = min(PARTITIONS, max(1, math.ceil(many.agg(F.sum(F.col("size") * F.col("parts"))).first()[0] / VERIFY_BYTES)))
    own, other = F.col("own"), F.col("other")
    cut = texts.join(many.drop("size"), "family").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(own == other, 0).when(own < other, 1).otherwise(2)
    tile = cut.select(row_key("family", F.least(own, other), F.greatest(own, other)).alias("tile"), side.alias("side"), "id", "n", "w", "grams")
    out = written(tile.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(_tiles(t), _WITHIN), "within", "kind")
    drop(texts)
    return out.select("kind", "a", "b")


def _pairs(texts: DataFrame, chars: int, n: int, t: float, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(similar pairs, None); with copies (similar pairs but those within a family, _WITHIN)."""
    block, buckets, parts = _layout(chars // 6)
    blocks = texts.mapInArrow(_grams(n, block, buckets), _BLOCK).withColumn("to", F.pmod("bucket", F.lit(parts)).cast("int"))
    counted = blocks.repartitionById(parts, "to").drop("to").sortWithinPartitions("bucket").mapInArrow(_count, _BLOCK)
    split = counted.repartition(parts, "src").sortWithinPartitions("src").mapInArrow(_prefixes(t, buckets, HOT_TEXTS, 0 if copies is None else FAMILY), _PREFIX)
    prefixes = written(split, "prefixes", "kind")
    sets = prefixes.where("kind = 0").select(F.col("key").alias("id"), "n", "cell", "grams", F.col("texts").alias("sketch"))
    families, sent, within = None, None, None
    if copies is not None:
        families = _families(sets)
        within = copies.sparkSession.createDataFrame([], _WITHIN) if families is None else _within(families, sets, copies, t)
    if families is not None:
        known = families.orderBy("id").toArrow()
        number = np.unique(known["family"].to_numpy(), return_inverse=True)[1] + 1
        sent = texts.sparkSession.sparkContext.broadcast((known["id"].to_numpy(), number.astype(np.int32)))
        drop(families)
    by_cell = sets.groupBy("cell").agg(F.count("*").alias("c"), F.sum(F.octet_length("grams") + 64).alias("w"))
    units = F.greatest(F.ceil(F.col("c") / CELL_TEXTS), F.ceil(F.col("w") / CELL_BYTES))
    # at most one entry for CELL_TEXTS texts or CELL_BYTES of sets goes to the driver
    sizes = by_cell.agg(F.sum("c"), F.sum("w"), F.map_from_entries(F.collect_list(F.when(units > 1, F.struct("cell", units))))).first()
    targets, hot = max(1, math.ceil((sizes[0] or 0) / CELL_TEXTS), math.ceil((sizes[1] or 0) / CELL_BYTES)), {int(k): int(v) for k, v in (sizes[2] or {}).items()}
    tasks = math.ceil(targets / math.ceil(targets / PARTITIONS))
    postings = prefixes.where("kind = 1").drop("kind", "n", "cell").withColumn("to", F.pmod("key", F.lit(parts)).cast("int"))
    found = postings.repartitionById(parts, "to").drop("to").sortWithinPartitions("key").mapInArrow(_candidates(t, targets, tasks, hot, PAIRS_AT_ONCE, sent), _FOUND_PAIRS)
    once = written(found.repartitionById(tasks, "to").drop("to").sortWithinPartitions("target").mapInArrow(_once(CELL_BYTES, PAIRS_AT_ONCE), _PAIR), "pairs", "kind")
    needed = once.where("kind = 0")
    tasks = min(PARTITIONS, max(1, math.ceil((needed.agg(F.sum("w")).first()[0] or 0) / VERIFY_BYTES)))
    whole = needed.select("sub", "id").join(sets.select("id", "n", "grams"), "id").select("sub", F.lit(0).alias("kind"), "id", "n", F.col("grams").alias("a"), F.lit(None).cast("binary").alias("b"))
    joined = whole.unionByName(once.where("kind = 1").select("sub", F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("n"), "a", "b"))
    out = joined.repartition(tasks, "sub").sortWithinPartitions("sub", "kind").mapInArrow(_verify(t), _FOUND)
    pairs = written(out, "similar")
    drop(prefixes, once)
    return pairs, within


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> Similar:
    """All pairs of texts whose sets of word n-grams have a Jaccard similarity of threshold or more. Exact.

    A row with a null id or text, and a text without a word, is in no pair. A text of fewer than n words
    has one gram, of all its words. Rows that repeat an id and text are one text; where an id has
    several texts, the one of the least hash stands for it. Other columns are not read.
    An empty table gives no pairs. Texts of any length are read whole.
    """
    return Similar(*_joined(docs, id_col, text_col, n, threshold, False)[:2])


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> Linked:
    """What join() finds, with pairs within families of near copies counted and not made."""
    return Linked(*_joined(docs, id_col, text_col, n, threshold, True))


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, families: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    docs = bounded(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(T.WORD_SQL))
    hashed = lambda df: df.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    by_id = hashed(texts).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("v"))
    one = by_id.select("id", "v", F.col("v")[0]["h1"].alias("h1"), F.col("v")[0]["h2"].alias("h2"))
    least = one.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "least")
    groups = written(one.join(least, ["h1", "h2"]).select("least", "id", "h1", "h2"), "copies")
    copies = groups.where("id <> least").select("id", "h1", "h2")
    others = by_id.where(F.size("v") > 1).select("id", F.inline(F.slice("v", F.lit(2), F.size("v"))))
    extra = written(copies.unionByName(others).select(row_key("id", "h1", "h2").alias("k")), "extra")
    apart = hashed(texts).withColumn("k", row_key("id", "h1", "h2")).join(sized(extra), "k", "left_anti").select("id", "text")
    copies = groups.select(F.col("least").alias("id"), F.col("id").alias("member"))
    pairs, within = _pairs(apart, texts.agg(F.sum(F.length("text"))).first()[0] or 0, n, threshold, copies if families else None)
    drop(extra)
    return copies, pairs, within


def all_pairs(found: Similar) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: each similar pair once, copies with all their partners.

    As large as the result of a join is: quadratic in the size of a group of copies. Ids are never null (join() leaves
    such rows out), rows that repeat an id are one text, and without copies and pairs there are no rows.
    """
    a, b = found.copies.toDF("a", "x"), found.copies.toDF("b", "y")
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    across = found.pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "jaccard")
    return within.unionByName(across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard"))


def losers(found: Similar | Linked) -> DataFrame:
    """(id): of each group of texts that similar pairs connect, all but the least id; no rows if nothing is similar."""
    return _groups(found).select("id")


def _groups(found: Similar | Linked) -> DataFrame:
    """(id, least): of each group of texts that similar pairs connect, all but the least id, which the others have beside them.

    Components by large-star and small-star steps, over a written table in each round; a copy joins its
    group's least id at the start, so that rounds see one text of each set of equal ones.
    """
    star = found.copies.select(F.col("member").alias("u"), F.col("id").alias("v")).where("u <> v")
    pairs = found.pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if isinstance(found, Linked):
        pairs = pairs.unionByName(found.within.where("kind = 1").select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = written(pairs.unionByName(star).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = written(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = new
        if now == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("least"))
        last = now


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, links): each id once, the least id of the group that similar pairs connect it with, and how many other ids its text is similar to.

    Every pair of similar texts counts, copies too. An id without a text or a word is alone, a null id is in no row;
    repeated rows are as in join(). An empty table gives no rows.
    """
    found = linked(docs, id_col, text_col, n, threshold)
    of = found.copies.groupBy("id").agg(F.count("*").alias("c"))
    ends = found.pairs.select("a", "b").unionByName(found.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(of, F.col("b") == F.col("id"), "left").select(F.col("a").alias("id"), F.coalesce("c", F.lit(1)).alias("k"))
    others = ends.unionByName(found.within.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))
    members = found.copies.join(of, "id").select(F.col("member"), "id", "c")
    both = others.join(members, "id", "full").select(F.coalesce("member", "id").alias("id"), (F.coalesce("k", F.lit(0)) + F.coalesce("c", F.lit(1)) - 1).alias("links"))
    known = both.join(_groups(found), "id", "left")
    every = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return every.join(known, "id", "left").select("id", F.coalesce("least", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each group of similar texts: the one of the least id stays.

    Documents without an id, a text or a word stay. Of rows that repeat an id, one stays: of the least
    text. All columns of docs are kept, under their names.
    """
    name, rank = fresh(docs, "id", "rank")
    key = F.col(id_col).cast("long")
    with collected() as made:
        found = linked(docs, id_col, text_col, n, threshold)
    out = sized(losers(found).withColumnRenamed("id", name))
    drop(*made)
    many = written(docs.groupBy(key.alias(name)).count().where(F.col("count") > 1).where(F.col(name).isNotNull()).select(name), "repeated")
    kept = docs.join(out, key == F.col(name), "left_anti")
    if many.isEmpty():
        return kept
    many = sized(many)
    plain = [c for c, kind in docs.dtypes if not re.search("map<|variant", kind)]
    one = Window.partitionBy(key).orderBy(F.col(text_col).asc_nulls_last(), row_key(*plain))
    again = kept.join(many, key == F.col(name), "left_semi").withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).drop(rank)
    return kept.join(many, key == F.col(name), "left_anti").unionByName(again)
