"""Documents packed into sequences of a fixed length: hierarchical best-fit.

Each partition packs its own documents best-fit. Bins that are nearly full are done; the others are
items of the next round, in a fraction of the partitions, and so on up to one partition. Only ids and
lengths move; in each round only those of bins that are not yet full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, written

CAPACITY = 2048
#: A bin filled to this share is done.
NEARLY = 0.98
#: So many partitions of a round make one of the next.
FAN_IN = 8
#: A piece: a word or a sign that is not white space.
PIECE = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[^\s0-9A-Za-z_\x{80}-\x{10FFFF}]"

_BIN = "bin long, fill int, doc_ids array<long>, starts array<int>, lengths array<int>, done boolean"
_SCHEMA = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("done", pa.bool_())])

Item = tuple[int, list[int], list[int], list[int]]


def best_fit(items: list[Item], capacity: int) -> list[Item]:
    """Items (size, doc ids, starts, lengths), the largest first, each put into the fullest bin that has room for it."""
    items = sorted(items, key=lambda x: (-x[0], x[1], x[2]))
    bins: list[Item] = []
    room: dict[int, list[int]] = {}
    free = 0  # bit r: some bin has r left
    for size, ids, starts, lengths in items:
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
            fill, a, b, c = bins[k]
            bins[k] = (fill + size, a + ids, b + starts, c + lengths)
            left = r - size
        else:
            k, left = len(bins), capacity - size
            bins.append((size, ids, starts, lengths))
        if left:
            room.setdefault(left, []).append(k)
            free |= 1 << left
    return bins


def _round(number: int, last: bool, capacity: int, nearly: float, read: Callable[[pa.RecordBatch], Iterator[Item]]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (number << 56) | (TaskContext.get().partitionId() << 30)
        items: list[Item] = []
        count = 0

        def out(bins: list[Item], done: list[bool]) -> Iterator[pa.RecordBatch]:
            nonlocal count
            for i in range(0, len(bins), 5000):
                part = bins[i : i + 5000]
                at = [base + count + k for k in range(len(part))]
                count += len(part)
                columns = [at, *([x[f] for x in part] for f in range(4)), done[i : i + 5000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

        for b in batches:
            full = []
            for x in read(b):
                (full if x[0] == capacity else items).append(x)
            yield from out(full, [True] * len(full))
        bins = best_fit(items, capacity)
        yield from out(bins, [last or x[0] >= nearly * capacity for x in bins])

    return go


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, nearly: float = NEARLY, fan_in: int = FAN_IN) -> DataFrame:
    """(bin, fill, doc_ids, starts, lengths): bins of at most capacity pieces.

    lengths[i] pieces of document doc_ids[i], from its starts[i]th (from 0), lie in the bin, one document
    after the other; fill is their sum. A document longer than a bin is cut into full bins and a rest, so
    that each piece of each document is in exactly one bin. Rows with a null id or text, and texts
    without a piece, are in none. Repeated rows are packed each. bin is unique, without further meaning;
    ties go to the lower id. An empty table gives no rows. Other columns are not read.
    """
    docs = bounded(docs)
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), F.regexp_count(F.col(text_col), F.lit(PIECE)).alias("n")).where("id IS NOT NULL AND n > 0")

    def texts(b: pa.RecordBatch) -> Iterator[Item]:
        for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for s in range(0, n, capacity):
                k = min(capacity, n - s)
                yield k, [i], [s], [k]

    def bins(b: pa.RecordBatch) -> Iterator[Item]:
        yield from zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)))

    parts = max(1, sizes.rdd.getNumPartitions())
    done: list[DataFrame] = []
    now, number = None, 0
    while True:
        last = parts == 1
        if now is None:
            made = (sizes.coalesce(1) if last else sizes).mapInArrow(_round(0, last, capacity, nearly, texts), _BIN)
        else:
            made = now.repartition(parts, "bin").mapInArrow(_round(number, last, capacity, nearly, bins), _BIN)
        made = written(made, "bins", "done")
        done.append(made.where("done").drop("done"))
        if last:
            break
        now, number, parts = made.where("NOT done"), number + 1, math.ceil(parts / fan_in)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
