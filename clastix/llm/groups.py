"""Streams of Arrow batches that come sorted by an integer key, cut into runs of one key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .tokens import settle


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, its rows) for batches sorted by key; only the rows of one key are held."""
    held: list[pa.RecordBatch] = []
    now: int | None = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:]):
            if now is not None and int(k[i]) != now:
                yield now, pa.Table.from_batches(held)
                held = []
                settle()
            now = int(k[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)
    settle()
