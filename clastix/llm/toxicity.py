"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; a later model sees the probabilities of the earlier
ones, and is trained on out-of-fold ones, so that it meets the errors it will meet in use. Features are
hashed words and word beginnings, weighted by the root of their rate in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .linear import Rows, fit_sparse, sigmoid
from .scratch import bounded, row_key, sized

#: (category, condition over the labels), in the order of the chain.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_prose", "toxic = 1 AND quality = 1"))
TARGET = "toxic"
#: Labelled documents that the chain is fitted on, at most, about; they are those of the least hash.
SAMPLE = 4000
FOLDS = 3
BITS = 18
#: A feature of fewer sampled texts is left out.
LEAST_TEXTS = 5
#: Bytes of word beginnings that are features beside the words.
BEGINNINGS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Chain:
    """Per category: weights of the hashed features, those of the dense ones (a constant, the log of the words, earlier probabilities), and the threshold."""

    names: tuple[str, ...]
    sparse: tuple[np.ndarray, ...]
    dense: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]


def features(text: pa.Array) -> Iterator[tuple[int, int, Rows]]:
    raw, off = T.buffers(T.lower(text))
    for i, j in T.chunks(off):
        part = raw[off[i] : off[j]]
        h, first, last, word = T.words(part, off[i : j + 1] - off[i])
        doc = np.repeat(np.arange(j - i), np.diff(word))
        sums = np.append(np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * T._powers("up", len(part)), dtype=np.uint64))
        down = T._powers("down", len(part))
        keys = [(doc.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))]
        for k in BEGINNINGS:
            at = last - first > k
            g = T.mix((sums[first[at] + k] - sums[first[at]]) * down[first[at]] + np.uint64(k))
            keys.append((doc[at].astype(np.uint64) << np.uint64(BITS)) | (g >> np.uint64(64 - BITS)))
        key = np.concatenate(keys)
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        key = key[new]
        row = (key >> np.uint64(BITS)).astype(np.int64)
        words = np.diff(word)
        value = 10 * np.sqrt(count / np.maximum(1, words)[row])
        start = np.searchsorted(row, np.arange(j - i + 1))
        yield i, j, Rows(start, (key & np.uint64((1 << BITS) - 1)).astype(np.int64), value, np.column_stack([np.ones(j - i), np.log1p(words) / 10]))


def _columns(earlier: list[np.ndarray]) -> list[np.ndarray]:
    return [2 * p - 1 for p in earlier]


#: Fits, for a category, (sparse, dense) weights on each of several sets of rows: (columns of earlier probabilities, truth, sets; None is all rows).
Fits = Callable[[list[np.ndarray], np.ndarray, list[np.ndarray | None]], list[tuple[np.ndarray, np.ndarray]]]


def _fit(x: Rows, columns: list[np.ndarray], y: np.ndarray, at: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = x.beside(*columns) if columns else x
    return fit_sparse(rows, y, width) if at is None else fit_sparse(rows.take(at), y[at], width)


def fit_chain(x: Rows, labels: np.ndarray, names: tuple[str, ...], fold: np.ndarray, width: int, fits: Fits | None = None) -> Chain:
    """labels: rows by categories, 0 or 1. A category without both values gets the constant model of its share. fits may run the fits of a category side by side."""
    fits = fits or (lambda columns, y, sets: [_fit(x, columns, y, at, width) for at in sets])
    sparse, dense, cuts, earlier = [], [], [], []
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        columns = _columns(earlier)
        rows = x.beside(*columns) if columns else x
        out = np.zeros(len(y))
        if y.min(initial=1) == y.max(initial=0) or len(y) < 2 * FOLDS:
            b, c = np.zeros(width), np.zeros(rows.dense.shape[1])
            share = float(y.mean()) if len(y) else 0.0
            c[0] = 20.0 if share == 1 else -20.0
            out[:] = share
        else:
            *folds, (b, c) = fits(columns, y, [*(np.flatnonzero(fold != f) for f in range(FOLDS)), None])
            for f, (fb, fc) in enumerate(folds):
                own = np.flatnonzero(fold == f)
                out[own] = sigmoid(rows.take(own).dot(fb, fc))
        earlier.append(out)
        sparse.append(b.astype(np.float32))
        dense.append(c)
        cuts.append(_best_cut(out, y))
    return Chain(names, tuple(sparse), tuple(dense), tuple(cuts))


def _on_tasks(spark: SparkSession, x: Rows, width: int) -> Fits:
    """The fits of a category as tasks, a set of rows in each."""
    sent = spark.sparkContext.broadcast((x.start, x.index, x.value, x.dense))

    def fits(columns: list[np.ndarray], y: np.ndarray, sets: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    b, c = _fit(Rows(*sent.value), columns, y, sets[k], width)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b.astype("<f8").tobytes()], pa.binary()), pa.array([c.astype("<f8").tobytes()], pa.binary())], names=["k", "b", "c"])

        got = spark.range(0, len(sets), 1, len(sets)).mapInArrow(go, "k long, b binary, c binary").collect()
        return [(np.frombuffer(r.b, "<f8"), np.frombuffer(r.c, "<f8")) for r in sorted(got, key=lambda r: r.k)]

    return fits


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 on out-of-fold probabilities; one half if there is nothing to choose."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.where(last, f1, -1).argmax())
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", categories: tuple = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """The chain of these categories.

    Labelled rows with a null id or a null condition don't count; of several labels of a document the positive one
    counts, of several texts the least. Labels without a document and documents without a label teach nothing; without
    any, as with empty tables, no text is in any category. A feature that fewer than LEAST_TEXTS of the texts have is
    left out. Texts are read whole. The fits of a category, one for each fold and one for all, run as tasks.
    """
    docs = bounded(docs)
    marks = labels.select(F.col(label_id).cast("long").alias("id"), *[F.expr(rule).cast("int").alias(f"y{k}") for k, (_, rule) in enumerate(categories)]).dropna()
    share = min(1.0, sample / max(1, marks.count()))
    marks = marks.where(F.pmod(row_key("id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))])
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(sized(marks), "id")
    known = known.groupBy("id", *[f"y{k}" for k in range(len(categories))]).agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in features(b.column(b.num_columns - 1)):
                cut = lambda v, x=x: pa.array([v[s:e].tobytes() for s, e in zip(x.start, x.start[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:-1]], cut(x.index.astype("<i4")), cut(x.value.astype("<f4")), pa.array(x.dense[:, 1])], names=[*names, "index", "value", "size"])

    names = ["id", *[f"y{k}" for k in range(len(categories))]]
    got = known.select(*names, "text").mapInArrow(rows, "id long, " + ", ".join(f"{n} int" for n in names[1:]) + ", index binary, value binary, size double").toPandas().sort_values("id")
    index = [np.frombuffer(v, "<i4") for v in got["index"]]
    start = np.append(0, np.cumsum([len(v) for v in index])).astype(np.int64)
    flat = np.concatenate(index).astype(np.int64) if index else np.zeros(0, np.int64)
    value = np.concatenate([np.frombuffer(v, "<f4") for v in got["value"]]).astype(float) if index else np.zeros(0)
    keep = np.bincount(flat, minlength=1 << BITS)[flat] >= LEAST_TEXTS
    row = np.repeat(np.arange(len(index)), np.diff(start))
    start = np.searchsorted(row[keep], np.arange(len(index) + 1))
    used, packed = np.unique(flat[keep], return_inverse=True)
    x = Rows(start, packed, value[keep], np.column_stack([np.ones(len(index)), got["size"].to_numpy(float)]))
    fold = np.array([(int(i) * 2654435761 >> 7) % FOLDS for i in got["id"]], int)
    chain = fit_chain(x, got[names[1:]].to_numpy(int), tuple(n for n, _ in categories), fold, len(used), _on_tasks(docs.sparkSession, x, len(used)))
    wide = []
    for b in chain.sparse:
        full = np.zeros(1 << BITS, np.float32)
        full[used] = b
        wide.append(full)
    return Chain(chain.names, tuple(wide), chain.dense, chain.thresholds)


def probabilities(chain: Chain, text: pa.Array) -> np.ndarray:
    """Texts by categories."""
    out = np.zeros((len(text), len(chain.names)))
    for i, j, x in features(text):
        for k in range(len(chain.names)):
            rows = x.beside(*_columns([out[i:j, m] for m in range(k)])) if k else x
            out[i:j, k] = sigmoid(rows.dot(chain.sparse[k], chain.dense[k]))
    return out


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> of each, is_<category> of each) for each row.

    A null text counts as an empty one; a text without a word is in no category. Null ids stay null, and
    repeated rows get a row each; an empty table gives no rows. Texts are read whole.
    """
    docs = bounded(docs)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *[f"p_{n}" for n in chain.names], *[f"is_{n}" for n in chain.names]]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(sent.value, b.column(1))
            raw, off = T.buffers(b.column(1))
            has = np.add.reduceat(np.append(T._WORD[raw], False).astype(np.int64), off[:-1]) > 0 if len(off) > 1 else np.zeros(0, bool)
            has &= np.diff(off) > 0
            flags = [pa.array((p[:, k] >= t) & has) for k, t in enumerate(sent.value.thresholds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.round(np.where(has, p[:, k], 0.0), 6)) for k in range(p.shape[1])], *flags], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = ", ".join([f"doc_id {kind}", *[f"{n} double" for n in names[1 : 1 + len(chain.names)]], *[f"{n} boolean" for n in names[1 + len(chain.names) :]]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(go, ddl)
