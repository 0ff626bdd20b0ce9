"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (n-gram buckets x languages), learned from labelled documents
and sent to the tasks; texts are scored a batch at a time in numpy, as sums of matrix rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from . import tokens as T
from .scratch import bounded, drop, row_key, written

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Labelled documents that a model is fitted on, at most, about; they are those of the least hash.
SAMPLE = 12_000
#: The language of a text that is rejected: its n-grams are less likely than those of held-out labelled texts, or a uniform model over the buckets explains it better.
UNKNOWN = "und"
#: The bound of n n-grams lies below a language's median by SLACK times the deviation that all but RARE of the labelled
#: texts keep within, and by SPREAD / sqrt(n); both in nats an n-gram.
RARE, SLACK, SPREAD = 0.001, 1.5, 10.0
#: Held-out texts, of all and of a language, below which there is no such bound.
LEAST, LEAST_EACH = 20, 5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_probs: np.ndarray  # (2 ** BUCKET_BITS + 1, languages), float32; the last row is zero
    log_prior: np.ndarray
    floor: np.ndarray  # of each language, the least log likelihood an n-gram of a very long text


_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _features(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts (first, last + 1): the hashed n-grams of each order, one after the other, and the offsets of texts in characters.

    Characters are in lower case; digits, signs and white space are one character, of which runs count once.
    """
    raw, off = T.buffers(T.lower(text))
    for i, j in T.chunks(off):
        part = raw[off[i] : off[j]]
        begin = (part & 0xC0) != 0x80
        at = np.append(0, np.cumsum(begin))[off[i : j + 1] - off[i]]
        chars = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        letter = (chars >= 97) & (chars <= 122) | (chars >= 128)
        chars = np.where(letter, chars, 32).astype(np.uint32)
        keep = letter | np.append(True, letter[:-1])
        keep[at[:-1][at[:-1] < len(chars)]] = True
        place = np.append(0, np.cumsum(keep))
        chars, at = chars[keep], place[at]
        row = np.zeros(len(chars), bool)
        row[at[1:-1][at[1:-1] < len(chars)]] = True
        grams, blank = [], np.uint32(32)
        one = np.append(np.append(chars, blank), blank)
        for n in ORDERS:
            h = np.zeros(len(chars), np.uint32)
            for k in range(n):
                h = (h ^ one[k : k + len(chars)]) * _MUL[k]
                h ^= h >> np.uint32(15)
            h = (h * np.uint32(0x27D4EB2F) + np.uint32(n)) >> np.uint32(32 - BUCKET_BITS)
            bad = np.zeros(len(chars), bool)  # n-grams that reach into the next text, and single blanks
            for k in range(1, n):
                bad[: len(chars) - k] |= row[k:]
                bad[max(0, len(chars) - k) :] = True
            if n == 1:
                bad |= chars == 32
            grams.append(np.where(bad, 1 << BUCKET_BITS, h).astype(np.int32))
        yield i, j, np.stack(grams), at


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from labelled documents. Rows with a null label or text don't count; without a labelled row every text is rejected.

    Of more than sample labelled rows about sample are used, of the least hashes of id and label. Each half of
    them is scored by a model of the other half, for the bounds of rejection.
    """
    docs = bounded(docs)
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).cast("string")).count().collect()}
    languages = tuple(sorted(sizes))
    each = max(1, sample // max(1, len(languages)))
    key = F.pmod(row_key(F.col(id_col), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, each / sizes[k]))]) if languages else None
    width = (1 << BUCKET_BITS) + 1
    counts, docs_of = np.zeros((2, width, max(1, len(languages)))), np.zeros(max(1, len(languages)))
    floor = np.full(len(languages), -np.inf)
    if languages:
        number = {k: i for i, k in enumerate(languages)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                label = np.array([number[x] for x in b.column(0).to_pylist()]) * 2 + np.array(b.column(2).to_pylist())
                for i, j, grams, at in _features(b.column(1)):
                    who = np.repeat(label[i:j], np.diff(at))
                    for k in np.unique(label[i:j]).tolist():
                        have = total.setdefault(divmod(k, 2), np.zeros(width, np.int64))
                        for g in grams:
                            have += np.bincount(g[who == k], minlength=width)
            for (k, half), have in total.items():
                at = np.flatnonzero(have[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(np.full(len(at), half)), pa.array(at), pa.array(have[at])], names=["k", "half", "bucket", "n"])

        half = F.pmod(row_key(F.col(id_col), F.col(text_col), F.lit("half")), F.lit(2)).cast("int").alias("half")
        few = rows.select(F.col(label_col).cast("string").alias("l"), F.col(text_col).alias("t"), half, key.alias("u")).where(F.col("u") < share[F.col("l")]).drop("u")
        few = written(few, "labelled")
        got = few.mapInArrow(count, "k long, half long, bucket long, n long").groupBy("k", "half", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[got["half"].to_numpy(), got["bucket"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
        docs_of[:] = [sizes[k] for k in languages]
        floor = _floor(few, languages, [_logs(c) for c in counts[::-1]])
        drop(few)
    prior = np.log(docs_of / max(1, docs_of.sum()))[: len(languages)] if languages else np.zeros(0)
    return Model(languages, _logs(counts.sum(0))[:, : len(languages)], prior, floor)


def _logs(counts: np.ndarray) -> np.ndarray:
    counts = counts[:-1] + SMOOTHING
    logs = np.zeros((len(counts) + 1, counts.shape[1]), np.float32)
    logs[:-1] = np.log(counts / counts.sum(0))
    return logs


def _floor(few: DataFrame, languages: tuple[str, ...], logs: list[np.ndarray]) -> np.ndarray:
    """The floors of Model: each text of few (language, text, half) is scored by the model of the other half's texts, logs[its half]."""
    nothing = np.zeros(len(languages))
    sent = few.sparkSession.sparkContext.broadcast([Model(languages, x, nothing, nothing) for x in logs])
    number = {k: i for i, k in enumerate(languages)}

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, half = np.array([number[x] for x in b.column(0).to_pylist()], int), np.array(b.column(2).to_pylist(), int)
            for h in (0, 1):
                like, n = scores(sent.value[h], b.column(1).filter(pa.array(half == h)))
                k = label[half == h][n > 0]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[n > 0]), pa.array(like[n > 0][np.arange(len(k)), k])], names=["k", "n", "like"])

    got = few.mapInArrow(rate, "k long, n long, like double").toPandas()
    sent.unpersist()
    k, n = got["k"].to_numpy(), got["n"].to_numpy()
    each = got["like"].to_numpy() / np.maximum(n, 1)
    middle = np.array([np.median(each[k == i]) if (k == i).sum() >= LEAST_EACH else -np.inf for i in range(len(languages))])
    known = np.isfinite(middle[k])
    if known.sum() < LEAST:
        return np.full(len(languages), -np.inf)
    off = middle[k[known]] - each[known] - SPREAD / np.sqrt(n[known])
    return middle - SLACK * max(0.0, float(np.quantile(off, 1 - RARE)))


def scores(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The log likelihood of each text (rows) for each language, and the number of its n-grams."""
    out, n = np.zeros((len(text), len(model.languages))), np.zeros(len(text), np.int64)
    for i, j, grams, at in _features(text):
        have = at[1:] > at[:-1]
        if not have.any():
            continue
        start = at[:-1][have]
        total = np.zeros((len(start), len(model.languages)))
        for g in grams:
            for k in range(len(model.languages)):
                total[:, k] += np.add.reduceat(model.log_probs[:, k][g], start, dtype=np.float64)
            n[i:j][have] += np.add.reduceat((g < 1 << BUCKET_BITS).astype(np.int64), start)
        out[i:j][have] = total
    return out, n


def verdicts(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language's number or -1, its probability among the languages, keep)."""
    like, n = scores(model, text)
    if not model.languages:
        return np.full(len(text), -1), np.zeros(len(text)), np.zeros(len(text), bool)
    post = like + model.log_prior
    best = post.argmax(1)
    top = post[np.arange(len(best)), best]
    prob = 1 / np.exp(post - top[:, None]).sum(1)
    least = np.maximum(model.floor[best] - SPREAD / np.sqrt(np.maximum(n, 1)), -BUCKET_BITS * np.log(2))
    keep = (n > 0) & (like[np.arange(len(best)), best] > n * least)
    return np.where(keep, best, -1), np.where(keep, prob, 0.0), keep


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, probability, keep) for each row of docs.

    A text is rejected (keep false, language "und", probability 0) if it has no letters, is null, fits
    no language better than the uniform model, or is less likely in its language than the bound that fit()
    takes from held-out labelled texts. Ties go to the language that comes first by name. A null
    id stays null; repeated rows get a row each; an empty table gives no rows. Texts are read whole.
    """
    docs = bounded(docs)
    sent = _sent(docs, model)
    names = [*model.languages, UNKNOWN]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, prob, keep = verdicts(sent.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(np.round(prob, 6)), pa.array(keep)], names=["doc_id", "language", "probability", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(go, f"doc_id {kind}, language string, probability double, keep boolean")


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that identify() keeps, all their columns."""
    docs = bounded(docs)
    sent = _sent(docs, model)
    at = docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdicts(sent.value, b.column(at))[2]))

    return docs.mapInArrow(go, St.StructType(docs.schema.fields))
