"""Quality classifier on supervised subword embeddings.

A document is the average of the vectors of its features: whole words, word
bigrams and character n-grams within words, all hashed to a fixed number of
buckets.  Bigrams of a word with itself share one bucket, whatever the word.  A
softmax on that average gives the two labels.  Vectors and softmax are learned
together by minibatch stochastic gradient descent in numpy.  As everything
after the average is linear, a learned model is applied as one number per
bucket: the difference of the two classes' logits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import give_back, mix64, run_hashes, text_slices, word_bounds

#: Bound of the labelled documents that are learned from; beyond it documents are drawn by a hash of their id.
MAX_TRAINING_ROWS = 8_000
N_BUCKETS = 1 << 17
NGRAMS = (2, 3, 4)
#: What stands for a bigram of a word with itself before it is hashed.
_TWICE = np.uint64(0x7477696365)
DIMENSIONS = 16
#: Steps of gradient descent at least, and passes over the training rows at least.
LEAST_STEPS = 1_500
EPOCHS = 12
BATCH = 64
RATE = 0.5
SEED = 20240229
#: Bytes of text whose features are made at once: each byte makes some hundred bytes of them.
_SLICE = 1 << 18


@dataclass
class QualityModel:
    """``logit[b]``: what bucket b adds, before averaging; ``bias``: what is added after it."""

    logit: np.ndarray
    bias: float


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a slice of texts, and the row of each."""
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = run_hashes(data, starts, ends)
    found, where = [words], [rows]
    second = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    bigram = mix64(words[second - 1] * np.uint64(0x9E3779B97F4A7C15) + words[second])
    found.append(np.where(words[second - 1] == words[second], mix64(np.array([_TWICE])), bigram))
    where.append(rows[second])
    # Words closed in blanks on both sides: n-grams then tell beginnings and ends apart.
    sizes = ends - starts + 2
    shift = np.concatenate(([0], np.cumsum(sizes)))
    padded = np.full(shift[-1], 32, np.uint8)
    inside = np.ones(shift[-1], bool)
    inside[shift[:-1]] = inside[shift[1:] - 1] = False
    source = np.arange(shift[-1]) - np.repeat(shift[:-1] + 1 - starts, sizes)
    padded[inside] = data[source[inside]]
    owner = np.repeat(rows, sizes)
    room = np.repeat(shift[1:], sizes) - np.arange(shift[-1])
    code = padded.astype(np.uint64)
    gram = code.copy()
    for n in range(2, max(NGRAMS) + 1):
        gram = (gram[:-1] << np.uint64(8)) | code[n - 1 :]
        if n in NGRAMS:
            whole = room[: len(gram)] >= n
            found.append(mix64(gram[whole] | (np.uint64(n) << np.uint64(56))))
            where.append(owner[: len(gram)][whole])
    return (np.concatenate(found) & np.uint64(N_BUCKETS - 1)).astype(np.int64), np.concatenate(where)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> QualityModel:
    """Learn from rows with a text and a label 0 or 1.

    At most about ``max_rows`` rows are used, drawn by a hash of their id.
    Their features are hashed and counted on the executors; the driver gets,
    per training document, its distinct buckets and counts.  With no rows, or
    rows of one label only, the model gives every text the smoothed share of
    label 1.
    """
    known = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    share = max_rows / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column(0), batch.column(2)
            for lo, hi, data, offsets in text_slices(batch.column(1), _SLICE):
                bucket, row = _features(data, offsets)
                key, n = np.unique(row * N_BUCKETS + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(hi - lo + 1) * N_BUCKETS)
                buckets = (key % N_BUCKETS).astype(np.int32)
                blobs = [packed(buckets[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), label.slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["id", "y", "k"])

    schema = "id string, y int, k binary"
    rows = known.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).mapInArrow(hashed, schema).toArrow()
    ids, label = rows.column("id").to_pylist(), rows.column("y").to_pylist()
    docs = rows.column("k").to_pylist()
    # By id, label and features: the same rows in any order give the same model.
    order = sorted(range(len(docs)), key=lambda i: (ids[i] or "", label[i], docs[i]))
    docs, label = [docs[i] for i in order], np.array([label[i] for i in order], np.int64)
    del rows, ids
    model = fit(docs, label)
    give_back()
    return model


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """A document's ascending buckets and their counts, compressed: what the driver holds of a training row."""
    return zstandard.compress(np.concatenate((np.diff(buckets, prepend=0), counts)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document, and the share of each in its features."""
    both = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<i4").reshape(2, -1)
    return np.cumsum(both[0]), both[1] / np.float32(max(1, both[1].sum()))


def fit(docs: list[bytes], label: np.ndarray) -> QualityModel:
    """Stochastic gradient descent on averaged vectors and a two-way softmax; ``docs`` are :func:`packed`."""
    rng = np.random.default_rng(SEED)
    prior = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    nothing = packed(np.zeros(0, np.int64), np.zeros(0, np.int64))
    usable = [i for i, x in enumerate(docs) if x != nothing]
    if len(set(label.tolist())) < 2 or not usable:
        return QualityModel(np.zeros(N_BUCKETS, np.float32), prior)
    vectors = rng.uniform(-1, 1, (N_BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    # Both labels weigh the same, so that the few documents of the rarer one are learned, too.
    weight = len(label) / (2 * np.bincount(label, minlength=2))
    per_epoch = -(-len(usable) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    steps = epochs * per_epoch
    done = 0
    met, place = np.zeros(N_BUCKETS, bool), np.zeros(N_BUCKETS, np.int64)
    for _ in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), BATCH):
            chosen = usable[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            held = [unpacked(docs[i]) for i in chosen]
            keys, share = (np.concatenate(x) for x in zip(*held, strict=True))
            row = np.repeat(np.arange(len(chosen)), [len(k) for k, _ in held])
            # The batch as a dense matrix over the buckets that occur in it: both passes are matrix products.
            met[keys] = True
            used = np.flatnonzero(met)
            met[used] = False
            place[used] = np.arange(len(used))
            x = np.zeros((len(chosen), len(used)), np.float32)
            x[row, place[keys]] = share
            own = vectors[used]
            mean = x @ own
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = label[chosen]
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None].astype(np.float32)
            back = p @ out.T
            out -= rate / len(y) * (mean.T @ p)
            bias -= rate / len(y) * p.sum(0)
            # Averages make gradients small: vectors move by each document's own step.
            vectors[used] = own - rate * (x.T @ back)
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score_slices(model: QualityModel, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of every text of a column."""
    result = np.zeros(len(column))
    for lo, hi, data, offsets in text_slices(column, _SLICE):
        bucket, row = _features(data, offsets)
        total = np.bincount(row, weights=model.logit[bucket], minlength=hi - lo)
        n = np.bincount(row, minlength=hi - lo)
        result[lo:hi] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -50, 50)))
    return result


def predict(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 if at least ``threshold``).

    The whole text is scored, in slices of whole documents.  Null, empty and
    blank texts have no features and get the model's bias alone.  Equal texts
    get equal scores.  Other columns pass through; a column already named
    ``score`` or ``predicted`` raises an error.
    """
    if {"score", "predicted"} & set(docs.columns):
        raise ValueError("the table already has a column score or predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at_text = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_slices(held.value, batch.column(at_text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
