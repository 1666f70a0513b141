"""Operator 7: quality of texts by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader
updates and scored as sparse dot products.

A text is cut into words (runs of letters, digits and bytes beyond ASCII) and runs of other signs; A-Z are folded to
lower case. Features are single words and pairs of neighbours, and single, paired and tripled word shapes (upper case,
capitalised, digit, sign, and whether a word repeats the one before), each hashed to one of 2**BITS weights; a feature's
value is its share of all the text's features times SCALE. An empty or null text has the bias alone.

Training takes at most MAX_TRAIN labelled rows, those with the smallest hash of doc_id; that bound keeps the one training
task at a fixed size, and the model, 2**BITS floats, is what is sent to the executors. Everything else runs over all rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, mix, prefix_hash, seeded, trimmed, window_hash

BITS = 18
MAX_TRAIN = 6000
PASSES = 3
THRESHOLD = 0.3
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
_K = seeded(4, 7)
_KIND = np.full(256, 1, np.uint8)  # 0 white, 1 sign, 2 word
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
U64 = np.uint64


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, weight index) of every feature of the documents whose bytes lie between the offsets."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    doc = np.searchsorted(offsets, starts, "right") - 1
    h = window_hash(prefix_hash(_LOW[data]), starts, ends)
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    first = data[starts]
    shape = np.select([kind[starts] == 1, uppers[ends] - uppers[starts] >= 2, _UPPER[first], (first >= 48) & (first < 58)], [1, 2, 3, 4], 5).astype(U64)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, bool)
    shape = shape * U64(2) + same
    docs, grams = [], []
    for x, tag, widths in ((h, 0, (1, 2)), (shape, 1, (1, 2, 3))):
        for n in widths:
            if len(x) >= n:
                g = np.full(len(x) - n + 1, 100 * tag + n, U64)
                for k in range(n):
                    g = mix(g + x[k : len(x) - n + 1 + k] * _K[k])
                whole = doc[: len(g)] == doc[n - 1 :]
                docs.append(doc[: len(g)][whole]), grams.append(g[whole])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), (np.concatenate(grams) >> U64(64 - BITS)).astype(np.int64)


def vectors(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row (indices, ascending; values)."""
    out = []
    for _, offsets, data in byte_chunks(batch):
        doc, index = features(offsets, data)
        order = np.argsort(doc, kind="stable")
        for part in np.split(index[order], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))[:-1]):
            i, n = np.unique(part, return_counts=True)
            out.append((i, SCALE * n / max(1, len(part))))
    return out


def scores(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
    """Per row the logistic of its sparse dot product with the weights."""
    out = [np.zeros(0)]
    for _, offsets, data in byte_chunks(batch):
        doc, index = features(offsets, data)
        n = len(offsets) - 1
        total = np.bincount(doc, weights=w[index], minlength=n) * SCALE / np.maximum(1, np.bincount(doc, minlength=n))
        out.append(1 / (1 + np.exp(-np.clip(total + w[-1], -35, 35))))
    return np.concatenate(out)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights, the bias last, by FTRL-proximal over the rows in their order, PASSES times. Both labels weigh the same."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    good = sum(y for *_, y in rows)
    share = {1.0: len(rows) / 2 / max(1, good), 0.0: len(rows) / 2 / max(1, len(rows) - good)}

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for index, value, y in rows:
            i, x = np.append(index, 2**BITS), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * share[y] * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(2**BITS + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Learns from the rows of labels with a label of 0 or 1 whose crc32(doc_id) is no multiple of 5. Nulls are left out;
    of repeated rows each counts. Without both labels the model is the bias alone."""
    asked = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("double").alias("y"))
    chosen = asked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_train rows of two numbers at most

    def sparse(batches):
        for batch in batches:
            found = vectors(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["doc_id", "y", "i", "v"])

    def learn(t: pa.Table) -> pa.Table:
        order = sorted(range(len(t)), key=lambda k: (zlib.crc32(str(t["doc_id"][k].as_py()).encode()), len(t["i"][k])))
        found = [(np.asarray(t["i"][k].values, np.int64), np.asarray(t["v"][k].values, float), t["y"][k].as_py()) for k in order]
        return pa.table({"w": pa.array([train(found).tobytes()], pa.binary())})

    got = rows.mapInArrow(trimmed(sparse), "doc_id bigint, y double, i array<int>, v array<float>").groupBy(F.lit(0).alias("one")).applyInArrow(learn, "w binary").first()
    return np.frombuffer(got[0], np.float32).copy() if got else np.zeros(2**BITS + 1, np.float32)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted added; columns of those names are replaced. Every row has a score."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 floats, whatever the data

    def run(batches):
        w = sent.value
        for batch in batches:
            p = scores(batch, w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(trimmed(run), f"{fields}, score double, predicted int")
