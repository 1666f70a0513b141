"""Operator 11: hard negatives for anchors among labelled embeddings, by a secondary-sort shuffle.

A row's vector is floor(256 * x) of its components, its score with an anchor their integer inner product. An anchor's
positives are its first rows of the same label; each opens a window of scores, 50 * positive <= 100 * score <= 95 * positive,
of which the first rows of another label are its negatives. Higher scores come first, then smaller vec_ids.

1. Positives. Anchors and rows of one label are dealt over blocks; a task multiplies a block of anchors with one of rows
   and lets out what can be among an anchor's first positives, as packed (descending score, kind, id) keys. These are
   repartitioned by anchor and sorted within partitions, and an iterator over the sorted rows keeps the first of each anchor.
2. Negatives. Anchors, now with their windows, meet blocks of all rows; a task lets out, as such keys, what can be among a
   window's first negatives. The second secondary sort brings positives and negatives of an anchor in one descending
   order, where the iterator opens a window at each positive and emits a negative into every window that it falls into and
   that is not full. It holds the windows of one anchor, never its rows.

The sort is the DataFrame form of repartitionAndSortWithinPartitions: one exchange by anchor, one sort by the packed key.
Pairs that their own task already knows to come behind enough better ones for every window never leave it, so the
shuffles grow with anchors times blocks, not with all pairs; every pair's score is computed.

Rows with null label, vec_id or vector, or with null or non-finite components, take no part, nor do rows with a component of
2**31 or more after scaling, whose scores would not fit 64 bits. Vectors of different lengths are not compared. Rows that
repeat a vec_id are rows of their own, each an anchor if its id says so; of equal scores and ids any may stand for the
other, as they read the same. Scores beyond 64 bits are cut to the largest long. More columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, trimmed, trimmed_group

POSITIVES, NEGATIVES, SCALE, ANCHOR_EVERY, LOW, HIGH = 5, 3, 256, 50, 50, 95
#: Anchors, and rows, that a task multiplies.
ANCHOR_BLOCK, ROW_BLOCK = 4096, 4096
_TOP = (1 << 63) - 1
_KEY = np.dtype([("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_FLIP = np.uint64(1 << 63)


def pack(score: np.ndarray, kind: int, vec_id: np.ndarray) -> list[bytes]:
    """Keys whose bytes sort by descending score, kind (0: positive), ascending id."""
    out = np.zeros(len(score), _KEY)
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _FLIP)
    out["kind"], out["id"] = kind, vec_id.astype(np.int64).view(np.uint64) ^ _FLIP
    raw = out.tobytes()
    return [raw[k : k + _KEY.itemsize] for k in range(0, len(raw), _KEY.itemsize)]


def unpack(keys: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """(score, kind, id) of packed keys."""
    x = np.frombuffer(b"".join(keys), _KEY)
    return (~x["score"].astype(np.uint64) ^ _FLIP).view(np.int64).tolist(), x["kind"].tolist(), (x["id"].astype(np.uint64) ^ _FLIP).view(np.int64).tolist()


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the rows of a and b: exact in double precision while they stay below 2**53."""
    size = lambda x: int(np.abs(x).max(initial=0))
    most = size(a) * size(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most <= _TOP:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -_TOP, _TOP).astype(np.int64)


def first(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores; ties go to the earlier place."""
    if len(score) > 4 * n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        at = np.flatnonzero(score >= least)
        return at[np.argsort(-score[at], kind="stable")][:n]
    return np.argsort(-score, kind="stable")[:n]


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """(row, vec_id, label, dim, codes) of the rows that take part; codes are 32-bit whole numbers."""
    v = F.col("v")
    rows = vectors.select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x * SCALE) < float(1 << 31))), F.lit(False))

    def code(batches):
        for batch in batches:
            v = batch.column("v")
            size, whole = np.diff(v.offsets.to_numpy()), np.floor(v.flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i4")
            end = np.cumsum(size)
            codes = pa.array([whole[e - n : e].tobytes() for n, e in zip(size.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label")), pa.array(size.astype(np.int32)), codes], ["row", "vec_id", "label", "dim", "codes"])

    kept = rows.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    return materialize(kept.mapInArrow(trimmed(code), "row bigint, vec_id bigint, label bigint, dim int, codes binary"))


def _tiles(anchors: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Anchors and rows, dealt so that each block of anchors meets each block of rows of the same by, in groups (by, a, b)."""
    count = lambda df, size, name: df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(anchors, ANCHOR_BLOCK, "na").join(count(rows, ROW_BLOCK, "nb"), by)  # a row for each label and length
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = anchors.join(sizes, by).withColumn("a", block("na")).withColumn("b", every("nb")).withColumn("anchor", F.lit(True))
    two = rows.join(sizes, by).withColumn("b", block("nb")).withColumn("a", every("na")).withColumn("anchor", F.lit(False))
    return one.drop("na", "nb").unionByName(two.drop("na", "nb"), allowMissingColumns=True)


def _sides(t: pa.Table):
    """(anchors, rows) of a tile as (columns, matrix), rows in ascending order of their ids."""
    out = []
    for mine in (t.filter(t["anchor"]), t.filter(pa.compute.invert(t["anchor"])).sort_by("vec_id")):
        dim = mine["dim"][0].as_py() if len(mine) else 0
        out.append((mine, np.frombuffer(b"".join(mine["codes"].to_pylist()), "<i4").reshape(len(mine), dim).astype(np.int64)))
    return out


_FOUND = "anchor bigint, anchor_id bigint, key binary"


def _emitted(parts: list[tuple[int, int, list[bytes]]]) -> pa.Table:
    n = [len(keys) for _, _, keys in parts]
    column = lambda k: pa.array(np.repeat(np.array([p[k] for p in parts], np.int64), n))
    return pa.table({"anchor": column(0), "anchor_id": column(1), "key": pa.array([x for p in parts for x in p[2]], pa.binary())})


def _positive_tile(t: pa.Table) -> pa.Table:
    (a, x), (b, y) = _sides(t)
    row, vec_id, parts = b["row"].to_numpy(), b["vec_id"].to_numpy(), []
    for k, (who, name) in enumerate(zip(a["row"].to_pylist(), a["vec_id"].to_pylist(), strict=True)):
        if k % 64 == 0:
            scores = inner(x[k : k + 64], y)
        other = row != who
        at = first(scores[k % 64][other], POSITIVES)
        parts.append((who, name, pack(scores[k % 64][other][at], 0, vec_id[other][at])))
    return _emitted(parts)


def _negative_tile(t: pa.Table) -> pa.Table:
    (a, x), (b, y) = _sides(t)
    label, vec_id, parts = b["label"].to_numpy(), b["vec_id"].to_numpy(), []
    for k, (who, name, own, windows) in enumerate(zip(*(a[c].to_pylist() for c in ("row", "vec_id", "label", "scores")), strict=True)):
        if k % 64 == 0:
            scores = inner(x[k : k + 64], y)
        other = np.flatnonzero(label != own)
        score, found = scores[k % 64][other], set()
        for p in set(windows):
            low, high = -(-LOW * p // 100), HIGH * p // 100
            inside = np.flatnonzero((score >= low) & (score <= high))
            found.update(inside[first(score[inside], NEGATIVES)].tolist())
        at = np.array(sorted(found), np.int64)
        parts.append((who, name, pack(score[at], 1, vec_id[other[at]])))
    return _emitted(parts)


def _by_anchor(found: DataFrame, tasks: int) -> DataFrame:
    """The secondary sort: all keys of an anchor in one partition, in their order."""
    return found.repartition(tasks, "anchor").sortWithinPartitions("anchor", "key")


def _first_positives(batches):
    """The first keys of each anchor, as one row; a batch's rows are let go before the next comes."""
    anchor, held = None, []

    def row():
        return (anchor[0], anchor[1], [x for x, _ in held], [x for _, x in held])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (2, 3))], ["anchor", "anchor_id", "scores", "ids"])

    for batch in batches:
        out = []
        for a, name, score, vec_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *unpack(batch.column(2).to_pylist())[::2], strict=True):
            if anchor is None or a != anchor[0]:
                if anchor:
                    out.append(row())
                anchor, held = (a, name), []
            if len(held) < POSITIVES:
                held.append((score, vec_id))
        yield table(out)
    if anchor:
        yield table([row()])


_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _windows(batches):
    """Opens a window at each positive, and emits each negative into the open windows that it falls into."""
    anchor, windows = None, []
    for batch in batches:
        out = []
        for a, name, score, kind, vec_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *unpack(batch.column(2).to_pylist()), strict=True):
            if a != anchor:
                anchor, windows = a, []
            if kind == 0:
                windows.append([score, vec_id, 0])
                continue
            for w in windows:
                if w[2] < NEGATIVES and LOW * w[0] <= 100 * score <= HIGH * w[0]:
                    w[2] += 1
                    out.append((name, w[1], w[2], vec_id, w[0], score))
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], [f.split()[0] for f in _MINED.split(", ")])


def mine(vectors: DataFrame, label: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, embedding, label): for each
    anchor and each of its first POSITIVES rows of the same label, the first NEGATIVES of another label whose score lies
    between LOW and HIGH hundredths of the positive's. anchor says of vec_id which rows are anchors."""
    rows = prepared(vectors, F.col("label") if label is None else label)
    tasks = partitions(vectors.sparkSession)
    asked = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0 if anchor is None else anchor)
    near = _tiles(asked, rows, ["label", "dim"]).repartition(tasks, "label", "dim", "a", "b").groupBy("label", "dim", "a", "b").applyInArrow(trimmed_group(_positive_tile), _FOUND)
    positives = materialize(_by_anchor(near, tasks).mapInArrow(trimmed(_first_positives), "anchor bigint, anchor_id bigint, scores array<bigint>, ids array<bigint>"))
    opened = asked.join(positives.select(F.col("anchor").alias("row"), "scores"), "row")
    hard = _tiles(opened, rows, ["dim"]).repartition(tasks, "dim", "a", "b").groupBy("dim", "a", "b").applyInArrow(trimmed_group(_negative_tile), _FOUND)

    def again(batches):
        for batch in batches:
            parts = [(a, name, pack(np.array(s, np.int64), 0, np.array(i, np.int64))) for a, name, s, i in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield from _emitted(parts).to_batches()

    both = hard.unionByName(positives.mapInArrow(again, _FOUND))
    return _by_anchor(both, tasks).mapInArrow(trimmed(_windows), _MINED)


def relabelled() -> Column:
    """The query's labels: where vec_id is divisible by 7, the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
