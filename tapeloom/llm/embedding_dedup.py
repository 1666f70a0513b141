"""Operator 10: near duplicates among embeddings of equal label, by int8 quantised tile products.

Vectors whose components are equal are one class, quantised once: unit vectors to int8 codes with a scale. With q the
quantised vector and e = |x - q| the exact size of its error, x.y differs from q.r by at most e|r| + |q|f + ef. The classes
of a label are dealt over blocks of about BLOCK vectors; each pair of blocks is a tile, a task's work, to which the codes
alone travel. Their products are exact in single precision, and vectors without a pair whose product plus that bound
reaches the threshold are done. The others' tiles get their full vectors too and compute those pairs again in double
precision. A tile returns the links of each vector as a sum and a spanning forest of its links, never pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing and
are kept. Vectors of different lengths do not link. Rows that repeat a vec_id are separate vectors with one id. Vectors are
scaled by a power of two first, so that neither huge nor tiny components leave the range of double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, trimmed

COSINE = 0.98
BLOCK = 1024
#: Room for rounding in the double-precision sums that the bound is made of.
SLACK = 1e-9


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1; that changes no bit of their cosines."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None]) if v.size else v


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors in rows, made unit vectors: int8 codes, scales, error sizes, quantised sizes."""
    v = scaled(v)
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt(((unit - back) ** 2).sum(1)), np.sqrt((back**2).sum(1))


def maybe_pairs(x: tuple, y: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the quantised x and y whose cosine may be at least that."""
    (cx, sx, ex, nx), (cy, sy, ey, ny) = x, y
    # 127 * 127 * 1000 < 2**24: up to a thousand components the single-precision products of codes are whole and exact
    kind = np.float32 if cx.shape[1] <= 1000 else np.float64
    dot = (cx.astype(kind) @ cy.astype(kind).T).astype(np.float64)
    most = dot * sx[:, None] * sy[None, :] + ex[:, None] * ny[None, :] + nx[:, None] * ey[None, :] + ex[:, None] * ey[None, :]
    return np.nonzero(most >= least - SLACK)


def close_pairs(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of x and y whose cosine is at least that; also how many pairs were computed in double precision."""
    i, j = maybe_pairs(quantise(x), quantise(y), least)
    x, y = scaled(x), scaled(y)
    size = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
    sure = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[a], y[b]) / (size(x[a]) * size(y[b])) >= least for a, b in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(j) // 65536 + 1), strict=True))])
    return i[sure], j[sure], len(i)


def matrices(column: pa.Array):
    """(rows, matrix) of the vectors of each length in a column of lists of doubles."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values, at = pc.list_flatten(column).to_numpy(zero_copy_only=False), np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, values[at[rows][:, None] + np.arange(n)]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links i-j among n nodes."""
    top = list(range(n))

    def root(k):
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def near_duplicates(vectors: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(sound, F.xxhash64("label", "v")))
    classes = materialize(rows.where("key is not null").groupBy("label", "key", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    kind = classes.schema["label"].dataType.simpleString()

    def code(batches):
        for batch in batches:
            v, n = batch.column("v"), batch.num_rows
            codes, figures = [b""] * n, np.zeros((n, 3))
            for mine, x in matrices(v):
                c, *rest = quantise(x)
                figures[mine] = np.stack(rest, 1)
                for k, row in zip(mine.tolist(), c, strict=True):
                    codes[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), pa.array(codes, pa.binary()), *map(pa.array, figures.T)], ["label", "rep", "codes", "scale", "error", "size"])

    coded = classes.select("label", "rep", "v").mapInArrow(trimmed(code), f"label {kind}, rep bigint, codes binary, scale double, error double, size double")
    sizes = classes.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = coded.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("label", "rep", "codes", "scale", "error", "size", "block", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")

    def parts(low, high, at, length):
        """(mine, its) of each length of vectors: the two sides of a tile."""
        for size in np.unique(length):
            mine = np.flatnonzero((at == low) & (length == size))
            its = mine if low == high else np.flatnonzero((at != low) & (length == size))
            if len(mine) and len(its):
                yield mine, its

    def maybe(t: pa.Table) -> pa.Table:
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        codes = t["codes"].to_pylist()
        figures = [t[c].to_numpy() for c in ("scale", "error", "size")]
        hit = np.zeros(len(codes), bool)
        for mine, its in parts(low, high, t["block"].to_numpy(), np.array([len(c) for c in codes])):
            side = lambda m: (np.frombuffer(b"".join(codes[k] for k in m.tolist()), np.int8).reshape(len(m), -1), *(f[m] for f in figures))
            i, j = maybe_pairs(side(mine), side(its), least)
            i, j = mine[i], its[j]
            hit[i[i != j]] = hit[j[i != j]] = True
        return t.filter(pa.array(hit)).select(["label", "rep", "block", "low", "high"])

    def tile(t: pa.Table) -> pa.Table:
        rep, n = (t[c].to_numpy() for c in ("rep", "n"))
        low, high, v = t["low"][0].as_py(), t["high"][0].as_py(), t["v"].combine_chunks()
        rows = {len(x[0]): (mine, x) for mine, x in matrices(v)}
        place = np.zeros(len(rep), np.int64)
        for mine, _ in rows.values():
            place[mine] = np.arange(len(mine))
        links, edges = np.zeros(len(rep), np.int64), []
        for mine, its in parts(low, high, t["block"].to_numpy(), pc.list_value_length(v).to_numpy(zero_copy_only=False)):
            x = rows[len(v[int(mine[0])])][1]
            i, j, _ = close_pairs(x[place[mine]], x[place[its]], least)
            i, j = mine[i], its[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            edges += [(rep[a], rep[b], None) for a, b in forest(len(rep), i, j)]
        out = [(r, None, k) for r, k in zip(rep.tolist(), links.tolist(), strict=True) if k] + edges
        return pa.table({c: pa.array([row[k] for row in out], pa.int64()) for k, c in enumerate(("a", "b", "links"))})

    near = tiles.groupBy("label", "low", "high").applyInArrow(maybe, f"label {kind}, rep bigint, block int, low int, high int")
    full = near.distinct().join(classes.select("label", "rep", "n", "v"), ["label", "rep"])
    found = materialize(full.groupBy("label", "low", "high").applyInArrow(tile, "a bigint, b bigint, links bigint"))
    groups = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    per = classes.join(links, classes.rep == links.a, "left").join(groups, classes.rep == groups.node, "left")
    per = per.select("key", "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(per, ["key", "label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
