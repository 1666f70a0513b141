"""What the operators share: tables in the shared work folder, whole-text hashing in numpy, connected components."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import forget, materialize, work_dir  # noqa: F401  for the operators

U64 = np.uint64
#: Bytes of text that are hashed at once; the hashes take eight times as much.
CHUNK_BYTES = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_tasks(docs: DataFrame, each: int = 32 << 20) -> int:
    """Tasks that docs(text) should be dealt over: the session's shuffle partitions, more if these got over each bytes of text."""
    return max(partitions(docs.sparkSession), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // each)


def file_tasks(docs: DataFrame, each: int = 16 << 20) -> int:
    """Tasks that docs(text) should be dealt over: the session's shuffle partitions, more if these got over each bytes of the
    files that docs is read from, as Spark knows them; text is counted only where docs is not read from files."""
    leaves, size = docs._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        size += int(str(leaves.apply(k).stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), size // each) if size < 1 << 60 else text_tasks(docs, 2 * each)


def labels(spark: SparkSession, tasks: int) -> np.ndarray:
    """A number for each of so many buckets, such that Spark's repartition(tasks, number) gives every task one bucket."""
    n = tasks * (12 + tasks.bit_length())
    at = spark.range(n).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("at")).toArrow()["at"].to_numpy()
    task, first = np.unique(at, return_index=True)
    out = np.arange(n, n + tasks, dtype=np.int32)  # a task that no number leads to, which is unlikely, is left out
    out[task] = first
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, name with as many _ before it as that takes."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Gives the memory that this worker used back to the machine, which it shares with its executor."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def trimmed(f):
    """For a function over a task's batches: gives memory back when it ends."""

    @functools.wraps(f)
    def run(*args):
        yield from f(*args)
        give_back()

    return run


def trimmed_group(f):
    """The same for a function of one group, a table."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return run


# --- text as bytes ---------------------------------------------------------------------------------------------------


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return pc.fill_null(batch.column(name), "").to_pylist()


def byte_chunks(batch: pa.RecordBatch, name: str = "text"):
    """(first row, offsets, bytes) for runs of whole rows of about CHUNK_BYTES; null counts as empty."""
    col = pc.fill_null(batch.column(name), "").cast(pa.large_binary())
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(col))
        yield at, offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_BYTE = seeded(256, 1)
_STEP = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        n = max(n + 1, CHUNK_BYTES)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, x, U64))]) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; window_hash() gives the hash of any piece from them."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _power(len(data))[0][: len(data)], out=out[1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end), wherever they lie."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start])


# --- word shingles ---------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_letters: list[np.ndarray] = []


def _letter(n: int) -> np.ndarray:
    """What a byte of a word is multiplied by, by its place in the word: independent numbers. In a polynomial's powers long
    words can be made that differ and have one hash."""
    if not _letters or len(_letters[0]) < n:
        _letters[:] = [seeded(max(n, 1 << 12), 3)]
    return _letters[0]


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in order."""
    low = _LOWER[data]
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = ~_SPACE[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True  # a document's end ends its last word
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    size = ends - starts
    at, within = np.flatnonzero(word), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    sums = np.zeros(len(at) + 1, U64)
    np.cumsum(_BYTE[low[at]] * _letter(int(size.max(initial=0)))[within], out=sums[1:])
    edge = np.append(0, np.cumsum(size))
    return np.searchsorted(offsets, starts, "right") - 1, mix(sums[edge[1:]] - sums[edge[:-1]] + size.astype(U64))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each document's distinct hashed word shingles, sorted; fewer words than width: the whole sequence as one; none: empty."""
    doc, word = word_hashes(offsets, data)
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(counts)])
    place = seeded(width + 1, 2)
    n = max(0, len(word) - width + 1)
    grams = np.zeros(n, U64)
    for k in range(width):
        grams += word[k : k + n] * place[k]
    grams = mix(grams)
    out = []
    for i in range(n_docs):
        if counts[i] >= width:
            g = np.sort(grams[at[i] : at[i + 1] - width + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif counts[i]:
            whole = (word[at[i] : at[i + 1]] * place[: counts[i]]).sum(dtype=U64, keepdims=True)
            out.append(mix(whole + place[width:] * counts[i : i + 1].astype(U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


# --- connected components --------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a, b): component is the smallest node reachable. Alternates large-star and
    small-star steps, each an aggregate and a join, so no node's neighbours are gathered in one place; every round is a
    table in the shared folder."""
    spark = edges.sparkSession
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        after = materialize(small.where("a != b").distinct())
        was, mark = mark, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if mark == was or not mark[0]:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
