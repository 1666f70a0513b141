"""Operator 9: token ids in binary files with keyed access by a minimal perfect hash.

A file holds FILE_SEGMENTS segments one after the other, each with a line break after it: Spark's text writer puts a
segment's bytes down as they are, and no reader looks for line breaks. A task writes its segments' heads beside them, in
the same pass; the index of all segments is made of these, so no file is read again. Tasks are as many as the bytes of the
documents' own files ask for. A segment, little-endian:
  8 bytes   TLTOKEN1
  7 x u64   documents n, ids m, bytes of the hash function, keys k, part and number of the segment, bytes of an id w
  n x i64   doc_id;  n x u8  1 where doc_id is null;  (n + 1) x u64  offset of each document's first id, in ids
  hash function;  k x u32 fingerprints;  k x u32 row of each hash slot
  m x u16 or u32 (w = 2 or 4)  the ids; w is 2 if every id of the segment allows it
Documents lie in ascending doc_id order, rows without doc_id first, over all files in the order of (part, number). A
repeated doc_id is stored as often as it comes; the hash finds the first. A key's slot is the rank of its bit in the first
level where it was alone; a fingerprint that does not match says that the segment has no such key.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import file_tasks, mix, seeded, trimmed

MAGIC = b"TLTOKEN1"
END = 0
#: Bytes of ids, four each, at which a task closes a segment.
SEGMENT_BYTES = 16 << 20
#: Segments in a file. One, so that a lookup reads no more than the segments that it asks.
FILE_SEGMENTS = 1
#: Rows of the index that are sent to all tasks at once, and files up to which a lookup names those that it reads.
INDEX_ROWS, NAMED_FILES = 500_000, 10_000
_HEAD = "part bigint, number bigint, low bigint, high bigint, n_ids bigint"
_INDEX = f"path string, {_HEAD}, place bigint"
_SEGMENTS, _HEADS = "kind=segment", "kind=head"
_SEED = seeded(64, 9)
U64 = np.uint64


class PerfectHash:
    """Levels of bits: a key is placed in the first level where no other key has its bit; its slot is that bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(np.concatenate([[0], np.cumsum(bits)]) + total)
            total += int(bits.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = -(-max(64, 2 * len(left)) // 8) * 8
            at = (mix(left + _SEED[len(levels)]) % U64(size)).astype(np.int64)
            n = np.bincount(at, minlength=size)
            levels.append(n == 1)
            left = left[n[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that are surely unknown."""
        out = np.full(len(keys), -1, np.int64)
        for k, bits in enumerate(self.levels):
            at = (mix(keys + _SEED[k]) % U64(len(bits))).astype(np.int64)
            found = (out < 0) & bits[at]
            out[found] = self.ranks[k][at[found]]
        return out

    def dump(self) -> bytes:
        return struct.pack(f"<{len(self.levels) + 1}Q", len(self.levels), *map(len, self.levels)) + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<Q", raw)
        at, levels = 8 + 8 * n, []
        for size in struct.unpack_from(f"<{n}Q", raw, 8):
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)).astype("<u4")


def segment(docs: list, ids: list[bytes], part: int, number: int) -> bytes:
    null = np.array([d is None for d in docs], np.uint8)
    doc = np.array([0 if d is None else d for d in docs], "<i8")
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    keys, row = np.unique(doc[null == 0].view(U64), return_index=True)
    row = np.flatnonzero(null == 0)[row]
    hashed = PerfectHash.of(keys)
    slot = hashed.slots(keys)
    prints, rows = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slot], rows[slot] = fingerprint(keys), row
    dumped = hashed.dump()
    payload = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(payload) or payload.max() < 1 << 16 else 4
    head = MAGIC + struct.pack("<7Q", len(docs), len(payload), len(dumped), len(keys), part, number, width)
    return b"".join([head, doc.tobytes(), null.tobytes(), offsets.tobytes(), dumped, prints.tobytes(), rows.tobytes(), payload.astype(f"<u{width}").tobytes()])


class Segment:
    """A view of a segment that starts at a place in a file's bytes; end is where the next one starts."""

    def __init__(self, raw, at: int = 0):
        if bytes(raw[at : at + 8]) != MAGIC:
            raise ValueError("no token segment")
        n, m, size, keys, self.part, self.number, width = struct.unpack_from("<7Q", raw, at + 8)
        at += 64
        take = lambda kind, count: np.frombuffer(raw, kind, count, at)
        self.doc_ids, at = take("<i8", n), at + 8 * n
        self.null, at = take(np.uint8, n).astype(bool), at + n
        self.offsets, at = take("<u8", n + 1).astype(np.int64), at + 8 * (n + 1)
        self.hash, at = PerfectHash.load(bytes(raw[at : at + size])), at + size
        self.prints, at = take("<u4", keys), at + 4 * keys
        self.rows, at = take("<u4", keys), at + 4 * keys
        self.ids = take(f"<u{width}", m)
        self.end = at + width * m + 1

    def ids_at(self, row: int) -> bytes:
        """A stored row's ids, as little-endian unsigned 32-bit numbers."""
        return self.ids[self.offsets[row] : self.offsets[row + 1]].astype("<u4").tobytes()

    def rows_of(self, doc_ids: np.ndarray) -> np.ndarray:
        """The stored row of each key, in constant time each; -1 where the segment has no such key."""
        keys = doc_ids.astype("<i8").view(U64)
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprint(keys[known])
        out = np.full(len(keys), -1, np.int64)
        out[known] = self.rows[slot[known]]
        return out


def segments(raw):
    at = 0
    while at < len(raw):
        yield (found := Segment(raw, at))
        at = found.end


def _files(spark: SparkSession, folder: str, paths: list[str] | None = None) -> DataFrame:
    """(path, content) of the segments' files, or of those named."""
    if not list_some(spark, f"{folder}/{_SEGMENTS}"):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(paths or f"{folder}/{_SEGMENTS}").select("path", "content")


def list_some(spark: SparkSession, folder: str) -> str | None:
    """The name of a file in the folder, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatusIterator(path) if fs.exists(path) else None
    while found is not None and found.hasNext():
        if (name := found.next().getPath().getName()).startswith("part-"):
            return name
    return None


def write(docs: DataFrame, folder: str, vocabulary: str, spaced: bool = True, end: int = END) -> None:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order, files for each range of doc_id, and their index."""
    spark = docs.sparkSession

    def run(batches):
        part, heads = TaskContext.get().partitionId(), []
        keys, ids, size = [], [], 0

        def close():
            known = [k for k in keys if k is not None]
            heads.append({"part": part, "number": len(heads), "low": known[0] if known else None, "high": known[-1] if known else None, "n_ids": size // 4})
            return table("segment", segment(keys, ids, part, len(heads) - 1))

        def table(kind, raw):
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([kind])], ["raw", "kind"])

        for key, got in tokens.encoded(batches, vocabulary, spaced, end):
            keys.append(key), ids.append(got)
            size += len(got)
            if size >= SEGMENT_BYTES:
                yield close()
                keys, ids, size = [], [], 0
        if keys:
            yield close()
        if heads:
            yield table("head", "\n".join(map(json.dumps, heads)).encode())

    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(file_tasks(docs), "doc_id").sortWithinPartitions("doc_id")
    conf = "spark.sql.maxConcurrentOutputFileWriters"  # a task writes to both folders as it goes, unsorted
    was = spark.conf.get(conf)
    spark.conf.set(conf, "2")
    try:
        made = ordered.mapInArrow(trimmed(run), "raw binary, kind string").select(F.col("raw").cast("string").alias("raw"), "kind")
        made.write.partitionBy("kind").option("maxRecordsPerFile", FILE_SEGMENTS).text(folder)
    finally:
        spark.conf.set(conf, was)
    _write_index(spark, folder)


def _write_index(spark: SparkSession, folder: str) -> None:
    """Heads with their files, whose names tell part and place in it, and with the place of each segment among all."""
    name = list_some(spark, f"{folder}/{_SEGMENTS}")
    if name is None:
        spark.createDataFrame([], _INDEX).write.parquet(f"{folder}/_index")
        return
    job, ending = re.fullmatch(r"part-\d+-(.+[-.])c\d+(.*)", name).groups()
    heads = spark.read.text(f"{folder}/{_HEADS}").select(F.from_json("value", _HEAD).alias("x")).select("x.*")
    base = str(spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_SEGMENTS}")).toString())
    path = F.format_string(f"%s/part-%05d-{job}c%03d{ending}", F.lit(base), "part", F.floor(F.col("number") / FILE_SEGMENTS))
    parts = heads.groupBy("part").agg(F.count("*").alias("n"))  # a row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = heads.join(parts.select("part", before.alias("before")), "part").withColumn("place", F.col("before") + F.col("number"))
    placed.select(path.alias("path"), *(f.split()[0] for f in _HEAD.split(", ")), "place").sortWithinPartitions("place").write.parquet(f"{folder}/_index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, part, number, low, high, n_ids, place) of every segment; place is its number among all, in order of the keys."""
    return spark.read.schema(_INDEX).parquet(f"{folder}/_index")


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """A row for each stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for,
    ids. Every doc_id is looked up through the hash of its segment; a row that the hash does not lead to is a repeated doc_id."""

    def rows(batches):
        for batch in batches:
            for raw in batch.column(0):
                for s in segments(memoryview(raw.as_buffer())):
                    row = np.where(s.null, np.arange(len(s.doc_ids)), s.rows_of(s.doc_ids))
                    if (s.doc_ids[row] != s.doc_ids).any() or (row < 0).any():
                        raise ValueError("the index of a token file is damaged")
                    row = np.where(np.concatenate([[False], s.doc_ids[1:] == s.doc_ids[:-1]]), np.arange(len(row)), row)
                    a, b = s.offsets[row], s.offsets[row + 1]
                    one = lambda x: pa.array(np.full(len(row), x, np.int64))
                    crc, got = [], []
                    for r in row:
                        held = s.ids_at(r)
                        crc.append(zlib.crc32(held)), got.append(held if ids else None)
                    yield pa.RecordBatch.from_arrays(
                        [one(s.part), one(s.number), pa.array(s.doc_ids, mask=s.null), pa.array(a), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(got, pa.binary())],
                        ["part", "number", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"],
                    )

    # where a segment starts: after the parts before its own (a row for each part), and after its own part's segments before it
    heads = index(spark, folder)
    back = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", back(Window.orderBy("part")).alias("before"))
    base = heads.withColumn("inner", back(Window.partitionBy("part").orderBy("number"))).join(parts, "part").select("part", "number", (F.col("before") + F.col("inner")).alias("base"))
    found = _files(spark, folder).select("content").mapInArrow(trimmed(rows), "part bigint, number bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return found.join(base, ["part", "number"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the keys(doc_id) that the files hold. The index tells each key's segment; only files of such segments
    are read, unless they are more than NAMED_FILES, and each segment finds its keys by its hash. Null keys find nothing,
    repeated keys count once. A repeated doc_id, wherever its rows lie, finds the first of them."""
    asked, n = [], index(spark, folder).agg(F.max("place")).first()[0]
    wanted = keys.select("doc_id").where("doc_id is not null").distinct()
    for k in range(0, (n + 1) if n is not None else 0, INDEX_ROWS):
        some = index(spark, folder).where(F.col("place").between(k, k + INDEX_ROWS - 1) & F.col("low").isNotNull()).toArrow().sort_by("place")
        if not len(some):
            continue
        sent = spark.sparkContext.broadcast((some["low"].to_numpy(), some["high"].to_numpy(), some["path"].to_pylist(), some["part"].to_numpy(), some["number"].to_numpy()))

        def find(batches, sent=sent):
            low, high, path, part, number = sent.value
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                at = np.searchsorted(high, key)  # the first segment that may hold it
                hit = np.flatnonzero((at < len(high)) & (low[np.minimum(at, len(low) - 1)] <= key))
                yield pa.RecordBatch.from_arrays([pa.array([path[x] for x in at[hit]], pa.string()), pa.array(part[at[hit]]), pa.array(number[at[hit]]), pa.array(key[hit])], ["path", "part", "number", "doc_id"])

        asked.append(wanted.mapInArrow(find, "path string, part bigint, number bigint, doc_id bigint"))
    if not asked:
        return wanted.where("false").select("doc_id", F.lit(None).cast("binary").alias("ids"))
    places = functools.reduce(DataFrame.unionByName, asked).groupBy("doc_id").agg(F.min_by(F.struct("path", "part", "number"), F.struct("part", "number")).alias("x"))  # where a key's rows go over two slices
    asked = places.select("doc_id", "x.*").groupBy("path").agg(F.collect_list(F.struct("part", "number", "doc_id")).alias("asked"))
    named = [r.path for r in asked.select("path").limit(NAMED_FILES + 1).collect()]
    files = _files(spark, folder, named if 0 < len(named) <= NAMED_FILES else None)

    def answer(batches):
        for batch in batches:
            for raw, pairs in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                by: dict[tuple, list] = {}
                for x in pairs:
                    by.setdefault((x["part"], x["number"]), []).append(x["doc_id"])
                for s in segments(memoryview(raw.as_buffer())):
                    ask = np.unique(np.array(by.get((s.part, s.number), []), np.int64))
                    row = s.rows_of(ask)
                    real = row >= 0
                    real[real] = s.doc_ids[row[real]] == ask[real]
                    yield pa.RecordBatch.from_arrays([pa.array(ask[real]), pa.array([s.ids_at(r) for r in row[real]], pa.binary())], ["doc_id", "ids"])

    return files.join(asked, "path").select("content", "asked").mapInArrow(answer, "doc_id bigint, ids binary")
