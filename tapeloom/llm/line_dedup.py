"""Operator 4: removal of lines that many documents hold. Sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; lines are split at \\n alone. Keys of at
least MIN_CHARS code points held by at least MIN_DOCS documents lose all their lines except in the largest doc_id that
holds them. Keys are compared by 128-bit hashes. Null or empty text: one empty line. Rows that repeat a doc_id count as
one document for a key and are treated alike; rows without doc_id neither count nor lose lines.

The exact table, references, has a row (k1, k2, doc_id) for each key and document; counts come from it. The filters, one
for each shard of the keys, hold the keys at or over MIN_DOCS, so that most lines are let through without a look at the
counts. insert() adds documents, delete() takes documents out again and, as a cuckoo filter can drop a key, undoes what
insert() did. A filter that is full is built anew, larger, from the exact table. The query, the pipeline's stage and the
index are one path: dedup_lines() builds an index and drops the lines by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, texts, trimmed, unused

MIN_CHARS, MIN_DOCS = 40, 5
_ENDS = " \t\n\x0b\x0c\r"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Keys in a shard's filter, about; the number of shards follows the number of keys.
SHARD_KEYS = 16384
#: Changes of an index after which its exact table is written as a whole again.
COMPACT = 8
SLOTS = 4
U64 = np.uint64


def key_hash(line: str) -> tuple[int, int] | None:
    """The line's key as two signed 64-bit numbers, or None if it is too short."""
    if len(line) < MIN_CHARS:
        return None
    key = line.strip(_ENDS).translate(_FOLD)
    if len(key) < MIN_CHARS:
        return None
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- the filter ------------------------------------------------------------------------------------------------------


class Cuckoo:
    """16-bit fingerprints in buckets of four; each key has two buckets, the second found from the first and the fingerprint."""

    def __init__(self, keys: int = 0, table: bytes | None = None):
        if table is None:
            size = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
            self.table = np.zeros((size, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()

    def _where(self, k2: np.ndarray):
        h = mix(k2.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15))
        print_ = ((h >> U64(48)).astype(np.uint16)) | np.uint16(1)
        size = U64(len(self.table) - 1)
        one = h & size
        return print_, one, one ^ (mix(print_.astype(U64)) & size)

    def holds(self, k2: np.ndarray) -> np.ndarray:
        f, a, b = self._where(k2)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def add(self, k2: np.ndarray) -> bool:
        """False if a key found no place: the filter must be built anew, larger."""
        size = U64(len(self.table) - 1)
        for f, a, b in zip(*self._where(k2), strict=True):
            for turn in range(500):
                if (free := np.flatnonzero(self.table[a] == 0)).size:
                    self.table[a, free[0]] = f
                    break
                if turn == 0 and (free := np.flatnonzero(self.table[b] == 0)).size:
                    self.table[b, free[0]] = f
                    break
                slot = (turn * 7 + int(f)) % SLOTS
                f, self.table[a, slot] = self.table[a, slot], f
                a = a ^ (mix(np.array([f], U64))[0] & size)
            else:
                return False
        return True

    def remove(self, k2: np.ndarray) -> None:
        """Only for keys that were added."""
        for f, a, b in zip(*self._where(k2), strict=True):
            for at in (a, b):
                if (here := np.flatnonzero(self.table[at] == f)).size:
                    self.table[at, here[0]] = 0
                    break

    @classmethod
    def of(cls, k2: np.ndarray) -> Cuckoo:
        room = len(k2)
        while not (out := cls(room)).add(k2):
            room = room * 2 + 8
        return out


# --- lines and their keys --------------------------------------------------------------------------------------------


def references(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id): each document's distinct long keys."""

    def run(batches):
        for batch in batches:
            ids, k1, k2 = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if doc is not None and len(text) >= MIN_CHARS:
                    for a, b in {h for line in text.split("\n") if (h := key_hash(line))}:
                        ids.append(doc), k1.append(a), k2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "k1 bigint, k2 bigint, doc_id bigint")


def counted(refs: DataFrame, unique: bool = False) -> DataFrame:
    """(k1, k2, n_docs, max_doc); unique says that no doc_id repeats, else repeats are taken out first."""
    return (refs if unique else refs.distinct()).groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, table): a cuckoo filter of the shard's keys."""

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"shard": t["shard"].slice(0, 1), "table": pa.array([Cuckoo.of(np.sort(t["k2"].to_numpy())).table.tobytes()], pa.binary())})

    return repeated.select(_shard(shards).alias("shard"), "k2").groupBy("shard").applyInArrow(build, "shard int, table binary")


def repeated_lines(refs: DataFrame, repeated: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of refs for keys in repeated, with n_docs and max_doc: first by the filters, then by the exact table. A
    task's keys of a shard travel as one row to their filter."""

    def keys(batches):
        held, size = [], 0

        def out():
            docs, k = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = k[:, 0] % shards
            order = np.argsort(shard, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
            binary = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([shard[x[0]] for x in parts], pa.int32()), binary(docs[x] for x in parts), binary(k[x] for x in parts)], ["shard", "docs", "keys"])

        for batch in batches:
            if batch.num_rows:
                k1, k2, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                held.append((docs, np.stack([k1, k2], 1)))
                size += batch.num_rows
            if size > 200_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def probe(batches):
        for batch in batches:
            ids, found = [], []
            for d, k, t in zip(*(batch.column(c).to_pylist() for c in ("docs", "keys", "table")), strict=True):
                k = np.frombuffer(k, np.int64).reshape(-1, 2)
                hit = Cuckoo(table=t).holds(k[:, 1])
                ids.append(np.frombuffer(d, np.int64)[hit]), found.append(k[hit])
            ids, found = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], ["doc_id", "k1", "k2"])

    asked = refs.select("k1", "k2", "doc_id").mapInArrow(trimmed(keys), "shard int, docs binary, keys binary")
    maybe = asked.join(filters, "shard").select("docs", "keys", "table").mapInArrow(probe, "doc_id bigint, k1 bigint, k2 bigint")
    return maybe.join(repeated, ["k1", "k2"])


# --- the index -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """refs(k1, k2, doc_id), the exact table; held(k1, k2, n_docs, max_doc), its keys that at least MIN_DOCS documents hold;
    filters(shard, table) of the keys in held. A filter that has no room for a key is built anew from held.

    A change writes the rows that come or go, and the keys in held; refs is what was there with them added or left out, and
    is written as one table again after COMPACT changes. Only keys of the changed documents are counted again."""

    refs: DataFrame
    held: DataFrame
    filters: DataFrame
    shards: int
    changes: int = 0

    def repeated(self) -> DataFrame:
        return self.held

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents added. Documents that it holds already change nothing."""
        new = materialize(references(docs).distinct().join(self.refs, ["k1", "k2", "doc_id"], "left_anti"))
        return self._changed(self.refs.unionByName(new), new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents doc_ids(doc_id): as if they had never been inserted."""
        ids = materialize(doc_ids.select("doc_id").distinct())
        less = lambda how: self.refs.join(ids, "doc_id", how).select("k1", "k2", "doc_id")
        return self._changed(less("left_anti"), materialize(less("left_semi")))

    def drop_lines(self, docs: DataFrame) -> DataFrame:
        """docs, which the index holds, without the lines that go; n_lines and n_dropped as of the function drop_lines."""
        drops = repeated_lines(self.refs, self.held, self.filters, self.shards).where("doc_id < max_doc").select("doc_id", "k1", "k2")
        return drop_lines(docs, drops)

    def _changed(self, refs: DataFrame, moved: DataFrame) -> LineIndex:
        changes = (self.changes + 1) % COMPACT
        refs = refs if changes else materialize(refs)
        touched = moved.select("k1", "k2").distinct()
        held = materialize(self.held.join(touched, ["k1", "k2"], "left_anti").unionByName(_repeated(refs.join(touched, ["k1", "k2"], "left_semi"))))
        shards = shards_for(held.count())
        if shards > 2 * self.shards:  # outgrown
            return LineIndex(refs, held, materialize(build_filters(held, shards)), shards, changes)
        keys = lambda df, other, add: df.join(other, ["k1", "k2"], "left_anti").select(_shard(self.shards).alias("shard"), "k2", F.lit(add).alias("add"))
        moved = keys(held, self.held, True).unionByName(keys(self.held, held, False))

        def apply(key, old: pa.Table, moves: pa.Table) -> pa.Table:
            add = moves["add"].to_numpy().astype(bool)
            k2 = moves["k2"].to_numpy()
            have = Cuckoo(table=old["table"][0].as_py()) if len(old) else Cuckoo(len(k2))
            have.remove(k2[~add])
            full = not have.add(np.sort(k2[add]))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "table": pa.array([None if full else have.table.tobytes()], pa.binary())})

        filters = materialize(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(apply, "shard int, table binary"))
        full = filters.where("table is null").select("shard")
        if full.count():
            again = held.join(full, _shard(self.shards) == full.shard, "left_semi")
            filters = materialize(filters.where("table is not null").unionByName(build_filters(again, self.shards)))
        return LineIndex(refs, held, filters, self.shards, changes)


def _repeated(refs: DataFrame) -> DataFrame:
    return counted(refs, unique=True).where(F.col("n_docs") >= MIN_DOCS)


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def build_index(docs: DataFrame, shards: int | None = None) -> LineIndex:
    """An index of docs; the number of shards follows the number of repeated keys if it isn't given."""
    refs = materialize(references(docs).distinct())
    held = materialize(_repeated(refs))
    shards = shards or shards_for(held.count())
    return LineIndex(refs, held, materialize(build_filters(held, shards)), shards)


# --- texts without the lines -----------------------------------------------------------------------------------------


def drop_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs with its text less the lines of drops(doc_id, k1, k2), and n_lines, n_dropped: columns of those names are
    replaced. Other lines stay, joined by \\n; the rows stay all."""
    docs = docs.drop("n_lines", "n_dropped")
    names = [*docs.columns, "n_lines", "n_dropped"]
    doc, held = unused(docs, "_doc"), unused(docs, "_keys")
    lists = drops.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("k1", "k2")).alias(held))
    joined = docs.join(lists, docs["doc_id"] == lists[doc], "left").drop(doc)

    def run(batches):
        for batch in batches:
            keys = batch.column(held).to_pylist()
            kept, lines, gone = [], [], []
            for text, raw, ks in zip(texts(batch), pc.is_null(batch.column("text")).to_pylist(), keys, strict=True):
                parts = text.split("\n")
                lines.append(len(parts))
                if ks:
                    out = {(k["k1"], k["k2"]) for k in ks}
                    parts = [x for x in parts if key_hash(x) not in out]
                gone.append(lines[-1] - len(parts))
                kept.append(None if raw else "\n".join(parts) if ks else text)
            at = batch.schema.get_field_index("text")
            arrays = [pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] != held]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(trimmed(run), f"{fields}, n_lines bigint, n_dropped bigint")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The whole job over docs: an index of them, then the texts without the lines that go."""
    return build_index(docs).drop_lines(docs)


ORACLE = f"""
WITH lines AS (SELECT doc_id, i, l, lower_az(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS k FROM (
  SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
gone AS (SELECT k, max(doc_id) AS m FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (g.k IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (g.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.k = g.k AND l.doc_id < g.m GROUP BY l.doc_id""".replace("lower_az(", "translate(").replace("chr(13))) AS k", "chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k")


def sha256_text(column):
    """Lowercase hex of the text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)
