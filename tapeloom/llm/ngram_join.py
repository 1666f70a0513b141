"""Operator 2: near-duplicate documents by a similarity join on word shingles, filtered by prefixes under several orders.

Documents with equal shingle sets are one entity. Two entities link when 100 * intersection >= PERCENT * union. In any
order of all shingles, two linked sets of sizes n share a shingle within their first n - ceil(PERCENT / 100 * n) + 1. The
orders used put rare shingles first: by the power of two of the number of entities that hold a shingle, and within it by
one of ORDERS different hashes. Shingles that one entity alone holds, the first of all, can't be shared.

1. Copies: an entity's shingles are cut once, from the row of its smallest doc_id. Entities with copies are broadcast with that
   id while they are few; beyond BROADCAST of them the documents are joined with the ids instead. Rows that repeat both
   text and doc_id, or have none, count once for each PART_BYTES of a task.
2. Shared shingles: each task cuts its documents' hashed shingles into buckets by hash, and a bucket's task tells which of
   them several entities hold, and how many. A shingle held often within one task is known to be shared at once, ranks
   last, and one copy of it stands for all in its bucket, so a bucket does not grow with a shingle's frequency.
3. An entity whose prefix holds unshared shingles alone links with nothing and is done. The others keep their shared ones.
4. Entities that share prefix shingles under the first order, directly or over others, are a family. Larger families are cut
   by size, in classes of a factor 100 / PERCENT, into blocks of about BLOCK entities; only blocks of one class or of
   neighbouring ones meet, as sets of other sizes can't link. A tile of two blocks intersects the candidates of all orders, verifies what is
   left with exact counts and returns a spanning forest of the links.

Null texts, and texts without words, have no shingles and link with nothing; fewer than five words are one shingle.
Repeated rows are copies. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_chunks, connected_components, labels, materialize, mix, partitions, seeded, shingle_sets, trimmed, trimmed_group
from .embedding_dedup import forest

WIDTH, PERCENT, ORDERS = 5, 80, 3
BLOCK = 512
#: Blocks of a class of sizes in one family at most; they are numbered class by class.
CLASS = 1 << 24
#: Entities with copies that are broadcast at most, at 16 bytes each.
BROADCAST = 1 << 22
#: Entities among a task's next PART_BYTES of text that hold a shingle, from which one copy of it stands for all; the rank
#: of such shingles.
OFTEN, LAST = 32, 255
PART_BYTES = 4 << 20
#: Shingles of a bucket, which is a task's, at most about.
TASK_SHINGLES = 4 << 20
_ORDER = seeded(ORDERS, 11)


def prefix_length(n):
    return n + (PERCENT * n // -100) + 1


def _sets(batch: pa.RecordBatch):
    for _, offsets, data in byte_chunks(batch):
        yield from shingle_sets(offsets, data, WIDTH)


def _parts(batches, copied: np.ndarray = np.zeros(0, np.int64), first: np.ndarray = np.zeros(0, np.int64)):
    """{entity: shingles} of about PART_BYTES of text at a time; of the entities copied, rows whose doc_id is not the first's are
    left out."""
    sets, size = {}, 0
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for row, offsets, data in byte_chunks(batch):
            for k, s in enumerate(shingle_sets(offsets, data, WIDTH)):
                if not len(s):
                    continue
                name = _name(s)
                at = int(np.searchsorted(copied, name))
                if at < len(copied) and copied[at] == name and ids[row + k] is not None and ids[row + k] != first[at]:
                    continue
                sets[name] = s
            size += len(data)
            if size >= PART_BYTES and sets:
                yield sets
                sets, size = {}, 0
    if sets:
        yield sets


def _name(tokens: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, entity) per row; entity is null without shingles."""

    def run(batches):
        for batch in batches:
            sets = list(_sets(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "entity"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, n_shingles bigint, entity bigint")


_PARTS = ["bucket", "settled", "entities", "sizes", "counts", "tokens", "shared"]


def pieces(docs: DataFrame, tasks: int, copied=None) -> DataFrame:
    """Each task's documents' shingles, cut into buckets: a row has what PART_BYTES of text hold of one, packed. copied may be a
    broadcast (entities, doc_ids), sorted by entity: of those entities only the rows with their doc_id are cut."""
    buckets, number = tasks, labels(docs.sparkSession, tasks)

    def cut(batches):
        for sets in _parts(batches, *(copied.value if copied else ())):
            names, arrays = np.array(list(sets), np.int64), list(sets.values())
            sizes = np.array([len(s) for s in arrays], np.int32)
            tokens, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays), dtype=np.int32), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            runs = np.diff(np.append(np.flatnonzero(first), len(tokens)))
            often = np.repeat(runs >= OFTEN, runs)
            parts = []
            if often.any():
                parts.append((int(names[0]) % buckets, True, tokens[often], owner[often], b""))
            stand = tokens[first][runs >= OFTEN]
            tokens, owner = tokens[~often], owner[~often]
            # in ascending order of the hash, so a bucket is a range of it
            edge = [U64(k * ((1 << 64) // buckets)) for k in range(buckets)]
            at, to = np.append(np.searchsorted(tokens, edge), len(tokens)), np.append(np.searchsorted(stand, edge), len(stand))
            for k in range(buckets):
                if at[k] < at[k + 1] or to[k] < to[k + 1]:
                    parts.append((k, False, tokens[at[k] : at[k + 1]], owner[at[k] : at[k + 1]], stand[to[k] : to[k + 1]].tobytes()))
            rows = []
            for k, settled, t, o, s in parts:
                by = np.argsort(o, kind="stable")
                who, count = np.unique(o, return_counts=True)
                rows.append((number[k], settled, names[who].tobytes(), sizes[who].tobytes(), count.astype(np.int32).tobytes(), t[by].tobytes(), s))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(2, 7))], _PARTS)

    return docs.select("doc_id", "text").mapInArrow(trimmed(cut), "bucket int, settled boolean, entities binary, sizes binary, counts binary, tokens binary, shared binary")


def shared_shingles(cut: DataFrame, tasks: int) -> DataFrame:
    """(target, entities, sizes, counts, tokens, ranks) of pieces(): shingles that other entities hold too, and their ranks by
    frequency. A row has what a bucket found for the entities of one target, packed."""
    buckets, number = tasks, labels(cut.sparkSession, tasks)

    def tell(t: pa.Table) -> pa.Table:
        joined = {c: np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in zip(_PARTS[2:], (np.int64, np.int32, np.int32, U64, U64), strict=True)}
        count, tokens = joined["counts"], joined["tokens"]
        owner = np.repeat(np.arange(len(count)), count)
        rank = np.full(len(tokens), LAST, np.uint8)
        if not t["settled"][0].as_py() and len(tokens):
            order = np.lexsort((joined["entities"][owner], tokens))
            token, who = tokens[order], joined["entities"][owner[order]]
            fresh = np.concatenate([[True], token[1:] != token[:-1]])
            new = np.flatnonzero(fresh)
            held = np.add.reduceat(fresh | np.concatenate([[True], who[1:] != who[:-1]]), new)  # different entities
            often = np.isin(token[new], joined["shared"])
            runs = np.diff(np.append(new, len(token)))
            rank[order] = np.repeat(np.where(often, LAST, np.floor(np.log2(held))).astype(np.uint8), runs)
            kept = np.zeros(len(tokens), bool)
            kept[order] = np.repeat(often | (held > 1), runs)
            tokens, owner, rank = tokens[kept], owner[kept], rank[kept]
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
        who, ends = owner[at], np.append(at, len(owner))
        target = (mix(joined["entities"][who].view(U64)) % U64(buckets)).astype(np.int32)
        rows = []
        for x in np.unique(target):
            mine = np.flatnonzero(target == x)
            cells = np.concatenate([np.arange(a, b) for a, b in zip(ends[mine], ends[mine + 1], strict=True)])
            rows.append((int(number[x]), joined["entities"][who[mine]].tobytes(), joined["sizes"][who[mine]].tobytes(), (ends[mine + 1] - ends[mine]).astype(np.int32).tobytes(), tokens[cells].tobytes(), rank[cells].tobytes()))
        return pa.table({"target": pa.array([r[0] for r in rows], pa.int32())} | {c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate((*_PARTS[2:6], "ranks"), 1)})

    return cut.repartition(tasks, "bucket").groupBy("bucket", "settled").applyInArrow(trimmed_group(tell), "target int, entities binary, sizes binary, counts binary, tokens binary, ranks binary")


def once(docs: DataFrame, named: DataFrame, broadcast: int = BROADCAST):
    """(docs, copied): documents of which each entity's shingles can be cut once; copied is what pieces() takes."""
    own = named.where("entity is not null").groupBy("entity").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copied = materialize(own.where("n > 1 and first is not null").select("entity", "first"))
    if copied.count() <= broadcast:
        t = copied.toArrow().sort_by("entity")  # broadcast rows at most
        return docs, docs.sparkSession.sparkContext.broadcast((t["entity"].to_numpy(), t["first"].to_numpy()))
    kept = own.select(F.col("first").alias("doc_id")).distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi")), None


def candidates(shared: DataFrame, tasks: int) -> DataFrame:
    """(entity, n, k, tokens, ranks) of the entities with shared shingles in their prefix: k of them, whatever the order."""

    def gather(t: pa.Table) -> pa.Table:
        entities, sizes, counts, tokens, ranks = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in zip((*_PARTS[2:6], "ranks"), (np.int64, np.int32, np.int32, U64, np.uint8), strict=True))
        owner = np.repeat(entities, counts)
        size = dict(zip(entities.tolist(), sizes.tolist(), strict=True))
        order = np.lexsort((tokens, owner))
        owner, tokens, ranks = owner[order], tokens[order], ranks[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])]) if len(owner) else np.zeros(0, bool)
        owner, tokens, ranks = owner[new], tokens[new], ranks[new]
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
        out = []
        for a, b in zip(at.tolist(), np.append(at[1:], len(owner)).tolist(), strict=True):
            n = size[int(owner[a])]
            if (k := prefix_length(n) - (n - (b - a))) > 0:
                out.append((int(owner[a]), n, k, tokens[a:b].tobytes(), ranks[a:b].tobytes()))
        return pa.table({c: pa.array([r[x] for r in out], pa.int64() if x < 3 else pa.binary()) for x, c in enumerate(("entity", "n", "k", "tokens", "ranks"))})

    return shared.repartition(tasks, "target").groupBy("target").applyInArrow(trimmed_group(gather), "entity bigint, n bigint, k bigint, tokens binary, ranks binary")


def prefix(tokens: np.ndarray, ranks: np.ndarray, k: int, order: int) -> np.ndarray:
    """The first k shared shingles under one of the orders."""
    return tokens[np.lexsort((mix(tokens ^ _ORDER[order]), ranks))[:k]]


def families(found: DataFrame) -> DataFrame:
    """(entity, family): entities that share prefix shingles under the first order have one family, over others too."""

    def posts(batches):
        for batch in batches:
            e, k, tokens, ranks = (batch.column(c).to_pylist() for c in ("entity", "k", "tokens", "ranks"))
            parts = [prefix(np.frombuffer(t, U64), np.frombuffer(r, np.uint8), n, 0) for t, r, n in zip(tokens, ranks, k, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U64), *parts]).view(np.int64)), pa.array(np.repeat(np.array(e, np.int64), [len(p) for p in parts]))], ["token", "entity"])

    posted = found.mapInArrow(posts, "token bigint, entity bigint")
    least = posted.groupBy("token").agg(F.min("entity").alias("least"), F.max("entity").alias("most")).where("least < most").drop("most")
    edges = posted.join(least, "token").where("entity != least").select(F.col("entity").alias("a"), F.col("least").alias("b"))
    return connected_components(edges).select(F.col("node").alias("entity"), F.col("component").alias("family"))


def _common(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of one shares with each of the other, by products of 0/1 matrices over the tokens of both."""
    out = np.zeros((len(one), len(other)), np.float32)
    a, b = np.concatenate([*one, np.zeros(0, U64)]), np.concatenate([*other, np.zeros(0, U64)])
    both = np.intersect1d(a, b)
    ra, rb = np.repeat(np.arange(len(one)), [len(x) for x in one]), np.repeat(np.arange(len(other)), [len(x) for x in other])
    pa_, pb = np.searchsorted(both, a), np.searchsorted(both, b)
    ka, kb = (pa_ < len(both)), (pb < len(both))
    ka[ka] = both[pa_[ka]] == a[ka]
    kb[kb] = both[pb[kb]] == b[kb]
    ra, pa_, rb, pb = ra[ka], pa_[ka], rb[kb], pb[kb]
    step = max(256, (16 << 20) // max(1, len(one) + len(other)))
    for at in range(0, len(both), step):
        width = min(step, len(both) - at)
        x, y = np.zeros((len(one), width), np.float32), np.zeros((len(other), width), np.float32)
        i, j = (pa_ >= at) & (pa_ < at + width), (pb >= at) & (pb < at + width)
        x[ra[i], pa_[i] - at] = 1
        y[rb[j], pb[j] - at] = 1
        out += x @ y.T
    return out


def links(n: np.ndarray, k: np.ndarray, tokens: list[np.ndarray], ranks: list[np.ndarray], mine: np.ndarray, its: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of mine and its that link: those in the candidates of every order, then verified by exact counts."""
    small, large = np.minimum(n[mine][:, None], n[its][None, :]), np.maximum(n[mine][:, None], n[its][None, :])
    maybe = 100 * small >= PERCENT * large
    for order in range(ORDERS):
        rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if not len(rows):
            break
        first = {x: prefix(tokens[x], ranks[x], k[x], order) for x in {*mine[rows].tolist(), *its[cols].tolist()}}
        maybe[np.ix_(rows, cols)] &= _common([first[x] for x in mine[rows].tolist()], [first[x] for x in its[cols].tolist()]) > 0
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(rows):
        return rows, rows
    same = _common([tokens[x] for x in mine[rows]], [tokens[x] for x in its[cols]]).astype(np.int64)
    good = maybe[np.ix_(rows, cols)] & (100 * same >= PERCENT * (n[mine[rows]][:, None] + n[its[cols]][None, :] - same))
    i, j = np.nonzero(good)
    return mine[rows[i]], its[cols[j]]


def linked(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the links between entities, tile by tile."""
    family = materialize(families(found))
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("size"))
    alone = sizes.where("blocks = 1").agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-alone // block))  # small families share a task
    members = found.join(family, "entity").join(sizes.select("family", "blocks"), "family")
    own = F.when(F.col("blocks") > 1, F.floor(F.log(F.col("n")) / (1.001 * np.log(100 / PERCENT)))).otherwise(0).cast("int")
    members = members.withColumn("class", own)
    classes = members.where("blocks > 1").groupBy("family", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    shape = classes.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("class", "parts"))).alias("shape"))  # a class for each factor of size: few
    members = members.join(shape, "family", "left")
    parts = lambda c: F.coalesce(F.try_element_at("shape", c), F.lit(0))
    at = lambda c, k: c * CLASS + k
    blocks = lambda c: F.when(parts(c) > 0, F.transform(F.sequence(F.lit(0), parts(c) - 1), lambda k: at(c, k))).otherwise(F.array().cast("array<int>"))
    mine = F.when(F.col("blocks") > 1, at(F.col("class"), F.pmod(F.xxhash64("entity"), parts(F.col("class"))).cast("int"))).otherwise(0)
    members = members.withColumn("block", mine).withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.col("family"))).withColumn("large", F.col("blocks") > 1)
    other = F.explode(F.when(F.col("large"), F.concat(*(blocks(F.col("class") + k) for k in (-1, 0, 1)))).otherwise(F.array(F.lit(0)))).alias("other")
    tiles = members.select("*", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def tile(t: pa.Table) -> pa.Table:
        entity, n, k, fam, at = (t[c].to_numpy() for c in ("entity", "n", "k", "family", "block"))
        tokens, ranks = ([np.frombuffer(x, kind) for x in t[c].to_pylist()] for c, kind in (("tokens", U64), ("ranks", np.uint8)))
        low = t["low"][0].as_py()
        same = low == t["high"][0].as_py()
        out = []
        order = np.argsort(fam, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(fam[order])) + 1):
            mine = part[at[part] == low]
            its = mine if same else part[at[part] != low]
            if len(mine) and len(its):
                i, j = links(n, k, tokens, ranks, mine, its)
                if same:
                    i, j = i[i < j], j[i < j]
                out += [(entity[a], entity[b]) for a, b in forest(len(entity), i, j)]
        return pa.table({c: pa.array([row[x] for row in out], pa.int64()) for x, c in enumerate(("a", "b"))})

    wanted = tiles.select("entity", "n", "k", "tokens", "ranks", "family", "block", "low", "high", "task", "large")
    return wanted.groupBy("large", "task", "low", "high").applyInArrow(trimmed_group(tile), "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text): the smallest doc_id reachable by links."""
    named = materialize(entities(docs))
    tasks = max(partitions(docs.sparkSession), (named.agg(F.sum("n_shingles")).first()[0] or 0) // TASK_SHINGLES)
    few, copied = once(docs.select("doc_id", "text"), named)
    found = materialize(candidates(shared_shingles(pieces(few, tasks, copied), tasks), tasks))
    group = connected_components(linked(found))
    least = named.where("entity is not null").groupBy("entity").agg(F.min("doc_id").alias("own"))
    grouped = least.join(group, least.entity == group.node, "left").withColumn("component", F.coalesce("component", "entity"))
    smallest = grouped.groupBy("component").agg(F.min("own").alias("component_id"))
    per = grouped.join(smallest, "component").select("entity", "component_id")
    return named.join(per, "entity", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SHINGLES_SQL = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SHINGLES_SQL} AS s FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (n + m - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM d"""
