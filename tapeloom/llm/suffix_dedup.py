"""Operator 6: removal of byte strings that occur more than once, by a distributed merge sort of suffixes.

A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else, in the same text or another.

Not every suffix is sorted. Each start of a LENGTH-byte string belongs to one anchor at most REACH - 1 bytes on: where the
hash of the GRAM bytes is smallest among the REACH positions from the start on, the leftmost on ties. Equal strings have
their anchors at equal distance, so starts need only be compared between anchors whose first CORE = LENGTH - REACH + 1
bytes, which every string of theirs holds, are equal.

1. Each task hashes the cores of its texts' anchors; buckets of hashes tell which cores occur more than once. A core held
   often within one task is known to be repeated at once, and one copy stands for all of the task's.
2. The texts with such anchors cut them out, REACH - 1 bytes before to LENGTH after. Occurrences of a record within one
   task are one record that is known to repeat. Each task sorts its records' suffixes into a run for each bucket of cores
   and front-codes it: how many bytes a suffix shares with the one before, and the rest. A core with many occurrences does
   not go to one bucket: a start d bytes before its anchor fixes d bytes to the left and LENGTH - d to the right, so its
   starts are dealt by stripes of STRIPE distances and the bytes that all strings of a stripe have. A record has no more
   bytes than its distances need. What is settled goes to any bucket.
3. A bucket's task merges its runs by a loser tree that compares common-prefix lengths first and bytes only behind the
   prefix that is already known, so the merged order comes with its common-prefix lengths. Starts REACH - 1 to 0 bytes
   before an anchor repeat if another suffix shares that much less of LENGTH to the right, and the bytes to the left.
4. The intervals go back to their texts.

Shorter passages stay in the text but are reported: n_repeats counts the anchors whose first SHORT bytes occur again. Any
string of REACH + SHORT - 1 = 255 bytes, which fifty words have, holds such an anchor; strings under SHORT bytes never count.

Null texts are empty. Texts under LENGTH bytes stay whole. Repeated rows are texts like others, so they remove each other,
and so do rows that share a doc_id or have none: a row is known by its doc_id and a hash of its text, and rows that agree
in both have the same result. Bytes are compared themselves to the right, by 64-bit hashes to the left and for cores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_chunks, labels, materialize, mix, prefix_hash, seeded, text_tasks, trimmed, window_hash

LENGTH, REACH, GRAM, SHORT = 400, 128, 24, 128
CORE = LENGTH - REACH + 1
LEFT = REACH - 1
#: An anchor: where it is, how far before it its last and its first start lie, and whether its core is a hot one.
PLACE = np.dtype([("p", "<i4"), ("near", "u1"), ("far", "u1"), ("hot", "?")])
#: Anchors of a task's next PART_BYTES of text with one core, from which one copy of it stands for all.
OFTEN, PART_BYTES = 24, 8 << 20
#: Occurrences from which a core is hot, as one is that a task has often; and the distances of a hot core's stripe.
HOT, STRIPE = 512, 32
#: Records that a task remembers to have sent.
SENT = 200_000
#: What a row is known by.
ROW = np.dtype([("doc", "<i8"), ("hash", "<i8")])


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each position the leftmost smallest of the next width values, for all whole windows."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # a value and its place in one number, so that equal values go to the left: the places are within two blocks
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, ~U64(0))
    padded[: len(h)] = h
    padded = (padded & ~U64(511)) | np.tile(np.arange(width, dtype=U64), blocks)
    by = padded.reshape(blocks, width)
    head = np.minimum.accumulate(by, 1).ravel()  # smallest from a block's start up to here
    tail = np.minimum.accumulate(by[:, ::-1], 1)[:, ::-1].ravel()  # from here up to a block's end
    start = np.arange(n)
    a, b = tail[start], head[start + width - 1]
    first = (a & ~U64(511)) <= (b & ~U64(511))
    whole = start % width == 0
    pick = np.where(first | whole, a, b)
    block = np.where(first | whole, start // width, (start + width - 1) // width)
    return block * width + (pick & U64(511)).astype(np.int64)


def anchors(sums: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the text at [a, b): (anchor, first start, last start) for strings of REACH + SHORT - 1 bytes, positions in the
    text; an anchor's starts are a contiguous run."""
    if b - a < REACH + SHORT - 1:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(a, b - SHORT + 1)
    place = sliding_argmin(window_hash(sums, at, at + GRAM), REACH)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[new], new, np.append(new[1:], len(place)) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, hash, text): rows with what they are known by; the hash's last bit says that the doc_id is null."""
    null = F.col("doc_id").isNull()
    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(null.cast("long")).alias("hash"), "text")


def _order(rows: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What sorts rows, and then by more; and where in that order another row begins."""
    order = np.lexsort((*then[::-1], rows["hash"], rows["doc"]))
    row = rows[order]
    new = (row["doc"][1:] != row["doc"][:-1]) | (row["hash"][1:] != row["hash"][:-1])
    return order, np.flatnonzero(np.concatenate([[True], new])) if len(rows) else np.zeros(0, int)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, ROW)
    out["doc"], out["hash"] = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("hash").to_numpy(zero_copy_only=False)
    return out


_PIECE = ["bucket", "kind", "rows", "counts", "cores", "places", "shared"]


def _pieces(rows: np.ndarray, who: np.ndarray, core: np.ndarray, place: np.ndarray | None, number: np.ndarray) -> list[tuple]:
    """What a task knows of cores, packed by bucket, of which number has the numbers; who: each core's row. The kind is 1 for
    cores without places, and 2 more for cores that the task has seen often, which are settled."""
    buckets, kind = len(number), int(place is None)
    order = np.argsort(core, kind="stable")
    core, who, place = core[order], who[order], None if place is None else place[order]
    new = np.concatenate([[True], core[1:] != core[:-1]])[: len(core)]
    runs = np.diff(np.append(np.flatnonzero(new), len(core)))
    often = np.repeat(runs >= OFTEN, runs)
    stand = core[new][runs >= OFTEN]
    edge = np.array([k * ((1 << 64) // buckets) for k in range(buckets)], U64)
    at, to = np.append(np.searchsorted(core, edge), len(core)), np.append(np.searchsorted(stand, edge), len(stand))
    parts = [(int(np.bitwise_xor.reduce(core) % U64(buckets)), kind + 2, np.flatnonzero(often), b"")] if often.any() else []
    for k in np.flatnonzero((at[:-1] < at[1:]) | (to[:-1] < to[1:])).tolist():
        parts.append((k, kind, at[k] + np.flatnonzero(~often[at[k] : at[k + 1]]), stand[to[k] : to[k + 1]].tobytes()))
    out = []
    for bucket, what, mine, known in parts:
        mine = mine[np.argsort(who[mine], kind="stable")]
        owner, count = np.unique(who[mine], return_counts=True)
        out.append((number[bucket], what, rows[owner].tobytes(), count.astype(np.int32).tobytes(), core[mine].tobytes(), b"" if place is None else place[mine].tobytes(), known))
    return out


def repeated_anchors(docs: DataFrame, tasks: int) -> DataFrame:
    """(row, places, n_repeats): anchors whose core occurs again, packed as PLACE, and how many have their first SHORT bytes
    again, in pieces, of docs(doc, hash, text)."""
    number = labels(docs.sparkSession, tasks)

    def cut(batches):
        rows, who, core, place, short_who, short, size, n = [], [], [], [], [], [], 0, 0

        def out():
            known = np.concatenate(rows)
            made = _pieces(known, np.concatenate(short_who), np.concatenate(short), None, number) if short else []
            made += _pieces(known, np.concatenate(who), np.concatenate(core), np.concatenate(place), number) if core else []
            return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in made], pa.int32()) for c in range(2)), *(pa.array([r[c] for r in made], pa.binary()) for c in range(2, 7))], _PIECE)

        for batch in batches:
            own = _rows(batch)
            for row, offsets, data in byte_chunks(batch):
                sums = prefix_hash(data)
                for k in range(len(offsets) - 1):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    p, low, high = anchors(sums, a, b)
                    if len(p):
                        short_who.append(np.full(len(p), n + k)), short.append(window_hash(sums, a + p, a + p + SHORT))
                        high = np.minimum(high, b - a - LENGTH)
                        whole = np.flatnonzero(low <= high)
                        p, low, high = p[whole], low[whole], high[whole]
                        cell = np.zeros(len(p), PLACE)
                        cell["p"], cell["near"], cell["far"] = p, p - high, p - low
                        place.append(cell), who.append(np.full(len(p), n + k)), core.append(window_hash(sums, a + p, a + p + CORE))
                rows.append(own[row : row + len(offsets) - 1])
                n, size = n + len(offsets) - 1, size + len(data)
                if size >= PART_BYTES:
                    yield out()
                    rows, who, core, place, short_who, short, size, n = [], [], [], [], [], [], 0, 0
        if rows:
            yield out()

    def tell(t: pa.Table) -> pa.Table:
        kind = t["kind"][0].as_py()
        settled, placed = kind >= 2, kind % 2 == 0
        row, count, core, place, shared = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in zip(_PIECE[2:], (ROW, np.int32, U64, PLACE, U64), strict=True))
        owner, hot = np.repeat(row, count), np.full(len(place), settled)
        if not settled and len(core):
            order = np.argsort(core, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], core[order][1:] != core[order][:-1]]))
            runs = np.diff(np.append(first, len(core)))
            often = np.isin(core[order][first], shared)
            kept = order[np.repeat((runs > 1) | often, runs)]
            if placed:  # as the occurrences that are settled know it too, all of a core agree whether it is hot
                hot[order] = np.repeat((runs >= HOT) | often, runs)
                place, hot = place[kept], hot[kept]
            owner = owner[kept]
        if placed:  # rows that agree in all say the same
            place = place.copy()
            place["hot"] = hot
            order, _ = _order(owner, place["p"])
            owner, place = owner[order], place[order]
            again = (owner[1:] == owner[:-1]) & (place["p"][1:] == place["p"][:-1])
            new = np.concatenate([[True], ~again])[: len(owner)]
            owner, place = owner[new], place[new]
        order, at = _order(owner)
        owner, place = owner[order], place[order] if placed else place
        ends = np.append(at, len(owner))
        cells = [place[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)] if placed else [None] * len(at)
        return pa.table({"doc": pa.array(owner["doc"][at]), "hash": pa.array(owner["hash"][at]), "places": pa.array(cells, pa.binary()), "n_repeats": pa.array(np.zeros(len(at), np.int64) if placed else np.diff(ends))})

    pieces = docs.mapInArrow(trimmed(cut), "bucket int, kind int, rows binary, counts binary, cores binary, places binary, shared binary")
    return pieces.repartition(tasks, "bucket").groupBy("bucket", "kind").applyInArrow(tell, "doc long, hash long, places binary, n_repeats long")


# --- sorted runs -----------------------------------------------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes a and b share, of which at are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 32
    while a[at : at + step] == b[at : at + step]:
        at += step
    while a[at] == b[at]:
        at += 1
    return at


def front_code(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared with the one before, length of the rest, the rests) of a sorted run."""
    shared, before = [], b""
    for x in run:
        shared.append(shared_prefix(before, x))
        before = x
    rests = [x[n:] for x, n in zip(run, shared, strict=True)]
    return np.array(shared, np.int32), np.array([len(r) for r in rests], np.int32), b"".join(rests)


def decode(shared: np.ndarray, length: np.ndarray, rests: bytes):
    """(suffix, shared with the one before) of a front-coded run, in order."""
    before, at = b"", 0
    for n, m in zip(shared.tolist(), length.tolist(), strict=True):
        before = before[:n] + rests[at : at + m]
        at += m
        yield before, n


def merge(runs: list) -> list[tuple[int, int, int]]:
    """Merges front-coded runs: (run, place in the run, bytes shared with the suffix before it), in sorted order.

    A loser tree. Each contender carries how much it shares with the last winner: of two, the one that shares more is the
    smaller, without a look at the bytes; on a tie bytes are compared from there on, and the loser's share with its winner
    is what the comparison found. Contenders of the path to the root have their share with the last winner, as every loser
    of that path lost to it.
    """
    k = len(runs)
    feeds = [decode(*r) for r in runs]
    now: list[bytes | None] = [None] * k
    share, place = [0] * k, [-1] * k

    def pull(r):
        got = next(feeds[r], None)
        now[r] = got[0] if got else None
        share[r] = got[1] if got else -1
        place[r] += 1

    def play(a, b):
        """(winner, loser) of two runs; the loser then shares with the winner what share says."""
        if now[a] is None:
            return b, a
        if now[b] is None:
            return a, b
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        x, y = now[a], now[b]
        n = shared_prefix(x, y, share[a])
        a, b = (a, b) if x[n:] <= y[n:] else (b, a)
        share[b] = n
        return a, b

    for r in range(k):
        pull(r)
        share[r] = 0 if now[r] is not None else -1
    losers = [0] * k

    def build(node):
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        winner, losers[node] = play(a, b)
        return winner

    best = build(1) if k > 1 else 0
    out = []
    while now[best] is not None:
        out.append((best, place[best], share[best]))
        pull(best)
        node = (best + k) >> 1
        while node:
            winner, losers[node] = play(best, losers[node])
            best = winner
            node >>= 1
    return out


def repeated_starts(lcp: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) distance before its anchor at which a record has a repeated start, -1 if at none. lcp: bytes shared with
    the record before; left: the LEFT bytes before each anchor, as rows of bytes; low, high: the record's own distances;
    many: records that occur more than once as they are."""
    n = len(lcp)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    value = seeded(256, 5)
    own = np.zeros(n, U64)  # hash of the distance bytes before the anchor
    for distance in range(REACH):
        if distance:
            own = mix(own * U64(0x9E3779B97F4A7C15) + value[left[:, LEFT - distance]])
        mine = np.flatnonzero((low <= distance) & (distance <= high))
        if not len(mine):
            continue
        run = np.cumsum(lcp < LENGTH - distance)
        key = mix(own[mine] + run[mine].astype(U64) * U64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = many[mine]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = mine[again]
        most[hit] = distance
        least[hit] = np.where(least[hit] < 0, distance, least[hit])
    return least, most


_RUN = "rows binary, places binary, lows binary, highs binary, many binary, shared binary, lengths binary, rests binary, lefts binary"


def records(left: bytes, right: bytes, near: int, far: int, hot: bool):
    """(bytes to deal by, left, right, near, far): what of an anchor with these bytes beside it is compared. Strings that are
    equal at a distance between near and far are dealt alike; no distance is in two records."""
    for low in range(near - near % STRIPE, far + 1, STRIPE) if hot else [0]:
        high = low + STRIPE - 1 if hot else LEFT
        least, most = max(near, low), min(far, high)
        by = b"%d " % low + left[LEFT - low :] + right[: LENGTH - high] if hot else right[:CORE]
        yield by, left[LEFT - most :].rjust(LEFT, b"\0"), right[: LENGTH - least], least, most


def spans(docs: DataFrame, lists: DataFrame, tasks: int) -> DataFrame:
    """(doc, hash, spans): packed int64 pairs [start, end) of bytes, in pieces that may overlap, of docs(doc, hash, text) with
    lists(doc, hash, places)."""
    number = labels(docs.sparkSession, tasks)
    rows = docs.join(lists.where("size(places) > 0").select("doc", "hash", "places"), ["doc", "hash"]).select("doc", "hash", "text", "places")

    def cut(batches):
        sent: dict[bytes, tuple | None] = {}  # records sent, with their one place if that is not yet settled
        for batch in batches:
            own, places = _rows(batch), batch.column("places").to_pylist()
            for row, offsets, data in byte_chunks(batch):
                raw = data.tobytes()
                cut_out: dict[tuple, list] = {}
                for k in range(len(offsets) - 1):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    for p, near, far, hot in np.frombuffer(b"".join(places[row + k]), PLACE).tolist():
                        left = raw[max(a, a + p - LEFT) : a + p].rjust(LEFT, b"\0")
                        for record in records(left, raw[a + p : min(b, a + p + LENGTH)], near, far, hot):
                            cut_out.setdefault(record, []).append((own[row + k], p, *record[3:]))
                runs: dict[int, list] = {}
                done: list[tuple] = []
                for (by, left, right, near, far), at in cut_out.items():
                    name = xxhash.xxh3_128_digest(b"%d %d " % (near, far) + left + right)
                    if name in sent:  # a record like it is on its way from here: both repeat
                        done += [*at, *([sent[name]] if sent[name] else [])]
                        sent[name] = None
                        continue
                    if len(sent) >= SENT:
                        sent.clear()
                    sent[name] = at[0] if len(at) == 1 else None
                    runs.setdefault(xxhash.xxh3_64_intdigest(by) % tasks, []).append((right, left, at))
                out = []
                pack = lambda cells, k: np.array([c[k] for c in cells], (ROW, np.int64, np.int32, np.int32)[k]).tobytes()
                for bucket, run in runs.items():
                    run.sort(key=lambda x: x[0])
                    for *_, at in run:
                        done += at[1:]
                    cells = [at[0] for *_, at in run]
                    shared, length, rests = front_code([right for right, *_ in run])
                    out.append((number[bucket], False, *(pack(cells, k) for k in range(4)), np.array([len(at) > 1 for *_, at in run]).tobytes(), shared.tobytes(), length.tobytes(), rests, b"".join(left for _, left, _ in run)))
                if done:  # several places of one record: theirs is settled, in whatever bucket
                    out.append((number[int(own[row]["hash"]) // 2 % tasks], True, *(pack(done, k) for k in range(4)), b"", b"", b"", b"", b""))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.bool_()), *(pa.array([r[k] for r in out], pa.binary()) for k in range(2, 11))], ["bucket", "settled", *(x.split()[0] for x in _RUN.split(", "))])

    def sort(t: pa.Table) -> pa.Table:
        row, place, low, high, many = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("rows", ROW), ("places", np.int64), ("lows", np.int32), ("highs", np.int32), ("many", bool)))
        if t["settled"][0].as_py():
            least, most = low.astype(np.int64), high.astype(np.int64)
        else:
            kinds = [np.frombuffer(x, np.int32) for x in t["shared"].to_pylist()]
            order = merge(list(zip(kinds, (np.frombuffer(x, np.int32) for x in t["lengths"].to_pylist()), t["rests"].to_pylist(), strict=True)))
            start = np.concatenate([[0], np.cumsum([len(x) for x in kinds])])
            index = np.array([start[r] + p for r, p, _ in order], np.int64)
            left = np.frombuffer(b"".join(t["lefts"].to_pylist()), np.uint8).reshape(-1, LEFT)
            lcp = np.array([n for *_, n in order], np.int64)
            row, place = row[index], place[index]
            least, most = repeated_starts(lcp, left[index], low[index], high[index], many[index])
        hit = np.flatnonzero(most >= 0)
        order, at = _order(row[hit])
        hit = hit[order]
        row, pairs = row[hit], np.stack([place[hit] - most[hit], place[hit] - least[hit] + LENGTH], 1)
        ends = np.append(at, len(row))
        return pa.table({"doc": pa.array(row["doc"][at]), "hash": pa.array(row["hash"][at]), "spans": pa.array([np.ascontiguousarray(pairs[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})

    return rows.mapInArrow(trimmed(cut), f"bucket int, settled boolean, {_RUN}").repartition(tasks, "bucket").groupBy("bucket", "settled").applyInArrow(sort, "doc long, hash long, spans binary")


def merged(pieces: list[bytes] | None) -> np.ndarray:
    """Maximal runs [start, end), in order."""
    if not pieces:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(b"".join(pieces), np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > end[:-1]]))
    return np.stack([pairs[new, 0], end[np.append(new[1:] - 1, len(end) - 1)]], 1)


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_repeats): kept are the remaining bytes, n_repeats the repeated anchors."""
    tasks = text_tasks(docs)
    rows = keyed(docs.select("doc_id", "text"))
    found = repeated_anchors(rows, tasks).groupBy("doc", "hash").agg(F.collect_list("places").alias("places"), F.sum("n_repeats").alias("n_repeats"))
    found = materialize(found)
    pieces = spans(rows, found, tasks).groupBy("doc", "hash").agg(F.collect_list("spans").alias("spans"))
    # both joins deal the texts out alike, so they are shuffled once
    doc_id = F.when(F.col("hash").bitwiseAND(F.lit(1)) == 0, F.col("doc")).alias("doc_id")
    rows = rows.join(pieces, ["doc", "hash"], "left").join(found.select("doc", "hash", "n_repeats"), ["doc", "hash"], "left")
    rows = rows.select(doc_id, "text", "spans", F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"))

    def run(batches):
        for batch in batches:
            out = []
            raw = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
            for text, some in zip(raw, batch.column(2).to_pylist(), strict=True):
                gone = merged(some)
                edges = [0, *gone.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(gone), kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] for r in out], pa.binary()), batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeats"])

    return rows.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_repeats long")
