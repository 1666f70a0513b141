"""Operator 13: phrases of two and three words that occur together more than their words would, counted by double-array tries.

Texts, with A-Z lower-cased, are split at [.,;:!?\\x0A-\\x0D] into pieces and these into words [^\\x20\\x09]+; all counts are
per lang (null: und). A word goes by a 64-bit hash of itself and its lang. Four passes read the texts:

1. Words are counted. Those with LEAST occurrences are frequent; only of these can a frequent phrase consist.
2. Pairs of neighbouring words are nominated: those whose words are both in a bitmap of the frequent ones and that come up
   LEAST times over all tasks. 3. Triples, likewise, whose two pairs are both in a bitmap of the nominated ones.
4. Nominated phrases, dealt over shards of about SHARD, become double-array tries, built by tasks and broadcast PASS_BYTES
   at a time. A task holds the states of all positions of a text in an array and moves them on together, word by word;
   accepting states are counted by bincount, and the tasks' counts summed, BLOCK states a row. The tries' counts are the result's.

Bitmaps are of a fixed size: where more words or pairs are frequent they let more through, and lose none. Where the tries
outgrow PASS_BYTES the fourth pass runs again for the next ones. Words of vocabulary and phrases never go to the driver but
as tries; scores, the drop rule and the ranks are Spark's, on exact decimals.

Null and empty texts have no words. Repeated rows count again; doc_id is not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, U64, _letter, byte_chunks, materialize, mix, partitions, seeded, trimmed

LEAST, TOP, COVERED = 10, 2000, 50
NO_LANG = "und"
#: Bits of the bitmaps of words and of pairs.
WORD_BITS, PAIR_BITS = 25, 27
#: Phrases of a trie, about; bytes of the tries that are broadcast at once.
SHARD, PASS_BYTES = 1 << 19, 96 << 20
#: Text whose words or phrases a task makes distinct at once.
PART_BYTES = 16 << 20
#: Accepting states whose counts are one row of the sums.
BLOCK = 4096
_END = np.zeros(256, bool)
_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _END.copy()
_GAP[list(b" \t")] = True
_PLACE = seeded(3, 13)


class Words:
    """The words of a run of texts: hashes, places in low (the texts in small letters), and whether the next word follows in
    the same piece."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, salt: np.ndarray):
        self.low = low = _LOWER[data]
        word, first = ~_GAP[low], np.zeros(len(low) + 1, bool)
        first[offsets] = True  # a text's end ends its last word
        self.start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first[:-1]) if len(low) else word)
        self.end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | first[1:]) if len(low) else word) + 1
        size = self.end - self.start
        at = np.flatnonzero(word)
        within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        sums = np.zeros(len(at) + 1, U64)
        np.cumsum(_BYTE[low[at]] * _letter(int(size.max(initial=0)))[within], out=sums[1:])
        edge = np.append(0, np.cumsum(size))
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = mix(sums[edge[1:]] - sums[edge[:-1]] + size.astype(U64) + salt[self.text])
        ends = np.cumsum(_END[low])
        self.follows = (self.text[1:] == self.text[:-1]) & (ends[self.start[1:]] == ends[self.end[:-1] - 1]) if len(size) else np.zeros(0, bool)


def words_of(batch: pa.RecordBatch):
    """(first row, Words) for runs of whole rows of a batch(text, lang)."""
    lang = pc.fill_null(batch.column("lang").cast(pa.string()), NO_LANG).dictionary_encode()
    salts = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lang.dictionary.to_pylist()], U64)
    salt = salts[lang.indices.to_numpy()] if len(lang) else salts
    for at, offsets, data in byte_chunks(batch):
        yield at, Words(offsets, data, salt[at : at + len(offsets) - 1])


def _pick(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end) for each word, as texts."""
    size = end - start
    to = np.append(0, np.cumsum(size))
    cells = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[cells].tobytes())).cast(pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n) of docs(text, lang): every word of a lang, how often it occurs."""

    def distinct(parts: list[tuple]) -> pa.RecordBatch:
        """The words of several runs, each once."""
        hashes, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.diff(hashes[order].view(np.int64), prepend=~hashes[order[:1]].view(np.int64)))
        at = pa.array(order[first])
        langs, words = (pa.concat_arrays([p[k] for p in parts]).take(at) for k in (2, 3))
        return pa.RecordBatch.from_arrays([langs, words, pa.array(hashes[order[first]].view(np.int64)), pa.array(np.add.reduceat(n[order], first))], ["lang", "word", "hash", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            lang = batch.column("lang").cast(pa.string())
            for row, w in words_of(batch):
                hashes, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                if len(hashes):
                    parts.append((hashes, n, lang.take(pa.array(row + w.text[at])), _pick(w.low, w.start[at], w.end[at])))
                size += len(w.low)
                if size >= PART_BYTES and parts:
                    yield distinct(parts)
                    parts, size = [], 0
        if parts:
            yield distinct(parts)

    counted = docs.select("text", F.coalesce("lang", F.lit(NO_LANG)).alias("lang")).mapInArrow(trimmed(run), "lang string, word string, hash bigint, n bigint")
    return counted.groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def bitmap(spark: SparkSession, hashes: DataFrame, bits: int):
    """A broadcast bitmap with the bits of hashes(hash) set: 2**bits of them, however many hashes there are."""
    low = F.col("hash").bitwiseAND((1 << bits) - 1)
    cells = hashes.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 AS INT))")).alias("value")).toArrow()
    out = np.zeros(1 << max(0, bits - 6), U64)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy().view(U64)
    return spark.sparkContext.broadcast(out)


def has(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = hashes & U64(len(cells) * 64 - 1)
    return (cells[at >> U64(6)] >> (at & U64(63))) & U64(1) != 0


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one * _PLACE[0] + two * _PLACE[1])


def nominate(docs: DataFrame, length: int, known) -> DataFrame:
    """(h1, h2[, h3]) of phrases of length words that occur LEAST times, all of whose shorter parts are in the bitmap known:
    words for pairs, pairs for triples. Counts here only choose what the tries count."""
    names = [f"h{k + 1}" for k in range(length)]

    def places(w: Words) -> np.ndarray:
        """Where phrases begin whose parts are known."""
        if length == 2:
            good = has(known.value, w.hash)
            return np.flatnonzero(w.follows & good[1:] & good[:-1])
        good = w.follows.copy()
        good[good] = has(known.value, pair_hash(w.hash[:-1][good], w.hash[1:][good]))
        return np.flatnonzero(good[1:] & good[:-1])

    def distinct(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        found = [np.concatenate(f) for f in found]
        key = pair_hash(found[0], found[1]) if length == 2 else mix(pair_hash(found[0], found[1]) + found[2] * _PLACE[2])
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(f[at].view(np.int64)) for f in found), pa.array(n.astype(np.int32))], [*names, "n"])

    def run(batches):
        found, size = [[] for _ in names], 0
        for batch in batches:
            for _, w in words_of(batch):
                if len(w.hash) >= length:
                    at = places(w)
                    for k in range(length):
                        found[k].append(w.hash[at + k])
                size += len(w.low)
                if size >= PART_BYTES and found[0]:
                    yield distinct(found)
                    found, size = [[] for _ in names], 0
        if found[0]:
            yield distinct(found)

    seen = docs.select("text", "lang").mapInArrow(trimmed(run), f"{', '.join(f'{n} bigint' for n in names)}, n int")
    return seen.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).drop("n")


# --- double-array tries ----------------------------------------------------------------------------------------------


class _Cells:
    """The cells of a double array while it is made; free ones have check -1."""

    def __init__(self, root: int):
        self.base, self.check, self.top, self.pick = np.zeros(4 * root + 4096, np.int32), np.full(4 * root + 4096, -1, np.int32), root, np.random.default_rng(7)
        self.taken = np.zeros(len(self.base), bool)
        self.taken[:root] = True

    def room(self, cells: int) -> None:
        """Makes the arrays reach that many cells beyond the top."""
        if self.top + cells > len(self.base):
            more = self.top + cells
            self.base, self.check, self.taken = (np.concatenate([x, np.full(more, fill, x.dtype)]) for x, fill in ((self.base, 0), (self.check, -1), (self.taken, False)))

    def step(self, parent: np.ndarray, digit: np.ndarray, width: int) -> np.ndarray:
        """Gives each distinct (parent, digit) a cell, as a child of parent; digits are below width. Parents of several
        children come first, the largest at once: into one of some places picked at random, else onto new cells at the top.
        Single children then take what is free."""
        children, of = np.unique(parent.astype(np.int64) * width + digit, return_inverse=True)
        parent, digit, cells = children // width, children % width, np.zeros(len(children), np.int64)
        at = np.flatnonzero(np.diff(parent, prepend=-1))
        count = np.diff(np.append(at, len(parent)))
        several = np.argsort(-count, kind="stable")[: int((count > 1).sum())]
        for k in several.tolist():
            own = digit[at[k] : at[k] + count[k]]
            self.room(2 * width)
            starts = self.pick.integers(self.top >> 1, self.top + 1, 24)
            free = np.flatnonzero(~self.taken[starts[:, None] + own].any(1))
            start = int(starts[free[0]]) if len(free) else self.top
            mine = start + own
            self.top = max(self.top, int(mine[-1]) + 1)
            self.base[parent[at[k]]], self.taken[mine], cells[at[k] : at[k] + count[k]] = start, True, mine
        single = at[count == 1]
        self.room(len(single))
        free = np.flatnonzero(~self.taken[: self.top + len(single)])[: len(single)]
        self.base[parent[single]], self.taken[free], cells[single] = free - digit[single], True, free
        self.top = max(self.top, int(free.max(initial=0)) + 1)
        self.check[cells] = parent
        return cells[of]


def digits(words: int) -> int:
    """What a word's code is divided by: two digits, so that no state has very many children, which no array would hold densely."""
    return 1 << (-(-int(words + 1).bit_length() // 2))


def build_trie(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, base, check, accept) of phrases, rows of two or three word hashes, 0 for no third. words is sorted; a word's code
    is its place in it and one. State 0 is the root, whose child by a first word is the word's code; a later word is two
    steps, by the digits of its code. The child of state s by a digit is base[s] + digit, if check of that is s."""
    words = np.unique(phrases[phrases != 0])
    code = np.where(phrases == 0, 0, np.searchsorted(words, phrases) + 1)
    cells, width, triple = _Cells(1 + len(words)), digits(len(words)), code[:, 2] > 0
    cells.check[np.unique(code[:, 0])] = 0
    two = cells.step(cells.step(code[:, 0], code[:, 1] // width, width), code[:, 1] % width, width)
    three = cells.step(cells.step(two[triple], code[triple, 2] // width, width), code[triple, 2] % width, width)
    accept = np.zeros(cells.top, bool)
    accept[two[~triple]] = accept[three] = True
    return words, cells.base[: cells.top], cells.check[: cells.top], accept


class Trie:
    def __init__(self, words: bytes, base: bytes, check: bytes, accept: bytes):
        self.words, self.base, self.check, self.accept = (np.frombuffer(x, kind) for x, kind in zip((words, base, check, accept), (U64, np.int32, np.int32, bool), strict=True))
        self.counts, self.width = np.zeros(len(self.base), np.int64), digits(len(self.words))

    def move(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of them have a next state, those states)."""
        cell = self.base[state].astype(np.int64) + digit
        good = np.flatnonzero((cell >= 0) & (cell < len(self.check)))
        good = good[self.check[cell[good]] == state[good]]
        return good, cell[good]

    def count(self, w: Words) -> None:
        """Adds the phrases of w: all positions' states go on together, level by level."""
        if not len(self.words) or len(w.hash) < 2:
            return
        at = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
        codes = np.where(self.words[at] == w.hash, at + 1, 0)
        place = np.flatnonzero((codes > 0) & (self.check[codes] == 0))  # the root's children
        state = codes[place]
        for _ in range(2):
            on = place < len(w.follows)
            on[on] = w.follows[place[on]]
            place, state = place[on] + 1, state[on]
            known = codes[place] > 0
            place, state = place[known], state[known]
            for digit in (codes // self.width, codes % self.width):
                good, state = self.move(state, digit[place])
                place = place[good]
            hit = state[self.accept[state]]
            if len(hit):
                self.counts += np.bincount(hit, minlength=len(self.counts))

    def phrases(self, cells: np.ndarray) -> np.ndarray:
        """The words' hashes of accepting states, 0 for no third."""

        def up(state):
            """(the state a word before, that word)."""
            half = self.check[state]
            before = self.check[half]
            return before, self.words[(half - self.base[before]) * self.width + state - self.base[half] - 1]

        out = np.zeros((len(cells), 3), U64)
        before, last = up(cells)
        long = before > len(self.words)
        out[~long, 1], out[~long, 0], out[long, 2] = last[~long], self.words[before[~long] - 1], last[long]
        first, out[long, 1] = up(before[long])
        out[long, 0] = self.words[first - 1]
        return out


_TRIE = ["words", "base", "check", "accept"]


def tries(phrases: DataFrame, shards: int) -> DataFrame:
    """(shard, words, base, check, accept): a row for each shard of phrases(h1, h2, h3)."""

    def build(key, t):
        made = build_trie(np.stack([pc.fill_null(t[c], 0).to_numpy().view(U64) for c in ("h1", "h2", "h3")], 1))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(_TRIE, made, strict=True)})

    dealt = phrases.withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, " + ", ".join(f"{c} binary" for c in _TRIE))


def count_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(h1, h2, h3, n) of phrases(h1, h2, h3), counted in docs(text, lang) by tries."""
    spark = docs.sparkSession
    made = materialize(tries(phrases, max(1, -(-phrases.count() // SHARD))))
    weights = [(r.shard, r.bytes) for r in made.select("shard", sum(F.octet_length(c) for c in _TRIE).alias("bytes")).orderBy("shard").collect()]  # a row a shard
    passes, room = [], 0
    for shard, size in weights:
        if not passes or room < size:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append(shard)
        room -= size
    out = None
    for shards in passes:
        sent = spark.sparkContext.broadcast([(r.shard, *(bytes(r[c]) for c in _TRIE)) for r in made.where(F.col("shard").isin(shards)).collect()])  # PASS_BYTES at most

        def run(batches, sent=sent):
            held = {shard: Trie(*rest) for shard, *rest in sent.value}
            for batch in batches:
                for _, words in words_of(batch):
                    for trie in held.values():
                        trie.count(words)
            for shard, trie in held.items():
                counts = trie.counts[trie.accept]
                blocks = np.array_split(counts, np.arange(BLOCK, len(counts), BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], ["shard", "block", "counts"])

        counted = docs.select("text", "lang").mapInArrow(trimmed(run), "shard int, block int, counts binary")
        out = counted if out is None else out.unionByName(counted)
    if out is None:
        return spark.createDataFrame([], "h1 bigint, h2 bigint, h3 bigint, n bigint")

    def add(batches):
        """Sums the counts of each block, whose rows follow one another; one block is held at a time."""
        now, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(total), now[0], np.int32)), pa.array((now[1] * BLOCK + np.arange(len(total))).astype(np.int32)), pa.array(total)], ["shard", "place", "n"])

        for batch in batches:
            for shard, block, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if now != (shard, block):
                    if now:
                        yield done()
                    now, total = (shard, block), 0
                total = total + np.frombuffer(counts, np.int64)
        if now:
            yield done()

    def spell(batches):
        for batch in batches:
            for shard, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie = Trie(*rest)
                cells = np.flatnonzero(trie.accept)
                h = trie.phrases(cells)
                third = pa.array(h[:, 2].view(np.int64), mask=h[:, 2] == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), shard, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), third], ["shard", "place", "h1", "h2", "h3"])

    spelled = made.mapInArrow(trimmed(spell), "shard int, place int, h1 bigint, h2 bigint, h3 bigint")
    dealt = out.repartition(partitions(spark), "shard", "block").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(add, "shard int, place int, n bigint").join(spelled, ["shard", "place"]).select("h1", "h2", "h3", "n")


# --- scores ----------------------------------------------------------------------------------------------------------


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases(h1, h2, h3, n) that no longer one covers; words(lang, word, hash, n)."""
    whole = lambda left, right: F.expr(f"CAST(CAST(a AS DECIMAL(19,0)) * a AS DECIMAL(32,0)) * 1000000BD div (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))")
    one = lambda k: words.select(F.col("hash").alias(f"h{k}"), F.col("n").alias(f"n{k}"), F.col("word").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []))
    pairs = phrases.where("h3 is null").select("h1", "h2", F.col("n").alias("a"))
    triples = phrases.where("h3 is not null").select("h1", "h2", "h3", F.col("n").alias("a"))
    both = triples.select(F.explode(F.array(F.struct("h1", "h2", "a"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))).alias("x")).select("x.*")
    over = both.groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    two = pairs.join(over, ["h1", "h2"], "left").where(F.expr(f"longer is null or 100 * longer < {COVERED} * a")).drop("longer")
    two = two.join(one(1), "h1").join(one(2), "h2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r")).withColumn("score", whole("l", "r"))
    three = triples.join(pairs.select("h1", "h2", F.col("a").alias("n12")), ["h1", "h2"]).join(pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("n23")), ["h2", "h3"])
    three = three.join(one(1), "h1").join(one(2).drop("n2"), "h2").join(one(3), "h3").withColumn("s1", whole("n1", "n23")).withColumn("s2", whole("n12", "n3"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("n1", "n12", "l"), pick("n23", "n3", "r"), pick("s1", "s2", "score"))
    return two.unionByName(three)


def phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first top phrases of each lang of docs(text, lang)."""
    spark = docs.sparkSession
    words = materialize(count_words(docs))
    frequent = words.where(F.col("n") >= LEAST)
    pairs = materialize(nominate(docs, 2, bitmap(spark, frequent.select("hash"), WORD_BITS)))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(*(c.to_numpy().view(U64) for c in batch.columns)).view(np.int64))], ["hash"])

    triples = nominate(docs, 3, bitmap(spark, pairs.mapInArrow(hashed, "hash bigint"), PAIR_BITS))
    nominated = materialize(pairs.withColumn("h3", F.lit(None).cast("long")).unionByName(triples))
    counted = materialize(count_phrases(docs, nominated).where(F.col("n") >= LEAST))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counted, frequent).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
