"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import random
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import common, decontamination, embedding_dedup, line_dedup, ngram_join, packing, pii, quality, sharding, suffix_dedup, token_store

LONG = " ".join(f"word{k}" for k in range(60_000))
LINE = "this line is long enough to be counted by all"
ROWS = [
    (1, None, "a", "x"), (2, "", None, "x"), (3, "  \n\t ", "a", None), (4, LONG, "a", "x"), (5, LONG, "a", "x"), (5, LONG, "a", "x"),
    (6, "three short words", "a", "x"), (7, "three short  words", "a", "x"), (None, "a text without an id " * 30, "a", "x"), (8, "é\U0001f600 \x1c odd  signs", "a", "x"),
    *((10 + k, f"own words {k}\n  {LINE.upper()} \n{LINE}", "a", "x") for k in range(5)),
]
SCHEMA = "doc_id long, text string, shard string, score string"


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_sharding(nasty, none):
    got = sharding.place(nasty, "doc_id", sharding.names(4), 101).collect()
    assert len(got) == len(ROWS) and all(0 <= r.shard < 4 and 0 <= r.slot < 101 for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.place(none, "doc_id", sharding.names(4), 101).count() == 0
    clash = sharding.place(nasty.withColumnRenamed("score", "_slot"), "doc_id", sharding.names(4), 101)
    assert sorted(clash.columns) == ["_slot", "doc_id", "shard", "slot", "text"] and clash.count() == len(ROWS)
    with pytest.raises(ValueError):
        sharding.place(nasty, "shard", sharding.names(4), 101)
    full, less = sharding.fill(sharding.names(10), 1009), sharding.fill(sharding.names(9), 1009)
    sizes = np.bincount(full)
    assert sizes.max() - sizes.min() <= 1
    assert sum(a != b for a, b in zip(full, less) if a != 9) < 0.1 * 1009
    with pytest.raises(ValueError):
        sharding.fill(sharding.names(3), 100)


def test_line_dedup(nasty, none):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(nasty.drop("score")).collect()}
    assert (10, 3, 2, "own words 0") in got and (14, 3, 0, ROWS[-1][1]) in got
    assert (1, 1, 0, None) in got and (2, 1, 0, "") in got and (3, 2, 0, "  \n\t ") in got
    assert line_dedup.dedup_lines(none).count() == 0
    clash = nasty.withColumnsRenamed({"shard": "_keys", "score": "_DOC"}).withColumn("n_lines", F.lit("x"))
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(clash).collect()} == got


def test_line_index_can_be_undone(spark, nasty):
    first, second = nasty.where("doc_id < 12"), nasty.where("doc_id >= 12")
    start = line_dedup.build_index(first, 4)
    assert start.repeated().count() == 0
    more = start.insert(second)
    held = [r.n_docs for r in more.repeated().collect()]
    assert held == [5]
    assert more.insert(second).refs.count() == more.refs.count()
    back = more.delete(second.select("doc_id"))
    assert key(back.refs.collect()) == key(start.refs.collect()) and back.repeated().count() == 0
    k2 = [r.k2 for r in more.repeated().collect()]
    holds = lambda index: any(line_dedup.Cuckoo(table=bytes(r.table)).holds(np.array(k2)).any() for r in index.filters.collect())
    assert holds(more) and not holds(back)


def test_line_index_outgrows_its_filters(spark, none, monkeypatch):
    rows = lambda first, lines: [(first + k, "\n".join([f"own line {first + k} of a text that is long enough", *(f"line {j} of {first}, which is long enough to be counted" for j in range(lines))]), "", "") for k in range(5)]
    parts = [spark.createDataFrame(rows(first, n), SCHEMA) for first, n in ((0, 40), (10, 900), (20, 300))]
    docs = parts[0].union(parts[1]).union(parts[2])
    whole = key(line_dedup.dedup_lines(docs).collect())
    for start in (line_dedup.build_index(none, 1), line_dedup.build_index(none)):
        index = start
        for part in parts:
            index = index.insert(part)
        assert key(index.drop_lines(docs).collect()) == whole and sum(r.n_dropped for r in index.drop_lines(docs).collect()) == 4 * 1240
        less = index.delete(parts[1].select("doc_id"))
        assert key(less.repeated().collect()) == key(line_dedup.build_index(parts[0].union(parts[2])).repeated().collect())
        assert sum(r.n_dropped for r in less.drop_lines(docs).collect()) == 4 * 340
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 200)  # the second time the number of shards grows, and tables are compacted
        monkeypatch.setattr(line_dedup, "COMPACT", 2)
    assert index.shards > 1


def test_cuckoo_filter_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    filled = line_dedup.Cuckoo.of(keys)
    assert filled.holds(keys).all()
    filled.remove(keys[:2500])
    assert filled.holds(keys[2500:]).all() and filled.holds(keys[:2500]).mean() < 0.05


def test_ngram_join(spark, nasty, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(nasty).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 59_996, 4), (6, 1, 6), (7, 1, 6)} <= got
    assert ngram_join.near_duplicates(none).count() == 0
    alike = [(k, " ".join(f"w{(j * 7 + (k if j % 40 == 39 else 0)) % 997}" for j in range(200)), "", "") for k in range(40)]
    few = spark.createDataFrame(alike, SCHEMA)
    sets = ngram_join.shingle_sets
    assert {r.component_id for r in ngram_join.near_duplicates(few).collect()} == brute_components([t for _, t, *_ in alike], sets)
    small_blocks = ngram_join.linked(common.materialize(ngram_join.candidates(ngram_join.shared_shingles(ngram_join.pieces(few, 3), 3), 3)), block=7)
    whole = ngram_join.linked(common.materialize(ngram_join.candidates(ngram_join.shared_shingles(ngram_join.pieces(few, 2), 2), 2)))
    assert key(common.connected_components(small_blocks).collect()) == key(common.connected_components(whole).collect())


def test_ngram_join_tells_long_words_apart(spark):
    """Thue-Morse words and their complements: every polynomial hash modulo a power of two gives both one value."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word, "", ""), (2, other, "", ""), (3, f"{word} x", "", ""), (4, f"{other} x", "", ""), (5, word.upper(), "", "")], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)}


def brute_components(texts, sets):
    s = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        s.append(set(sets(np.array([0, len(raw)]), raw)[0].tolist()))
    top = list(range(len(s)))
    for _ in s:
        for a in range(len(s)):
            for b in range(len(s)):
                if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                    top[a] = top[b] = min(top[a], top[b])
    return set(top)


def test_decontamination(spark, nasty, none):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[500:540]), "z"), (2, None, "z"), (3, "", "z"), (4, "three short words", "z"), (None, LONG, "z"), (1, " ".join(LONG.split()[500:540]), "z")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontamination.contained(nasty, items).collect()}
    assert got == {(4, 1, 36, 36), (5, 1, 36, 36), (6, 4, 1, 1), (7, 4, 1, 1)}
    assert decontamination.contained(none, items).count() == 0 and decontamination.contained(nasty, items.limit(0)).count() == 0


def test_stages_decide_by_row(spark, nasty, tmp_path):
    import corpus_pipeline as c

    got = [(r.doc_id, r.text) for r in c.distinct(spark, nasty, "").collect()]
    rows = [r[:2] for r in ROWS]
    assert key(got) == key(x for x in rows if x[0] not in (5, 7))
    words = lambda a: " ".join(f"{a}{k}" for k in range(60))
    item = words("i")
    odd = [(1, words("a")), (1, words("a")), (None, words("a")), (1, words("b")), (3, words("b")), (4, words("c")), (4, words("d")), (None, words("e")), (None, words("e")), (None, item), (9, item), (9, words("f")), (8, None), (8, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "", "") for k, t in odd], SCHEMA)
    want = [(1, words("a")), (1, words("b")), (4, words("c")), (4, words("d")), (None, words("e")), (9, item), (9, words("f")), (8, None), (8, None), (None, "")]
    assert key((r.doc_id, r.text) for r in c.distinct(spark, docs, "").collect()) == key(want)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert key((r.doc_id, r.text) for r in c.unseen(spark, docs, str(tmp_path)).collect()) == key(x for x in odd if x[1] != item)


def test_stages_take_any_rows(spark, tmp_path):
    """Null, empty and very long texts, rows without or with one doc_id, columns of the stages' own names; then no rows at all."""
    import corpus_pipeline as c

    item = " ".join(LONG.split()[500:540])
    rows = [(k, t, None, f"s{n}", None if t is None else len(t), f"x{n}", f"r{n}", n) for n, (k, t, *_) in enumerate([*ROWS, (20, f"before {item} after", "", "")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, _row string, N_LINES long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(20, 1, 0), (6, 0, 0), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df, n in ((docs, len(rows)), (docs.limit(0), 0)):
        for _, stage in c.STAGES[:-1]:
            got = stage(spark, df, str(tmp_path))
            kept = got.collect()
            assert got.columns == docs.columns and len(kept) <= n and all(r.score == f"x{r.N_LINES}" and r._row == f"r{r.N_LINES}" for r in kept)
            if stage is c.lines:
                assert len(kept) == n and all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
            if stage is c.unseen and n:
                assert {r.N_LINES for r in kept} == set(range(n)) - {3, 4, 5, n - 1}
        pieces = c.packed(spark, df, str(tmp_path)).collect()
        assert sum(r.start == 0 for r in pieces) == n and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_packing(nasty, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(nasty, path).collect()
    whole = {(r.doc_id, r.doc_tokens) for r in got}
    assert {(1, 1), (2, 1), (3, 1)} <= whole and sum(r.length for r in got) == sum(packed for packed in [r.doc_tokens for r in got if r.start == 0])
    assert all(len(r.ids) == 4 * r.length for r in got) and packing.pack(none, path).count() == 0


def whole(encoded):
    ids, offsets = encoded
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_tokens_are_the_librarys(name, spaced, monkeypatch):
    """Letters whose normal form ends in a mark before signs, white space of all kinds, contractions, long texts, full caches."""
    from tokenizers import Tokenizer

    from tapeloom.llm import tokens

    path = public_tokenizers.path(name)
    library, rng = Tokenizer.from_file(path), random.Random(5)
    words = ["word", "Word", "WORD", "H\u0331", "J\u030c", "it's", "don't", "\u00e9", "\u0130", "\u0958", "\u09dc", "\ufb1d", "\u00df", "\u03a3", "1", "23", "x1", "\u6f22\u5b57", "\U0001f600", "a\u0301", "<|", "f_b", "http://x.y/z?q=1", ""]
    spaces = [" ", " ", " ", "\n", "  ", "   ", "\n\n", " \n", "\n ", "\t", "\r\n", "\xa0", "\x1c", "", "\u3000", "\x85", " \n \n ", "\u200b"]
    signs = [*".,!?;:%$&#*|'\"()-_", "...", "?!", ".)", "''", "'s", ""]
    texts = ["".join(x for _ in range(rng.randrange(12)) for x in (rng.choice(words), rng.choice(signs), rng.choice(signs), rng.choice(spaces))) for _ in range(6000)]
    letters = [chr(c) for c in range(0x20, 0x2FF0) if chr(c).isalnum()]
    texts += [c + s + c for c in letters for s in (".", "! ")] + [" ", "  ", "   ", "\n", " a", "a ", "a  ", "  a", "a\n"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert whole(tokens.encode(pa.array(texts), path, spaced)) == want
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 20_000)
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 3000)
    texts = [LONG[:20_000], *texts[:600], LONG[:9000] + "  " + LONG[:9000], None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [(k, np.frombuffer(x, "<u4").tolist()) for k, x in tokens.encoded([batch, batch], path, spaced, 0)]
    assert got == 2 * [(k, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_are_the_librarys(spark, name, spaced):
    from tokenizers import Tokenizer

    from tapeloom.llm import tokens

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>one<|endoftext|>", "x<|endoftext|>, y\n<|endoftext|>", "<|ENDOFTEXT|> <| |> a<|b", "endoftext plain words."]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert whole(tokens.encode(pa.array(texts), path, spaced)) == want
    end = library.token_to_id("<|endoftext|>")
    assert end in want[0] and end in want[1] and end not in want[3]
    if not spaced:
        docs = spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], SCHEMA)
        assert {r.doc_id: r.doc_tokens for r in packing.pack(docs, path).collect()} == {k: len(x) + 1 for k, x in enumerate(want)}


def test_packing_limits_loss(spark):
    """Prompts bear no loss; the limit is the documents' own share, so sequences of answers alone are not full."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, ("ask " * (k % 50)).strip() + "\n" * (k % 3 > 0) + "tell " * (100 - k % 50), "", "") for k in range(3000)] + [(None, None, "", ""), (5, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2).cache()
    limit = packing.loss_limit(docs)
    assert 0.5 * 2048 < limit < 2048 and packing.loss_limit(docs.limit(0)) == 2048
    by = {}
    for r in packing.pack(docs, path, loss=limit, share=packing.loss_share(F.col("text"))).collect():
        by.setdefault(r.sequence_id, []).append((r.length, r.loss_tokens))
    assert max(sum(n for _, n in x) for x in by.values()) <= limit + 16 and max(sum(n for n, _ in x) for x in by.values()) <= 2048
    lengths = [sum(n for n, _ in x) for x in by.values()]
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths) < 0.02 * sum(lengths)
    assert sum(n for x in by.values() for _, n in x) < 0.9 * sum(lengths)


def test_packing_keeps_three_limits():
    p = packing.Packer(64, 4, 40)
    for k in range(300):
        p.add(k, bytes(4 * (1 + k * 7 % 90)), (k % 3) / 2)
    p.finish()
    by = {}
    for doc, at, ids, total, share, sequence, offset in p.out:
        by.setdefault(sequence, []).append((len(ids) // 4, share))
    for pieces in by.values():
        assert sum(n for n, _ in pieces) <= 64 and len(pieces) <= 4 and sum(n * s for n, s in pieces) <= 40.5
    assert sum(n for x in by.values() for n, _ in x) == sum(1 + k * 7 % 90 for k in range(300))


def test_suffix_dedup(nasty, none):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove(nasty).collect()}
    n = len(LONG)
    assert {(1, 0, 0, 0), (2, 0, 0, 0), (4, n, n, 1), (5, n, n, 1)} <= got and len(suffix_dedup.remove(nasty).collect()) == len(ROWS)
    assert suffix_dedup.remove(none).count() == 0


def test_suffix_dedup_knows_rows_without_ids(spark, monkeypatch):
    """Null and shared doc_ids are rows like others; a task that meets a record again settles both places."""
    monkeypatch.setattr(common, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(12)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    part, whole, short = word(500), word(900), word(300)
    rows = [(None, word(40) + part), (None, part + word(30)), (7, word(10) + part), (7, word(600)), (8, whole), (8, whole), (None, whole), (9, word(700)), (None, None), (10, word(20) + short), (11, short + word(400))]
    docs = spark.createDataFrame([(k, t, "", "") for k, t in rows], SCHEMA).repartition(2)
    want = sorted((k is not None, k or 0, len(t or ""), 500 if t and part in t else 900 if t == whole else 0) for k, t in rows)
    got = suffix_dedup.remove(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == want
    assert {(r.doc_id, r.n_bytes) for r in got if r.n_repeats == 0} == {(7, 600), (9, 700), (None, 0)}


def test_suffix_dedup_within_a_text(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    part, other = word(700), word(399)
    texts = [word(90) + part + word(800) + part[100:650] + word(50), other + word(10) + other, "ab" * 500, word(50) + part[300:] + word(5)]
    df = spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], SCHEMA)
    seen = {}
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    for r in suffix_dedup.remove(df).collect():
        t = texts[r.doc_id]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert bytes(r.kept) == "".join(c for c, g in zip(t, gone) if not g).encode()


def test_suffix_dedup_splits_hot_cores(spark):
    """Many near copies, unlike in every place, and passages that most of them share: brute force, however they are dealt."""
    rng = np.random.default_rng(31)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    base, part, texts = word(1600), word(450), []
    for k in range(150):
        x = list(base)
        for at in rng.integers(0, len(x), k % 7):
            x[at] = "#"
        texts.append(word(int(rng.integers(0, 90))) + "".join(x)[int(rng.integers(0, 200)) :] + (part if k % 3 else word(20)) + word(30))
    texts += [word(300) + part, base[700:1150], word(500)]
    seen = {}
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    # one partition has a core often, others once or not at all
    df = spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], SCHEMA).repartitionByRange(5, F.greatest("doc_id", F.lit(60)))
    for tasks in (1, 7):
        found = suffix_dedup.repeated_anchors(suffix_dedup.keyed(df), tasks).where("places is not null").collect()
        hot = [np.frombuffer(r.places, suffix_dedup.PLACE)["hot"] for r in found]
        assert any(h.any() for h in hot) and not all(h.all() for h in hot)
    for r in suffix_dedup.remove(df).collect():
        t = texts[r.doc_id]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert bytes(r.kept) == "".join(c for c, g in zip(t, gone) if not g).encode()


def test_loser_tree_merges():
    rng = np.random.default_rng(3)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(n)) for n in (5, 0, 9, 1, 7)]
    runs = [[x for x in r if x] for r in runs]
    got = suffix_dedup.merge([suffix_dedup.front_code(r) for r in runs])
    merged = [runs[r][p] for r, p, _ in got]
    assert merged == sorted(x for r in runs for x in r)
    assert [n for *_, n in got] == [0, *(suffix_dedup.shared_prefix(a, b) for a, b in zip(merged, merged[1:]))]


def test_quality(spark, nasty, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (6, 1), (6, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    w = quality.fit(nasty, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(nasty, w).collect()) and quality.score(nasty, w).count() == len(ROWS)
    assert quality.score(none, w).count() == 0 and quality.fit(none, labels).sum() == 0


def test_pii(nasty, none):
    got = pii.digests(pii.spans(nasty)).collect()
    assert len(got) == len(ROWS) and {r.spans for r in got if r.doc_id in (1, 2)} == {""} and pii.spans(none).count() == 0
    assert pii.redact(nasty.withColumn("text", F.lit("write a@b.cd now"))).first().text == "write [EMAIL] now"


def test_token_store(spark, nasty, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    here = f"{common.work_dir(spark)}/edge-{uuid.uuid4().hex}"
    for df, n in ((nasty, len(ROWS)), (none, 0)):
        folder = f"{here}-{n}"
        token_store.write(df, folder, path)
        rows = token_store.read(spark, folder).orderBy("start").collect()
        assert len(rows) == n and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    folder = f"{here}-{len(ROWS)}"
    got = {r.doc_id: len(r.ids) // 4 for r in token_store.lookup(spark, folder, spark.createDataFrame([(1,), (7,), (12345,), (None,)], "doc_id long")).collect()}
    assert set(got) == {1, 7} and got[1] == 1
    assert token_store.lookup(spark, f"{here}-0", spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_token_store_looks_up_by_segment(spark, monkeypatch):
    """Many segments and files: every key is found in its own, whatever the limits of the index."""
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"{common.work_dir(spark)}/edge-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(3 * k, f"text number {k} " * (k % 9), "", "") for k in range(900)], SCHEMA)
    monkeypatch.setattr(token_store, "SEGMENT_BYTES", 1000)
    monkeypatch.setattr(token_store, "FILE_SEGMENTS", 3)
    token_store.write(docs, folder, path)
    stored = {r.doc_id: r.ids for r in token_store.read(spark, folder).collect()}
    heads = token_store.index(spark, folder).collect()
    assert len(stored) == 900 and len(heads) > 30 and len({r.path for r in heads}) > 10
    asked = spark.createDataFrame([(k,) for k in [*range(0, 2710, 5), 0, 0]], "doc_id long")
    want = {k: stored[k] for k in range(0, 2700, 15)}
    for rows, files in ((500_000, 10_000), (7, 10_000), (7, 1)):
        monkeypatch.setattr(token_store, "INDEX_ROWS", rows)
        monkeypatch.setattr(token_store, "NAMED_FILES", files)
        got = token_store.lookup(spark, folder, asked).collect()
        assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(4).integers(0, 2**63, 3000).astype(np.uint64))
    made = token_store.PerfectHash.load(token_store.PerfectHash.of(keys).dump())
    assert sorted(made.slots(keys)) == list(range(len(keys)))


def test_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 3.0], 1), (8, [float("nan"), 2.0, 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1), (10, [-1.0, -2.0, -3.0], 1), (11, v, 2), (12, [], 1), (13, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)}
    assert all(got[k] == (0, k, True) for k in range(4, 14))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_tiles_find_every_pair(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (60, 16))
    x = np.concatenate([x, x[:20] + rng.normal(0, 0.14, (20, 16))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98)) if i < j}
    df = spark.createDataFrame([(k, r.tolist(), 0) for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, block=9).collect()}
    assert got == {k: sum(k in p for p in want) for k in range(len(x))} and want


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}
