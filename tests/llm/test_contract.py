"""The operators' queries over the smallest tables: against their SQL, or against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import queries as q
from tests.conftest import DATA, same_rows


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(q.QUERIES[name](spark, DATA), duck, q.ORACLES[name])


def test_suffix_dedup_is_brute_force(spark, docs):
    raw = [(k, t.encode()) for k, t in docs]
    seen = Counter(x[i : i + 400] for _, x in raw for i in range(len(x) - 399))
    want = []
    for k, x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        want.append((k, len(x), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(x) else 0, hashlib.sha256(kept).hexdigest()))
    got = sorted(map(tuple, q.op6_suffix_dedup(spark, DATA).collect()))
    assert [r[:5] for r in got] == want and any(r[2] for r in want)
    short, shorter = (Counter(y for _, x in raw for y in {(x[i : i + n], i) for i in range(len(x) - n + 1)} for y in [y[0]]) for n in (255, 128))
    for (_, x), r in zip(raw, got, strict=True):
        assert r[5] > 0 or all(short[x[i : i + 255]] == 1 for i in range(len(x) - 254))
        assert r[5] == 0 or any(shorter[x[i : i + 128]] > 1 for i in range(len(x) - 127))


def encoded(docs, name, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: np.array(library.encode(t, add_special_tokens=False).ids + [end], "<u4") for k, t in docs}


def test_token_store_round_trip(spark, docs):
    at, want = 0, []
    for k, ids in encoded(docs, "byte_bpe_50k.json", 0).items():
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, q.op9_token_store(spark, DATA).collect())) == want


def test_packing_is_whole_and_tight(spark, docs):
    ids = encoded(docs, "word_bpe_49k.json", 1)
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in q.op5_packing(spark, DATA).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
    for pieces in (*sequences.values(), *parts.values()):
        assert [a for a, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1]]
    assert {k: sum(n for _, n in p) for k, p in parts.items()} == {k: len(x) for k, x in ids.items()}
    lengths = [sum(n for _, n in p) for p in sequences.values()]
    assert max(lengths) <= 2048 and max(map(len, sequences.values())) <= 256
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths) < 0.02 * sum(lengths)


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = q.op7_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_is_the_plain_loops():
    """Training and scoring against loops over dicts, one feature at a time."""
    import math

    import pyarrow as pa

    from tapeloom.llm import quality

    texts = ["Good plain words follow here.", "BUY NOW!!! $$$ 77 77", "More words, and more of them.", "WIN 9 9 9 !!!", "", "Plain again: words."]
    labels = [1.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    rows = [(dict(zip(i.tolist(), v.tolist(), strict=True)), y) for (i, v), y in zip(quality.vectors(batch), labels, strict=True)]
    z, n, bias = {}, {}, 2**quality.BITS

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))

    for _ in range(quality.PASSES):
        for x, y in rows:
            x = {**x, bias: 1.0}
            error, old = (chance(x) - y) * len(rows) / 2 / labels.count(y), {i: weight(i) for i in x}
            for i, v in x.items():
                g = error * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * old[i]
                n[i] = n.get(i, 0.0) + g * g
    w = quality.train([(i, v, y) for (i, v), y in zip(quality.vectors(batch), labels, strict=True)])
    assert all(abs(w[i] - weight(i)) < 1e-5 for i in z) and np.count_nonzero(w) == sum(weight(i) != 0 for i in z)
    assert quality.scores(batch, w) == pytest.approx([chance({**x, bias: 1.0}) for x, _ in rows], abs=1e-5)


def slow_pii(text):
    import re

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return [(k, *m.span()) for k, (pattern, good) in kinds.items() for m in re.finditer(pattern, text) if good(m[0])]


def test_pii_is_the_plain_patterns(spark, docs):
    want = {}
    for k, t in docs:
        found = slow_pii(t)
        want[k] = (*(sum(x[0] == kind for x in found) for kind in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in found).encode()).hexdigest())
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in q.op8_pii(spark, DATA).collect()}
    assert got == want and any(sum(x[:4]) for x in want.values())


@pytest.mark.parametrize(
    "text",
    ["a@b.c@d.e", "x.@y", "@@a@b-c.d.e.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (555) 010-9999 +12 +1234567890123456", "GB82 WEST 1234 5698 7654 32", ""],
)
def test_pii_edges(text):
    from tapeloom.llm import pii

    assert [x for x in pii.find(text) if x[0] in pii.BASE] == slow_pii(text)


def test_pii_adds_checked_spans():
    from tapeloom.llm import pii

    assert [x[0] for x in pii.find("account GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert pii.find("account GB83 WEST 1234 5698 7654 32") == []
    text = "write to a@b.cd"
    assert pii.score(text, *pii.find(text)[0]) == 1.0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"]),
        ("pay GB82 WEST 1234 5698 7654 32 EUR 500", ["GB82 WEST 1234 5698 7654 32"]),
        ("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 EUR", ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]),
        ("AB12 CDEF 3456 DE89370400440532013000", ["DE89370400440532013000"]),
        ("NO9386011117947 KONTO 7", ["NO9386011117947"]),
        ("DE89370400440532013000x DE89370400440532013000" + "7" * 20, []),
        ("xDE89370400440532013000 GB83 WEST 1234 5698 7654 32 EUR 500", []),
    ],
)
def test_pii_finds_ibans_before_other_words(text, want):
    from tapeloom.llm import pii

    assert [text[a:b] for k, a, b in pii.find(text) if k == "iban"] == want


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(c.STAGES):
        after = stage(spark, docs, DATA)
        if k < len(c.STAGES) - 1:
            assert after.columns == docs.columns
            after = after.persist()
            before, ids = docs, {r.doc_id for r in after.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and after.count() == len(ids)
            if stage is c.distinct:
                sets = {}
                for r in before.collect():
                    w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r.text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
                    w = [x for x in w if x]
                    sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
                near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
                top = {a: a for a in sets}
                changed = True
                while changed:
                    changed = False
                    for a in sets:
                        for b in sets:
                            if a < b and top[a] != top[b] and near(a, b):
                                low, high = sorted((top[a], top[b]))
                                top = {x: low if t == high else t for x, t in top.items()}
                                changed = True
                assert ids == {a for a in sets if top[a] == a}
            docs = after
        else:
            pieces = after.collect()
            assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_few_hashes_pass_the_filter(spark):
    """Of all shingles' hashes at most one in twenty is sent to meet the sketches, and none of the sketches' own is lost."""
    from tapeloom.llm import decontamination as dc

    docs, items = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "benchmark"))
    found = dc.materialize(dc.sketches(items).distinct())
    bands = found.groupBy("band_least").agg(F.max("h").alias("highest"), F.count("*").alias("n")).collect()
    planned = dc.near(docs.where("doc_id is not null"), found, bands)
    sent = dc.materialize(planned)
    every = dc.materialize(dc.split(docs, "doc_id").select("doc_id", dc.shingles(F.col("w"), dc.hashed).alias("hs")))
    every = every.select("doc_id", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    assert sent.count() * 20 <= every.count()
    meets = every.where("doc_id is not null").join(found, "h").where("size >= band_least")
    assert meets.count() and not meets.join(sent, ["doc_id", "h"], "left_anti").count()
    plan = planned._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
