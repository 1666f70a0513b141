"""Operator 2 where one text has many copies and a family many sizes: what travels, and what comes of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import common, ngram_join

TEXTS = [" ".join(f"w{(k * j) % 997}" for k in range(900)) for j in (3, 7)]


def bucket_bytes(spark, copies):
    docs = spark.createDataFrame([(10 * k + j, t) for k in range(copies) for j, t in enumerate(TEXTS)], "doc_id long, text string").repartition(8)
    named = common.materialize(ngram_join.entities(docs))
    few, first = ngram_join.once(docs, named)
    cut = ngram_join.pieces(few, 4, first)
    return sorted(r.n for r in cut.groupBy("bucket").agg(F.sum(F.octet_length("tokens")).alias("n")).collect())


def test_buckets_do_not_grow_with_copies(spark):
    assert bucket_bytes(spark, 4) == bucket_bytes(spark, 32) == bucket_bytes(spark, 128)


@pytest.mark.parametrize("broadcast", [1 << 22, 0])
def test_copies_are_found_either_way(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ngram_join.once, "__defaults__", (broadcast,))
    near = TEXTS[0].replace("w3 ", "x3 ", 1)
    rows = [(30, TEXTS[0]), (20, TEXTS[0].upper()), (20, TEXTS[1]), (40, TEXTS[1]), (None, TEXTS[0]), (None, "no other text is like this one at all"), (50, near), (60, "a text of its own that nobody has copied")]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(30, 20), (20, 20), (20, 20), (40, 20), (None, 20), (None, None), (50, 20), (60, 60)], key=str)


def test_families_are_cut_by_size(spark):
    """Prefixes of one text, from short to long: a chain of links through all sizes, whatever the blocks."""
    words = [f"u{k}" for k in range(420)]
    rows = [(k, " ".join(words[: 20 + 2 * k])) for k in range(200)] + [(1000 + k, " ".join(words[: 20 + 2 * k][::-1])) for k in range(0, 200, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = common.materialize(ngram_join.candidates(ngram_join.shared_shingles(ngram_join.pieces(docs, 3), 3), 3))
    whole, cut = (sorted(map(tuple, common.connected_components(ngram_join.linked(found, block)).collect())) for block in (1000, 16))
    assert whole == cut and len(whole) == 200
    sets = {k: set(ngram_join.shingle_sets(np.array([0, len(t)]), np.frombuffer(t.encode(), np.uint8))[0].tolist()) for k, t in rows}
    reach = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and reach[a] != reach[b]:
                low, high = sorted((reach[a], reach[b]))
                reach = {k: low if v == high else v for k, v in reach.items()}
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == set(reach.items())
