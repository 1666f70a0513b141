"""The token store's files: one pass, tasks by bytes, lookups that read the segments asked for, repeated keys over segments."""

import uuid

import public_tokenizers
import pytest

from tapeloom.llm import common, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


def stored(spark, rows, **limits):
    folder = f"{common.work_dir(spark)}/store-{uuid.uuid4().hex}"
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH)
    return folder


@pytest.mark.parametrize("slice_", [500_000, 2, 1])
def test_repeated_keys_over_segments_are_answered_once(spark, monkeypatch, slice_):
    monkeypatch.setattr(token_store, "SEGMENT_BYTES", 100)
    rows = [(k, f"first of {k} " * 5) for k in range(20)] + [(7, f"again seven number {j} " * 6) for j in range(30)]
    folder = stored(spark, rows)
    heads = token_store.index(spark, folder).orderBy("place").collect()
    assert [r.place for r in heads] == list(range(len(heads))) and sum(r.low == r.high == 7 for r in heads) > 3
    monkeypatch.setattr(token_store, "INDEX_ROWS", slice_)
    got = token_store.lookup(spark, folder, spark.createDataFrame([(7,), (8,), (99,)], "doc_id long")).collect()
    first = {}
    for r in token_store.read(spark, folder).orderBy("start").collect():
        first.setdefault(r.doc_id, bytes(r.ids))
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == [(k, first[k]) for k in (7, 8)]


def test_index_names_the_files(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_BYTES", 400)
    folder = stored(spark, [(k, f"text {k} " * 20) for k in range(200)])
    named = {r.path for r in token_store.index(spark, folder).collect()}
    files = {r.path for r in token_store._files(spark, folder).select("path").collect()}
    assert named == files and len(files) > 20
    one = token_store.lookup(spark, folder, spark.createDataFrame([(77,)], "doc_id long"))
    assert one.count() == 1 and len(one.inputFiles()) == 1


def test_tasks_follow_the_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = common.partitions(spark)
    assert common.file_tasks(docs) == few and common.file_tasks(docs, 20_000) > 10 * few
    assert common.file_tasks(docs.limit(0)) == few and common.file_tasks(spark.createDataFrame([(1, "a")], "doc_id long, text string")) == few
