"""Walks whose every step depends on the one before, cut within a key, so that one feed is not one task.

A key's rows are cut into stretches of their order. Each stretch is walked at once with the others, from a guess: the state
that the stretch before it leaves behind when it is walked from nothing. Where the guess is the state that the stretch
before really ended with, its rows stand. The others are walked again from that end, and so on until every stretch began
where the one before it ended; the first stretch begins with nothing, so then all are what one walk from the start gives. A
walk that forgets soon, as one of bounded memory does, needs a round or two; one that never forgets needs as many as there
are stretches, and is right all the same. A stretch is one task's, batch by batch, with the walk's state in memory.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..paths import materialize

OUT = "seq bigint, outcome string, release_seq bigint"


class Walk:
    """What is walked: begins from a state (nothing: None), takes rows in order, says what came of each, tells its state."""

    def row(self, seq: int, value) -> list[tuple[int, str, int | None]]:
        raise NotImplementedError

    def state(self) -> bytes:
        """Equal for walks that go on alike."""
        raise NotImplementedError

    def end(self) -> list[tuple[int, str, int | None]]:
        return []


_STATE, _BEFORE, _OWN = 0, 1, 2


def walked(rows: DataFrame, key: str, chunk: int, begin: Callable[[bytes | None], Walk]) -> DataFrame:
    """(key, seq, outcome, release_seq) of rows(key, seq, value) as one walk over each key's rows by seq gives them; stretches are
    multiples of chunk in seq."""
    rows = materialize(rows.withColumn("segment", F.floor(F.col("seq") / chunk)))
    order = Window.partitionBy(key).orderBy("segment")
    segments = materialize(rows.select(key, "segment").distinct().withColumns({"after": F.lead("segment").over(order), "before": F.lag("segment").over(order)}))
    same = lambda a, b: a[key].eqNullSafe(b[key])
    kind = rows.schema["value"].dataType.simpleString()
    fields = f"{key} {rows.schema[key].dataType.simpleString()}, segment bigint, {OUT}, start binary, finish binary"
    names = [f.split()[0] for f in fields.split(", ")]
    columns = [key, "segment", "kind", "seq", "value", "state", "last"]

    def walk(batches):
        at, now, start, last = None, None, None, False

        def close():
            return ([(*at, *x, None, None) for x in now.end()] if last else []) + [(*at, None, None, None, start, now.state())]

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            types[0] = batch.schema.field(0).type
            for k, segment, what, seq, value, state, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (k, segment):
                    out += close() if at else []
                    at, now, start, last = (k, segment), begin(state if what == _STATE else None), None, final
                if what == _BEFORE:
                    now.row(seq, value)
                elif what == _OWN or what == _STATE:
                    if start is None:
                        start = now.state()
                    out += [(k, segment, *x, None, None) for x in now.row(seq, value)] if what == _OWN else []
            yield table(out)
        if at:
            yield table(close())

    def run(parts: DataFrame) -> DataFrame:
        last = segments.select(F.col(key).alias("_k"), F.col("segment").alias("_s"), F.col("after").isNull().alias("last"))
        marked = parts.join(last, parts[key].eqNullSafe(last["_k"]) & (parts["segment"] == last["_s"])).select(*columns)
        return materialize(marked.repartition(key, "segment").sortWithinPartitions(key, "segment", "kind", "seq").mapInArrow(walk, fields))

    nothing = [F.lit(None).cast("binary").alias("state")]
    own = rows.select(key, "segment", F.lit(_OWN).alias("kind"), "seq", "value", *nothing)
    follow = segments.where("after is not null").select(F.col(key).alias("_k"), F.col("segment").alias("_s"), "after")
    warm = rows.join(follow, rows[key].eqNullSafe(follow["_k"]) & (rows["segment"] == follow["_s"])).select(key, F.col("after").alias("segment"), F.lit(_BEFORE).alias("kind"), "seq", "value", *nothing)
    rounds = [run(own.unionByName(warm))]
    valid = rounds[0].where("finish is not null").select(key, "segment", "start", "finish", F.lit(0).alias("round"))  # a row a stretch
    while True:
        ends = valid.select(F.col(key).alias("_k"), F.col("segment").alias("_s"), F.col("finish").alias("found"))
        links = valid.join(segments.where("before is not null").select(F.col(key).alias("_k2"), F.col("segment").alias("_s2"), "before"), valid[key].eqNullSafe(F.col("_k2")) & (valid["segment"] == F.col("_s2")))
        wrong = links.join(ends, links[key].eqNullSafe(ends["_k"]) & (links["before"] == ends["_s"])).where("start != found").select(key, "segment", "found")
        wrong = materialize(wrong)
        if wrong.isEmpty():
            break
        again = rows.join(wrong.select(F.col(key).alias("_k"), F.col("segment").alias("_s")), rows[key].eqNullSafe(F.col("_k")) & (rows["segment"] == F.col("_s")), "left_semi").select(key, "segment", F.lit(_OWN).alias("kind"), "seq", "value", *nothing)
        state = wrong.select(key, "segment", F.lit(_STATE).alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast(kind).alias("value"), F.col("found").alias("state"))
        rounds.append(run(again.unionByName(state)))
        fresh = rounds[-1].where("finish is not null").select(key, "segment", "start", "finish", F.lit(len(rounds) - 1).alias("round"))
        stays = valid.join(wrong.select(F.col(key).alias("_k"), F.col("segment").alias("_s")), valid[key].eqNullSafe(F.col("_k")) & (valid["segment"] == F.col("_s")), "left_anti")
        valid = materialize(stays.unionByName(fresh))
    which = valid.select(F.col(key).alias("_k"), F.col("segment").alias("_s"), F.col("round").alias("_r"))
    every = reduce(DataFrame.unionByName, (r.where("finish is null").withColumn("round", F.lit(k)) for k, r in enumerate(rounds)))
    return every.join(which, every[key].eqNullSafe(which["_k"]) & (every["segment"] == which["_s"]) & (every["round"] == which["_r"])).select(key, "seq", "outcome", "release_seq")
