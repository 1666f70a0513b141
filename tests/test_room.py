"""What a job leaves on disk while it runs: shuffle files, tables, and the state of streams."""

import random
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom import signal_queries as sq
from tapeloom import stream_queries
from tapeloom.operators import beta, candles, model, series, signals
from tapeloom.paths import drop_table, materialize, work_dir
from tapeloom.streaming import jobs, stateful
from tests.conftest import DATA
from tests.test_stream_costs import Handle, Store


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def left(spark, was: set[str]) -> set[str]:
    """New shuffle files, once Spark has had the time to delete those that nobody needs."""
    until = time.time() + 20
    while (now := shuffle_files(spark) - was) and time.time() < until:
        time.sleep(0.2)
    return now


def odd_trades(spark):
    r, rows = random.Random(3), []
    for k, n in enumerate([1, 4, 60, 75, 130, 130, 200, 300]):
        at = 0
        for j in range(n):
            at += r.choice([0, 1, 1, 2])
            price = None if k == 5 and j % 40 == 39 else float("nan") if k == 4 and j == 70 else r.choice([50.0, r.uniform(1, 1000)])
            rows.append((None if k == 3 else f"S{k}", at, price, None if k == 6 and j == 7 else float(r.randrange(1, 9)), r.randrange(3), j))
    df = spark.createDataFrame(rows, "symbol string, hour long, price double, volume double, a long, b long")
    return df.select("symbol", F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), "price", "volume", F.struct("a", "b").alias("seq"))


def test_stored_bars_give_the_same_values(spark, monkeypatch):
    """Values of later bars, and those that a model learns from, made out of a table of bars: as in one pass over the trades."""
    monkeypatch.setattr(series, "BUCKET_ROWS", 300)
    monkeypatch.setattr(series, "ROWS", 150)
    trades = odd_trades(spark)
    index = materialize(beta.market_returns(candles.closes(trades, "H1")))
    names = ["high", "low", "close", "volume", "beta", *sq.FEATURES]
    plain = materialize(series.with_indicators(trades, "H1", names, index, sq.FEATURES, ahead=model.HORIZON))
    parts = model.split_by_time(model.with_label(plain))
    bars, table = series.stored_bars(trades, "H1")
    cut = model.cut_of(bars).first()[0]
    of = lambda later: series.of_stored_bars(bars, names, index, sq.FEATURES, cut, model.HORIZON, later)
    key = lambda df, *more: sorted(str(tuple(r)) for r in df.select("symbol", "start_time", *names, "is_valid", *more).collect())
    later = of(True).cache()
    want = parts.where("part = 'train' and is_valid and label is not null")
    assert key(later.where("n_earlier is null")) == key(parts.where("part = 'test'")) and later.where("n_earlier is null and beta is not null").count() > 20
    assert later.agg(F.sum("n_earlier")).first()[0] == want.count() > 50
    assert key(model.with_label(of(False)), "label") == key(want, "label")
    for df in (of(True), of(False)):  # the bars are read whole and in order as they lie
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Bucketed: true" in plan
    assert bars.where("high is null").count() > bars.count() / 2
    drop_table(spark, table)


def test_a_table_leaves_no_shuffle_files(spark):
    was = shuffle_files(spark)
    got = materialize(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert sum(r["count"] for r in got.collect()) == 1000 and not left(spark, was)


def test_a_fit_leaves_no_files(spark):
    """A model has no summary, which would keep the training rows' exchange for as long as there is the model, and rows that don't
    fit into memory are not written a second time."""
    rows = materialize(spark.range(3000).selectExpr("concat('S', id % 7) symbol", "timestamp_seconds(id * 3600) start_time", "double(id % 3) label", "double(id * 7919 % 101) x"))
    was, fit, levels = shuffle_files(spark), model.Pipeline.fit, []
    try:
        model.Pipeline.fit = lambda self, df: (levels.append(df.storageLevel.useDisk), fit(self, df))[1]
        forest = model.train(rows, ["x"], trees=3, depth=3, stored=True)
    finally:
        model.Pipeline.fit = fit
    assert levels == [False] and not forest.stages[-1].hasSummary
    assert not left(spark, was)
    counted = model.train(rows, ["x"], trees=3, depth=3, n=3000)
    assert len({f.stages[-1].toDebugString.split("\n", 1)[1] for f in (forest, counted)}) == 1


def test_only_later_bars_are_kept(spark):
    """The bars that a model learns from are made for it and not kept: the table has the later ones."""
    df = sq._signal_bars(spark, DATA)
    table = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in df.inputFiles()})
    n = sq.tables.heavy_trades(spark, DATA).count()
    assert df.count() == table.where("symbol is not null").count() < 0.25 * n
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bars_")]


def test_life_cycle_is_that_of_the_frames(spark):
    r, rows = random.Random(8), []
    for s in [*"ABCDEFG", None]:
        for k in range(r.choice([1, 40, 300])):
            some = lambda x: r.choice([x, x, x, None, float("nan")])
            rows.append((s, 3600 * k, some(r.uniform(92.5, 99)), some(r.uniform(99, 109)), r.choice([True, True, False, None]), r.choice([True, True, None]), some(r.choice([0.5, 0.8])), 93.0, some(108.0)))
    bars = spark.createDataFrame(rows, "symbol string, s long, low double, high double, is_valid boolean, passes boolean, score double, stop_loss double, take_profit double").withColumn("start_time", F.timestamp_seconds("s"))
    want = [tuple(x) for _, own in bars.fillna(False, ["is_valid", "passes"]).toPandas().groupby("symbol", dropna=False) for x in signals.life_frame(own, 0.75, 2).itertuples(index=False)]
    got = signals.life_cycle(bars, 0.75, 2).collect()
    assert sorted((str(x.symbol), str(x.start_time), x.state, str(x.event)) for x in got) == sorted((str(None if x[0] != x[0] else x[0]), str(x[1]), x[2], str(x[3])) for x in want)
    assert {x.event for x in got} == {None, "ENTRY", "STOP_LOSS", "TAKE_PROFIT", "INVALIDATED"}


def names_in(spark, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in (fs.listStatus(folder) if fs.exists(folder) else ())]


def test_a_stream_leaves_little(spark):
    """Its batches' shuffle files go, and of its checkpoint what the last batches need is kept."""
    path, was = f"{work_dir(spark)}/test-{uuid.uuid4().hex}", shuffle_files(spark)
    rows = spark.range(900).select((F.col("id") % 7).cast("string").alias("symbol"), "id")
    jobs.store_in_order(rows, f"{path}/tape", 9, "id")
    retained = spark.conf.get("spark.sql.streaming.minBatchesToRetain")
    jobs.run(jobs.read_tape(spark, f"{path}/tape", rows.schema).groupBy("symbol").count(), path, lambda b, k: jobs.replace_batch(b, k, f"{path}/rows"), "update")
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == retained and not left(spark, was)
    assert len([n for n in names_in(spark, f"{path}/checkpoint/offsets") if n.isdigit()]) <= jobs.KEPT_BATCHES + 1
    assert sum(r["count"] for r in jobs.newest(jobs.read_batches(spark, f"{path}/rows", spark.createDataFrame([], "symbol string, count long").schema), "symbol").collect()) == 900


class Waits(Store):
    """A list state."""

    def appendValue(self, v):
        self._ask()
        self.rows[len(self.rows)] = v

    def get(self):
        self._ask()
        return iter(list(self.rows.values()))


class Shares(Handle):
    def getListState(self, name, *_):
        return self.made.setdefault(name, Waits())

    def getMapState(self, name, *_, **__):
        return super().getMapState(name)

    def registerTimer(self, at):
        self.made.setdefault("timers", set()).add(at)


@pytest.mark.parametrize("entry", [10_000, 7])
def test_a_share_asks_seldom(monkeypatch, entry):
    """Many symbols' bars wait in few entries, idle symbols have no state, and what is let out are the bars that are due, in order."""
    monkeypatch.setattr(stateful, "ENTRY_ROWS", entry)
    handle, got, hour = Shares(), [], 3_600_000_000
    bars = [(f"S{s}", k * hour, 9.0 - k, 11.0 + k, True, s < 3, 0.9, 8.5, 99.0, False) for k in range(4) for s in range(200)]
    frame = pd.DataFrame(bars, columns="symbol us low high is_valid passes score stop_loss take_profit ends".split())

    def life():
        now = stateful.LifeCycle(0.75, 3)
        now.init(handle)
        return now

    marks = type("Marks", (), {"getCurrentWatermarkInMs": lambda self: 2 * hour // 1000})()
    for out in life().handleInputRows((1,), iter([frame.sample(frac=1, random_state=1)]), None):
        got.append(out)
    assert not got and handle.made["timers"] == {0} and handle.made["waiting"].asked == -(-800 // entry)
    got = list(life().handleExpiredTimer((1,), marks, None))
    assert [len(x) for x in got] == [600] and handle.made["timers"] == {0, 3 * hour // 1000}
    assert {k[0] for k in handle.made["life"].rows} == {"S0", "S1", "S2"} and handle.made["life"].asked == 4
    last = frame[:200].assign(us=9 * hour, ends=[True] * 150 + [False] * 50)
    got += list(life().handleInputRows((1,), iter([last]), None))
    assert len(got[1]) == 150 and sum(len(x[0]) for x in handle.made["waiting"].rows.values()) == 100
    events = pd.concat(got).dropna(subset=["event"])
    assert [(r.symbol, r.event, r.start_time.hour) for r in events.sort_values(["symbol", "start_time"]).itertuples()] == [(f"S{s}", e, h) for s in range(3) for e, h in (("ENTRY", 0), ("STOP_LOSS", 1))]


def test_a_stream_of_life_keeps_no_features(spark, monkeypatch):
    """The scored bars' table goes when the columns that the stream reads have been taken from it."""
    stateful.use_rocksdb(spark)
    bars = spark.range(240).selectExpr("concat('S', id % 6) symbol", "timestamp_seconds(1725300000 + id div 6 * 3600) start_time", "95.0 + id * 7919 % 5 low", "101.0 + id * 104729 % 9 high", "id % 31 <> 0 is_valid", "id % 3 <> 0 passes", "0.5 + id % 2 * 0.4 score", "96.0D stop_loss", "108.0D take_profit", "1 more")
    bars = bars.selectExpr("symbol", "start_time", "double(low) low", "double(high) high", "is_valid", "passes", "double(score) score", "stop_loss", "take_profit", "more")
    want = signals.life_cycle(bars).collect()
    table = materialize(bars)
    monkeypatch.setattr(stream_queries, "_signal_bars", lambda *_: table)
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    got = stream_queries.stream_life_cycle(spark, DATA).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({x.event for x in got}) > 3
    assert not names_in(spark, folder)
