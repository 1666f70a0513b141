"""Gates, life cycle and alerts of the registered queries against plain loops."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from tapeloom import signal_queries as sq
from tapeloom.market_queries import QUERIES
from tests.conftest import DATA


def blocked(r):
    minute = (r.us // 60_000_000 + 7 * 60) % 1440
    if r.is_stale is not False:
        return "stale_data"
    if not r.is_valid:
        return "missing_indicator"
    if r.std_20 is None or r.std_20 > 0.05:
        return "volatility"
    if r.spread is not None and r.spread > 0.02:
        return "spread"
    return None if 540 <= minute < 690 or 780 <= minute < 870 else "session"


def test_signals_are_the_plain_loops(spark, monkeypatch):
    bars = sq._signal_bars(spark, DATA).withColumn("us", F.unix_micros("start_time")).orderBy("symbol", "start_time").collect()
    fixed = spark.createDataFrame(bars, sq._signal_bars(spark, DATA).withColumn("us", F.lit(0).cast("long")).schema)
    monkeypatch.setattr(sq, "_signal_bars", lambda *_: fixed)
    gates, states, events, state, last, sent = {}, [], [], {}, {}, []
    for r in bars:
        why = blocked(r)
        gates[why] = gates.get(why, 0) + 1
        now, left, stop, target = state.get(r.symbol, ("IDLE", 0, None, None))
        event = None
        if now == "ENTRY":
            event = "STOP_LOSS" if r.low <= stop else "TAKE_PROFIT" if r.high >= target else None if r.is_valid else "INVALIDATED"
            now, left = ("COOLDOWN", 3) if event else (now, left)
        elif now == "COOLDOWN":
            left -= 1
            now = "COOLDOWN" if left else "IDLE"
        elif why is None and r.score is not None and r.score >= 0.75 and r.take_profit is not None:
            now, event, stop, target = "ENTRY", "ENTRY", r.stop_loss, r.take_profit
        state[r.symbol] = now, left, stop, target
        states.append((r.symbol, r.start_time, now, event))
        if event:
            before = last.get((r.symbol, event))
            go = before is None or r.start_time - before >= timedelta(minutes=60)
            last[r.symbol, event] = r.start_time if go else before
            sent.append((r.symbol, r.start_time, event, go))
    assert {r.blocked_by: r.n for r in QUERIES["risk_gates"](spark, DATA).collect()} == gates and {None, "session", "stale_data", "volatility"} <= set(gates)
    got = QUERIES["signal_life_cycle"](spark, DATA).collect()
    assert sorted(((r.symbol, r.start_time, r.state, r.event) for r in got), key=str) == sorted(states, key=str) and {r.model_version for r in got} == {"forest-1"}
    assert sorted((r.symbol, r.start_time, r.event, r.sent) for r in QUERIES["alerts"](spark, DATA).collect()) == sorted(sent)
    assert {x[2] for x in sent} >= {"ENTRY", "STOP_LOSS"}
    # the score is the forest's: it says nothing unless a rise is predicted for a whole row
    assert all((r.score is not None) == (r.is_valid and r.prediction == 2.0) for r in bars) and len({r.score for r in bars}) > 10
    print(gates, len(sent))


def test_model_and_stored_states(spark, tmp_path):
    """A forest learns a rule from the earlier bars, its confident scores keep to it, and states are stored with what an audit needs."""
    from tapeloom.operators import candles, latest, model
    from tapeloom.sources import sinks

    rows = [(f"S{k % 4}", 86400 * (k // 4), float(x := (k * 7919) % 101), 2.0 if x > 60 else 0.0 if x < 30 else 1.0) for k in range(800)]
    df = spark.createDataFrame(rows, "symbol string, s long, x double, label double").withColumn("start_time", F.timestamp_seconds("s"))
    parts = model.split_by_time(df)
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 620, "embargo": 20, "test": 160}
    forest = model.train(parts.where("part = 'train'"), ["x"], trees=5, depth=3)
    test = parts.where("part = 'test'")
    assert model.evaluate(forest, test) > 0.95
    scored = model.score(forest, test)
    sure = model.confident(scored)
    assert 0 < sure.count() <= 160 and sure.where("prediction != label").count() <= 2 and sure.where("score < 0.75").count() == 0
    tape = df.select("symbol", F.lit("trade").alias("kind"), F.monotonically_increasing_id().alias("seq"), F.col("start_time").alias("ts"), F.col("x").alias("price"), F.lit(1.0).alias("volume"), *(F.lit(None).cast("double").alias(c) for c in ("bid_price", "bid_vol", "ask_price", "ask_vol")))
    states = latest.snapshot(latest.mark_stale(tape))
    assert latest.symbol_count(states).first()[:] == (4, False) and latest.symbol_count(states.limit(0)).first()[:] == (0, True)
    assert candles.symbol_count(candles.candles(tape, "D1", mode="event")).first().n_symbols == 4
    sinks.write_states(states, str(tmp_path / "states"), "forest-1", "config-1", "2024-02-01 00:00:00")
    stored = spark.read.parquet(str(tmp_path / "states"))
    assert stored.count() == 4 and {tuple(map(str, r)) for r in stored.select("model_version", "config_version", "feature_timestamp").collect()} == {("forest-1", "config-1", "2024-02-01 00:00:00")}
    assert {r.total_volume for r in stored.collect()} == {200.0}


LAYOUTS = ({"spark.sql.shuffle.partitions": "4"}, {"spark.sql.shuffle.partitions": "9"}, {"spark.sql.shuffle.partitions": "8", "spark.sql.files.maxPartitionBytes": "200k", "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def test_forest_is_the_same_in_every_layout(spark):
    found = []
    for layout in LAYOUTS:
        was = {k: spark.conf.get(k) for k in layout}
        for k, v in layout.items():
            spark.conf.set(k, v)
        try:
            bars = sq._signal_bars(spark, DATA).select("symbol", "start_time", "prediction", "score", "blocked_by").collect()
            scores = QUERIES["model_scores"](spark, DATA).collect()
            alerts = QUERIES["alerts"](spark, DATA).collect()
        finally:
            for k, v in was.items():
                spark.conf.set(k, v)
        found.append([sorted(map(str, x)) for x in (bars, scores, alerts)])
    assert found[0] == found[1] == found[2] and all(found[0])


def test_scores_are_those_of_the_trees(spark, tmp_path):
    """Each row walked down each stored tree by hand: the mean of the leaves' shares, the largest of which is the score."""
    from tapeloom.operators import model as md

    rows = md.split_by_time(md.with_label(sq._features(spark, DATA).where("is_valid")))
    train, test = rows.where("part = 'train' and label is not null"), rows.where("part = 'test'")
    forest = md.train(train, sq.FEATURES, trees=10, depth=4)
    forest.stages[-1].write().overwrite().save(str(tmp_path / "forest"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "forest" / "data")).collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    assert len(trees) == 10
    got = {(r.symbol, r.start_time): r for r in md.score(forest, test).collect()}
    for r in test.collect():
        total = [0.0, 0.0, 0.0]
        for nodes in trees.values():
            node = nodes[0]
            while node.leftChild >= 0:
                node = nodes[node.leftChild if float(r[sq.FEATURES[node.split.featureIndex]]) <= node.split.leftCategoriesOrThreshold[0] else node.rightChild]
            share = sum(node.impurityStats)
            total = [t + x / share for t, x in zip(total, node.impurityStats, strict=True)]
        mine = got[r.symbol, r.start_time]
        assert abs(max(total) / 10 - mine.score) < 1e-9 and mine.prediction == float(total.index(max(total)))
    assert len(got) > 20


def test_values_in_one_pass_are_those_of_the_windows(spark, tmp_path):
    """Bars and values of whole symbols against Spark's windows and the walk by symbol, bit by bit: symbols of one bar to many,
    trades of one time, prices that are missing or not a number, an index that has gaps."""
    from tapeloom.operators import beta, candles, indicators, series

    r, rows = random.Random(11), []
    for k, n in enumerate([1, 2, 19, 20, 21, 51, 130, 130, 300]):
        at = 0
        for j in range(n):
            at += r.choice([0, 1, 1, 2])
            price = None if k == 7 and j % 40 == 39 else float("nan") if k == 6 and j == 70 else r.choice([50.0, r.uniform(1, 1000)])
            rows.append((f"S{k}", at, price, None if k == 5 and j == 7 else float(r.randrange(1, 9)), r.randrange(3), j))
    trades = spark.createDataFrame(rows, "symbol string, day long, price double, volume double, a long, b long").select("symbol", F.timestamp_seconds(F.col("day") * 86400).alias("ts"), "price", "volume", F.struct("a", "b").alias("seq"))
    bars = candles.candles(trades, "D1", mode="event")
    index = beta.index_returns(bars.where("symbol = 'S8'"), "S8")
    want = beta.with_beta(indicators.windowed(bars), "S8").join(indicators.recursive(bars), ["symbol", "start_time"])
    names = [*sq._W, *sq._REC, "open", "high", "low", "close", "volume", "ret_index", "rel_ret", "beta"]
    want = beta.feature_rows(want, sq.FEATURES).select("symbol", "start_time", *names, "is_valid")
    key = lambda x: [(str(y[0]), y[1], *map(repr, y[2:])) for y in sorted(map(tuple, x), key=lambda y: y[:2])]
    got = series.with_indicators(trades, "D1", names, index, sq.FEATURES)
    assert key(got.collect()) == key(want.collect()) and got.where("is_valid and beta is not null").count() > 50
    market = {x.start_time: x.close for x in candles.candles(trades.withColumn("symbol", F.lit("all")), "D1", mode="event").collect()}
    assert key((x.start_time, 0, x.close) for x in candles.closes(trades, "D1").collect()) == key((at, 0, x) for at, x in market.items())


def test_labels_and_parts_need_no_window(spark):
    """What is ahead comes with the features, of the bars that are kept: labels and parts are those of the windows."""
    from tapeloom.operators import model as md

    plain = sq._features(spark, DATA).where("is_valid")
    want = md.split_by_time(md.with_label(plain)).select("symbol", "start_time", "label", "part").collect()
    rows = md.split_by_time(md.with_label(sq._features(spark, DATA, ahead=md.HORIZON, only_valid=True)))
    assert sorted(map(str, rows.select("symbol", "start_time", "label", "part").collect())) == sorted(map(str, want)) and {x.part for x in want} == {"train", "embargo", "test"}
    assert "Window" not in rows.drop("ret_index")._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]


def test_stretches_are_of_whole_symbols():
    import pyarrow as pa

    from tapeloom.operators import series

    symbols = ["A"] * 7 + ["B"] + ["C"] * 12 + [None] * 2 + ["D"] * 3
    for size in (1, 2, 5, 25):
        for rows in (1, 4, 9, 100):
            batches = [pa.record_batch({"symbol": pa.array(symbols[k : k + size], pa.string()), "n": range(k, min(k + size, 25))}) for k in range(0, 25, size)]
            got = list(series.whole_symbols(batches, rows))
            assert [x for t, _ in got for x in t.column("n").to_pylist()] == list(range(25))
            assert [t.column("symbol")[int(b)].as_py() for t, begins in got for b in begins] == ["A", "B", "C", None, "D"]


def test_features_are_made_once(spark):
    """The cut, the forest and the scores read a table: what a query gives does not make its bars again."""
    for df in (sq._signal_bars(spark, DATA), QUERIES["model_scores"](spark, DATA)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "InPandas" not in plan and "InArrow" not in plan and "lineitem" not in str(df.inputFiles())


def test_a_forest_deals_its_rows_once(spark, monkeypatch):
    """Fitting goes over its rows several times: they are kept for that and let go then, and rows of a table are not copied."""
    from tapeloom.operators import model as md
    from tapeloom.paths import materialize

    rows = materialize(spark.range(3000).selectExpr("concat('S', id % 7) symbol", "timestamp_seconds(id * 3600) start_time", "double(id % 3) label", "double(id * 7919 % 101) x"))
    fit, seen, copies = md.Pipeline.fit, [], []
    monkeypatch.setattr(md.Pipeline, "fit", lambda self, df: (seen.append((df, df.storageLevel.useMemory)), fit(self, df))[1])
    monkeypatch.setattr(md, "materialize", lambda df: (copies.append(df), materialize(df))[1])
    stored, copied = (md.train(rows, ["x"], trees=3, depth=3, stored=s).stages[-1].toDebugString for s in (True, False))
    assert [kept for _, kept in seen] == [True, True] and not any(df.storageLevel.useMemory for df, _ in seen)
    assert len(copies) == 1 and stored.split("\n", 1)[1] == copied.split("\n", 1)[1]
