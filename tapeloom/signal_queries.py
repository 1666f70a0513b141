"""Queries on candles of lineitem's trades: indicators, beta, labels, model, gates and signals. S1 stands for the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .market_queries import _LI, query
from .operators import beta as bt
from .operators import candles as cd
from .operators import indicators as ind
from .operators import model as md
from .operators import series as sr
from .operators import signals as sg
from .paths import drop_table, materialize
from .sources import tables

INDEX = "S1"
FEATURES = ["ret_1", "ret_5", "ret_20", "dist_10", "dist_50", "slope_20", "std_20", "bb_pct", "vol_z", "rsi_14", "macd_hist", "rel_ret"]
_C = f"""{_LI}, c AS (SELECT symbol, s // 86400 * 86400 AS start_s, arg_min(price, (s, o)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (s, o)) AS close, sum(volume) AS volume FROM li GROUP BY symbol, s // 86400),
r AS (SELECT *, close / lag(close) OVER b - 1 AS ret_1 FROM c WINDOW b AS (PARTITION BY symbol ORDER BY start_s))"""
_B = f"""{_C}, ix AS (SELECT start_s, close / lag(close) OVER (ORDER BY start_s) - 1 AS ret_index FROM c WHERE symbol = '{INDEX}'),
j AS (SELECT r.*, ix.ret_index FROM r LEFT JOIN ix USING (start_s)),
p AS (SELECT *, CASE WHEN ret_1 IS NOT NULL AND ret_index IS NOT NULL THEN ret_index END AS x, CASE WHEN ret_1 IS NOT NULL AND ret_index IS NOT NULL THEN ret_1 END AS y FROM j),
bb AS (SELECT *, CASE WHEN count(x) OVER n >= 30 AND var_samp(x) OVER n > 0 THEN covar_samp(y, x) OVER n / var_samp(x) OVER n END AS beta FROM p WINDOW n AS (PARTITION BY symbol ORDER BY start_s ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return cd.candles(tables.heavy_trades(spark, d), "D1", mode="event")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars as a table, for queries that read them more than once."""
    return materialize(_daily(spark, d))


def _key() -> list:
    return ["symbol", F.unix_seconds("start_time").alias("start_s")]


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


_W = [f"ret_{n}" for n in ind.RETURNS] + [f"{k}_{n}" for n in ind.AVERAGES for k in ("sma", "dist", "slope")] + ["std_20", "bb_width", "bb_pct", "vol_ratio", "vol_z"]


def _windowed_ctes() -> str:
    rets = ", ".join(f"close / lag(close, {n}) OVER b - 1 AS ret_{n}" for n in ind.RETURNS if n > 1)
    avgs = ", ".join(f"CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} END AS sma_{n}" for n in ind.AVERAGES)
    win = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY start_s ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ind.AVERAGES)
    more = ", ".join(f"close / sma_{n} - 1 AS dist_{n}, sma_{n} / lag(sma_{n}) OVER b - 1 AS slope_{n}" for n in ind.AVERAGES)
    return f"""a AS (SELECT *, {rets}, {avgs}, CASE WHEN count(ret_1) OVER w20 = 20 THEN stddev_samp(ret_1) OVER w20 END AS std_20, CASE WHEN count(close) OVER w20 = 20 THEN stddev_pop(close) OVER w20 END AS dev,
 CASE WHEN count(volume) OVER w20 = 20 THEN volume / avg(volume) OVER w20 END AS vol_ratio, CASE WHEN count(volume) OVER w20 = 20 AND stddev_pop(volume) OVER w20 > 0 THEN (volume - avg(volume) OVER w20) / stddev_pop(volume) OVER w20 END AS vol_z FROM r WINDOW b AS (PARTITION BY symbol ORDER BY start_s), {win}),
 m AS (SELECT *, {more}, 4 * dev / sma_20 AS bb_width, CASE WHEN dev > 0 THEN (close - (sma_20 - 2 * dev)) / (4 * dev) END AS bb_pct FROM a WINDOW b AS (PARTITION BY symbol ORDER BY start_s))"""


def _windowed_sql() -> str:
    return f"""WITH {_C}, {_windowed_ctes()} SELECT symbol, start_s, {", ".join(f"round({n}, 6) AS {n}" for n in _W)} FROM m"""


@query(_windowed_sql())
def indicators_windowed(spark, d):
    return sr.with_indicators(tables.heavy_trades(spark, d), "D1", _W).select(*_key(), *_r(*_W))


_REC = ("ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14")
_GAIN = "greatest(x.close - t.close, 0)"
_LOSS = "greatest(t.close - x.close, 0)"
_RANGE = "greatest(x.high - x.low, abs(x.high - t.close), abs(x.low - t.close))"


def _wilder_sql(old: str, new: str, full: int) -> str:
    """A sum until the window is full, its mean then, and Wilder's average from there on."""
    return f"CASE WHEN x.n < {full} THEN t.{old} + {new} WHEN x.n = {full} THEN (t.{old} + {new}) / 14 ELSE (t.{old} * 13 + {new}) / 14 END"


_WALK = f"""n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_s) AS n FROM c),
t AS (SELECT symbol, n, start_s, close, close AS e12, close AS e26, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, high - low AS tr FROM n WHERE n = 1
 UNION ALL SELECT x.symbol, x.n, x.start_s, x.close, t.e12 * 11 / 13 + x.close * 2 / 13, t.e26 * 25 / 27 + x.close * 2 / 27,
  t.sig * 0.8::DOUBLE + (t.e12 * 11 / 13 + x.close * 2 / 13 - t.e26 * 25 / 27 - x.close * 2 / 27) * 0.2::DOUBLE,
  {_wilder_sql("up", _GAIN, 15)}, {_wilder_sql("down", _LOSS, 15)}, {_wilder_sql("tr", _RANGE, 14)} FROM t JOIN n x ON x.symbol = t.symbol AND x.n = t.n + 1)"""
_RSI = "CASE WHEN n >= 15 THEN CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 ELSE 50 END END"


@query(f"""WITH RECURSIVE {_C}, {_WALK}
SELECT symbol, start_s, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26, round(e12 - e26, 6) AS macd, round(sig, 6) AS macd_signal, round(e12 - e26 - sig, 6) AS macd_hist,
 round({_RSI}, 6) AS rsi_14, round(CASE WHEN n >= 14 THEN tr END, 6) AS atr_14 FROM t""")
def indicators_recursive(spark, d):
    return sr.with_indicators(tables.heavy_trades(spark, d), "D1", list(_REC)).select(*_key(), *_r(*_REC))


@query(f"WITH {_B} SELECT symbol, start_s, round(ret_index, 6) AS ret_index, round(ret_1 - ret_index, 6) AS rel_ret, round(beta, 6) AS beta FROM bb")
def beta(spark, d):
    names = ["ret_index", "rel_ret", "beta"]
    return sr.with_indicators(tables.heavy_trades(spark, d), "D1", names, _index(spark, d)).select(*_key(), *_r(*names))


@query(f"""WITH {_B}, k AS (SELECT symbol, arg_max(beta, start_s) FILTER (beta IS NOT NULL) AS beta, arg_max(close, start_s) AS entry FROM bb GROUP BY symbol),
g AS (SELECT *, CASE WHEN round(beta, 6) < 1 THEN 'safe' WHEN round(beta, 6) <= 1.25 THEN 'medium' WHEN round(beta, 6) > 1.25 THEN 'risky' END AS risk_class FROM k)
SELECT symbol, risk_class, round(entry * (1 + CASE risk_class WHEN 'safe' THEN 0.12::DOUBLE WHEN 'medium' THEN 0.15::DOUBLE WHEN 'risky' THEN 0.20::DOUBLE END), 6) AS take_profit,
 round(entry * (1 + CASE risk_class WHEN 'safe' THEN -0.03::DOUBLE WHEN 'medium' THEN -0.05::DOUBLE WHEN 'risky' THEN -0.07::DOUBLE END), 6) AS stop_loss FROM g""")
def risk_classes(spark, d):
    got = sr.with_indicators(tables.heavy_trades(spark, d), "D1", ["close", "beta"], _index(spark, d))
    last = got.groupBy("symbol").agg(F.max_by("beta", F.when(F.col("beta").isNotNull(), F.col("start_time"))).alias("beta"), F.max_by("close", "start_time").alias("entry"))
    last = last.withColumn("risk_class", bt.risk_class(F.round("beta", 6)))
    tp, sl = bt.levels(F.col("entry"), F.col("risk_class"))
    return last.select("symbol", "risk_class", F.round(tp, 6).alias("take_profit"), F.round(sl, 6).alias("stop_loss"))


@query(f"""WITH {_C}, l AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY start_s) / close - 1 AS f FROM c),
q AS (SELECT quantile_cont(start_s, 0.8) AS cut FROM c), t AS (SELECT l.*, start_s >= cut AS test FROM l, q)
SELECT symbol, start_s, CASE WHEN f > 0.01 THEN 2.0 WHEN f < -0.01 THEN 0.0 WHEN f IS NOT NULL THEN 1.0 END::DOUBLE AS label,
 CASE WHEN test THEN 'test' WHEN row_number() OVER (PARTITION BY symbol, test ORDER BY start_s DESC) <= 5 THEN 'embargo' ELSE 'train' END AS part FROM t""")
def labels_and_split(spark, d):
    return md.split_by_time(md.with_label(_bars(spark, d))).select(*_key(), "label", "part")


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The index's daily returns."""
    return bt.index_returns(cd.candles(tables.heavy_trades(spark, d).where(F.col("symbol") == INDEX), "D1", mode="event"), INDEX)


def _features(spark: SparkSession, d: str, **more) -> DataFrame:
    return sr.with_indicators(tables.heavy_trades(spark, d), "D1", ["close", *FEATURES], _index(spark, d), FEATURES, **more)


@query(f"""WITH RECURSIVE {_B}, {_windowed_ctes()}, {_WALK},
f AS (SELECT symbol, start_s, {", ".join(f"m.{x}" for x in FEATURES[:9])}, {_RSI} AS rsi_14, e12 - e26 - sig AS macd_hist, j.ret_1 - j.ret_index AS rel_ret FROM m JOIN t USING (symbol, start_s) JOIN j USING (symbol, start_s))
SELECT symbol, start_s, {", ".join(f"round({x}, 6) AS {x}" for x in FEATURES)}, {" AND ".join(f"{x} IS NOT NULL" for x in FEATURES)} AS is_valid FROM f""")
def feature_rows(spark, d):
    return _features(spark, d).select(*_key(), *_r(*FEATURES), "is_valid")


@query()
def model_scores(spark, d):
    """A forest trained on the earlier bars scores the later ones. The features are a table, which the split, the forest and the
    scores read."""
    rows = md.split_by_time(md.with_label(materialize(_features(spark, d, ahead=md.HORIZON, only_valid=True))))
    model = md.train(rows.where("part = 'train' and label is not null"), FEATURES, trees=10, depth=4, stored=True)
    return md.score(model, rows.where("part = 'test'")).select(*_key(), "label", "prediction", F.round("score", 6).alias("score"))


def _hourly_trades(spark: SparkSession, d: str) -> DataFrame:
    """A tape whose prices are 40 and the logarithm of those of lineitem's trades, so that they move by hundredths as shares do,
    not by multiples; all trades together are the index. Its H1 bars start between 8:00 and 14:00 at UTC+7, in and out of the session."""
    return tables.heavy_trades(spark, d).withColumn("price", 40 + F.log("price"))


def _signal_bars(spark: SparkSession, d: str) -> DataFrame:
    """The hourly bars after the time split with gates by their defaults, levels, and the score of a forest trained on the
    bars before: the probability of a rise where it predicts one, else null, as signals are for rises only. Bars that lack
    an indicator have no score; without a beta there is no class, so no level and no entry. The tape has no times of
    receipt, so a bar with less than 3 units traded stands for a stale one."""
    trades = _hourly_trades(spark, d)
    index = materialize(bt.market_returns(cd.closes(trades, "H1")))
    bars, table = sr.stored_bars(trades, "H1")
    cut = md.cut_of(bars).first()[0]
    values = lambda columns, later: sr.of_stored_bars(bars, columns, index, FEATURES, cut, md.HORIZON, later)
    rows = materialize(values(["high", "low", "close", "volume", "beta", *FEATURES], True).drop("ahead_close"))
    n = rows.agg(F.sum("n_earlier")).first()[0] or 0
    model = md.train(md.with_label(values(["close", *FEATURES], False)), FEATURES, trees=10, depth=4, n=n)
    drop_table(spark, table)
    test = rows.where("n_earlier is null").drop("n_earlier")
    scored = md.score(model, test.where("is_valid")).withColumn("score", F.when(F.col("prediction") == md.UP, F.col("score")))
    none = F.lit(None).cast("double")
    rows = scored.unionByName(test.where("not is_valid").withColumns({"prediction": none, "score": none}))
    rows = rows.withColumn("risk_class", bt.risk_class(F.col("beta")))
    tp, sl = bt.levels(F.col("close"), F.col("risk_class"))
    return sg.gates(rows.withColumns({"take_profit": tp, "stop_loss": sl, "is_stale": F.col("volume") < 3, "spread": (F.col("high") - F.col("low")) / F.col("close")}))


@query()
def risk_gates(spark, d):
    return _signal_bars(spark, d).groupBy("blocked_by").agg(F.count("*").alias("n"))


@query()
def signal_life_cycle(spark, d):
    return sg.with_audit(sg.life_cycle(_signal_bars(spark, d)), "forest-1", "config-1")


@query()
def alerts(spark, d):
    return sg.debounce(sg.life_cycle(_signal_bars(spark, d)))
