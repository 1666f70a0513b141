"""Beta against an index, relative returns, feature vectors and risk classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bars looked back on, pairs needed; risk bands (target_min, target_max, sl_min, sl_max).
LOOKBACK, MIN_PAIRS = 90, 30
BANDS = {"safe": (0.12, 0.15, -0.04, -0.03), "medium": (0.15, 0.18, -0.06, -0.05), "risky": (0.20, 0.25, -0.08, -0.07)}
SAFE_BELOW, MEDIUM_UP_TO = 1.0, 1.25


def index_returns(candles: DataFrame, index: str) -> DataFrame:
    w = Window.partitionBy("timeframe").orderBy("start_time")
    return candles.where(F.col("symbol") == index).select("timeframe", "start_time", (F.col("close") / F.lag("close").over(w) - 1).alias("ret_index"))


def market_returns(closes: DataFrame) -> DataFrame:
    """(start_time, ret_index) of closes(start_time, close): a row a period, which one task puts in order."""
    w = Window.partitionBy(F.lit(0)).orderBy("start_time")
    return closes.select("start_time", (F.col("close") / F.lag("close").over(w) - 1).alias("ret_index"))


def with_beta(candles: DataFrame, index: str, lookback: int = LOOKBACK, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """candles, which need ret_1, with ret_index, rel_ret and beta over the last lookback bars; beta is null with fewer than
    min_pairs pairs of returns, or if the index didn't move. The join is on (timeframe, start_time): an index has one bar
    a period, so Spark broadcasts it as long as it is small."""
    joined = candles.join(index_returns(candles, index), ["timeframe", "start_time"], "left")
    w = Window.partitionBy("symbol", "timeframe").orderBy("start_time").rowsBetween(-(lookback - 1), 0)
    both = F.col("ret_1").isNotNull() & F.col("ret_index").isNotNull()
    x = F.when(both, F.col("ret_index"))
    pairs, var = F.count(x).over(w), F.var_samp(x).over(w)
    beta = F.when((pairs >= min_pairs) & (var > 0), F.covar_samp(F.when(both, F.col("ret_1")), x).over(w) / var)
    return joined.withColumn("rel_ret", F.col("ret_1") - F.col("ret_index")).withColumn("beta", beta)


def risk_class(beta: Column) -> Column:
    return F.when(beta < SAFE_BELOW, "safe").when(beta <= MEDIUM_UP_TO, "medium").when(beta > MEDIUM_UP_TO, "risky")


def levels(entry: Column, risk: Column) -> tuple[Column, Column]:
    """(take profit, stop loss): the nearer edge of the class's target and stop bands."""
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, band in BANDS.items() for x in (name, band[k]))), risk)
    return entry * (1 + of(0)), entry * (1 + of(3))


def feature_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """df with is_valid: no feature is null or NaN."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(f)
    return df.withColumn("is_valid", ok)
