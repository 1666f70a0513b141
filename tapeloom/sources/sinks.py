"""Tables of candles and states on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import materialize


def write_candles(candles: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by timeframe and trade date, rows of a folder together, so that few files are made."""
    dated = candles.withColumn("trade_date", F.to_date("start_time"))
    dated.repartition("timeframe", "trade_date").sortWithinPartitions("symbol", "start_time").write.partitionBy("timeframe", "trade_date").mode(mode).parquet(path)


_CANDLES = "symbol string, start_time timestamp, open double, high double, low double, close double, volume double, first_seq bigint, is_closed boolean, closed_by_seq bigint, version bigint, timeframe string, trade_date date"


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """The candles that upsert_candles() keeps, with the version that each is of; no rows if there are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _CANDLES)
    return spark.read.schema(_CANDLES).parquet(path)


def upsert_candles(made: DataFrame, path: str, version: int) -> None:
    """Puts candles in the place of what there is of them, by symbol, timeframe and start. Only the partitions (timeframe, trade
    date) that made has rows for are read and written anew; of one candle's rows the latest version stays, and of equal ones
    the closed. Done twice with one version it changes nothing more."""
    spark = made.sparkSession
    new = materialize(made.withColumns({"version": F.lit(version).cast("long"), "trade_date": F.to_date("start_time")}).select(*(c.split()[0] for c in _CANDLES.split(", "))))
    touched = new.select("timeframe", "trade_date").distinct()
    places = touched.collect()  # the days that a micro-batch has candles of
    if not places:
        return
    here = F.lit(False)
    for r in places:
        here = here | ((F.col("timeframe") == r.timeframe) & (F.col("trade_date") == F.lit(r.trade_date)))
    both = read_candles(spark, path).where(here).unionByName(new)
    keys = ["symbol", "timeframe", "start_time", "trade_date"]
    rest = [c for c in new.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("version", "is_closed")).alias("_x")).select(*keys, "_x.*")
    best = best.select(*new.columns).repartition("timeframe", "trade_date").sortWithinPartitions("symbol", "start_time")
    best.write.partitionBy("timeframe", "trade_date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_states(states: DataFrame, path: str, model_version: str, config_version: str, feature_timestamp: str) -> None:
    """Rows with the columns that an audit needs."""
    states.withColumns({"model_version": F.lit(model_version), "config_version": F.lit(config_version), "feature_timestamp": F.lit(feature_timestamp).cast("timestamp")}).write.mode("append").parquet(path)


def replay(tape: DataFrame, partitions: int | None = None) -> DataFrame:
    """Time order, arrival order within equal times, as ranges that can be written file by file."""
    cut = tape.repartitionByRange(partitions, "ts") if partitions else tape.repartitionByRange("ts")
    return cut.sortWithinPartitions("ts", "seq")
