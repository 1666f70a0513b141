"""Labels, splits by time, and a random forest on feature rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..paths import collect_garbage, materialize

HORIZON, THRESHOLD, MIN_SCORE = 5, 0.01, 0.75
#: Rows of a partition that a forest is trained on, about.
TRAIN_ROWS = 50_000
UP, FLAT, DOWN = 2.0, 1.0, 0.0


def with_label(df: DataFrame, horizon: int = HORIZON, threshold: float = THRESHOLD) -> DataFrame:
    """df with future_ret, the return over the next horizon bars, and label: up, flat or down; both null at the end. Where
    df has ahead_close, the close that many bars later, no window is needed."""
    later = F.col("ahead_close") if "ahead_close" in df.columns else F.lead("close", horizon).over(Window.partitionBy("symbol").orderBy("start_time"))
    out = df.withColumn("future_ret", later / F.col("close") - 1)
    r = F.col("future_ret")
    return out.withColumn("label", F.when(r > threshold, UP).when(r < -threshold, DOWN).when(r.isNotNull(), FLAT))


def cut_of(df: DataFrame, share: float = 0.8) -> DataFrame:
    """_cut: the share's quantile of the times in seconds, one row."""
    return df.agg(F.percentile(F.unix_seconds("start_time"), share).alias("_cut"))  # over the distinct times, which are few


def split_by_time(df: DataFrame, share: float = 0.8, horizon: int = HORIZON) -> DataFrame:
    """df with part: train, test, or embargo for the last horizon bars of each symbol before the cut, whose labels see
    beyond it. The cut is the share's quantile of the times. df is read twice; where it has ahead_time, the time that many bars
    later, no window is needed: a bar is among the last ones if that is not before the cut."""
    cut = cut_of(df, share)
    out = df.crossJoin(F.broadcast(cut)).withColumn("_test", F.unix_seconds("start_time") >= F.col("_cut"))  # one row
    if "ahead_time" in df.columns:
        ends = ~F.coalesce(F.unix_seconds("ahead_time") < F.col("_cut"), F.lit(False))
        return out.withColumn("part", F.when(F.col("_test"), "test").when(ends, "embargo").otherwise("train")).drop("_cut", "_test")
    back = F.row_number().over(Window.partitionBy("symbol", "_test").orderBy(F.desc("start_time")))
    return out.withColumn("part", F.when(F.col("_test"), "test").when(back <= horizon, "embargo").otherwise("train")).drop("_cut", "_test")


def settled(rows: DataFrame, keys: tuple[str, ...] = ("symbol", "start_time"), stored: bool = False, n: int | None = None) -> DataFrame:
    """rows in partitions and an order that follow from their keys and number alone, whatever the session's settings are: by the
    keys, the last of them descending, which is how split_by_time() leaves a small table. stored: rows are some of a table's, which need not be
    written to be read twice. n: how many there are, where that is known."""
    rows = rows if stored or n is not None else materialize(rows)
    return rows.repartition(max(1, -(-(rows.count() if n is None else n) // TRAIN_ROWS)), *keys).sortWithinPartitions(*keys[:-1], F.desc(keys[-1]))


def train(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 5, seed: int = 7, keys: tuple[str, ...] = ("symbol", "start_time"), stored: bool = False, n: int | None = None) -> PipelineModel:
    """A forest on rows(label, *features). Its bootstrap draws by partition and place, so rows are settled by their keys first:
    the same rows give the same forest in every layout. Fitting reads them several times, so they are dealt once and kept until
    it is done, in memory as far as they fit; what doesn't is read from the exchange's files again, not written a second time.
    The copy of the model has no summary, which would hold on to the rows and their files; these go before it is returned."""
    spark = rows.sparkSession
    rows = settled(rows.select(*keys, "label", *features), keys, stored, n).drop(*keys).persist(StorageLevel.MEMORY_ONLY)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    try:
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(rows).copy()
    finally:
        rows.unpersist()
    del rows
    collect_garbage(spark)
    return model


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with prediction and its probability as score."""
    out = model.transform(rows)
    return out.withColumn("score", F.array_max(vector_to_array("probability"))).drop("features", "rawPrediction", "probability")


def confident(scored: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    return scored.where(F.col("score") >= least)


def evaluate(model: PipelineModel, rows: DataFrame, metric: str = "accuracy") -> float:
    return MulticlassClassificationEvaluator(labelCol="label", metricName=metric).evaluate(model.transform(rows))
