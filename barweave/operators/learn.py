"""Linear models of Spark ML, their calibration steps and artefacts, and the split by time. The boosted models are in ``training``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _prepared(features: list[str], stage) -> Pipeline:
    filled = [f"{c}_f" for c in features]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="vec"), stage])


def linear(features: list[str]) -> Pipeline:
    return _prepared(features, LogisticRegression(featuresCol="vec", labelCol="y", weightCol="weight", regParam=0.01))


def calibration_points(scored: DataFrame, col: str) -> DataFrame:
    """at, rate: the steps of the isotonic map of a score."""
    model = IsotonicRegression(featuresCol=col, labelCol="y").fit(scored.withColumn("y", F.col("y").cast("double")))
    pairs = zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True)
    return scored.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, at double, rate double")


def save(model: PipelineModel, features: list[str], points: DataFrame, path: str) -> None:
    """A model, the order of its features and the steps of its calibration below one folder."""
    spark = points.sparkSession
    model.write().overwrite().save(f"{path}/model")
    points.write.mode("overwrite").parquet(f"{path}/calibration")
    spark.createDataFrame(list(enumerate(features)), "i int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load(spark, path: str) -> tuple[PipelineModel, list[str], DataFrame]:
    order = spark.read.schema("i int, feature string").json(f"{path}/features").orderBy("i").collect()  # one row a feature
    return PipelineModel.load(f"{path}/model"), [r["feature"] for r in order], spark.read.parquet(f"{path}/calibration")


def score(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows)
    made = [c for c in out.columns if c not in rows.columns and c != "probability"]
    return out.withColumn(name, vector_to_array("probability")[1]).drop("probability", *made)


def by_time(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """``rows`` with held_out (part is ``test``) and part: ``test`` for those from the day on before which ``share`` of the rows lie, ``train`` for those whose
    exit is earlier than that day, null for spans that reach over it."""
    cut = rows.agg(F.percentile_approx(F.unix_date("asof"), share, 10_000).alias("_cut"))  # one row
    part = F.when(F.unix_date("asof") >= F.col("_cut"), "test").when(F.unix_date("exit_date") < F.col("_cut"), "train")
    return rows.crossJoin(F.broadcast(cut)).withColumn("part", part).drop("_cut").withColumn("held_out", F.coalesce(F.col("part") == "test", F.lit(False)))
