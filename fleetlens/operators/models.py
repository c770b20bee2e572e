"""Travel-time models with Spark ML: preparation, fitting, scoring, comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import sqrt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.columns import clip, round_to
from fleetlens.operators.decisions import reasons
from fleetlens.operators.evaluation import regression_metrics
from fleetlens.operators.features import check_feature_names
from fleetlens.operators.forest import ForestRegressor
from fleetlens.quantiles import exact_quantiles
from fleetlens.schemas import CATEGORICAL_FEATURES, NUMERICAL_FEATURES, TARGET

SCORE_BOUNDS = (3.0, 3600.0)
GATE = {"mae_sec": 48.0, "r2": 0.65, "p95_error_sec": 160.0}


def coerce(df: DataFrame, categorical: Sequence[str] = tuple(CATEGORICAL_FEATURES),
           numerical: Sequence[str] = tuple(NUMERICAL_FEATURES)) -> DataFrame:
    """Text categories and numeric doubles; what does not parse becomes 0."""
    text = {c: F.col(c).cast("string") for c in categorical}
    numbers = {c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)) for c in numerical}
    return df.withColumns({**text, **numbers})


def tree_stages(categorical: Sequence[str] = tuple(CATEGORICAL_FEATURES),
                numerical: Sequence[str] = tuple(NUMERICAL_FEATURES)) -> list:
    """Alphabetical category codes with a code for unknown values, then one vector."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_code" for c in categorical],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
    return [index, VectorAssembler(inputCols=[*[f"{c}_code" for c in categorical], *numerical], outputCol="features")]


def linear_stages(rows: int, categorical: Sequence[str] = tuple(CATEGORICAL_FEATURES),
                  numerical: Sequence[str] = tuple(NUMERICAL_FEATURES)) -> list:
    """Scaled numbers and one-hot categories; unknown categories are all zero.

    ``dropLast`` drops the extra slot that 'keep' adds for unknown values.  Spark
    scales by the sample deviation; the factor turns that into the population one.
    """
    factor = Vectors.dense([sqrt(rows / (rows - 1))] * len(numerical))
    codes, hot = [f"{c}_code" for c in categorical], [f"{c}_hot" for c in categorical]
    return [
        StringIndexer(inputCols=list(categorical), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=list(numerical), outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="scaled", outputCol="standard", scalingVec=factor),
        VectorAssembler(inputCols=[*hot, "standard"], outputCol="features"),
    ]


def median_prediction(train: DataFrame, rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Constant baseline: the training median as a scalar subquery."""
    keyed = train.select(F.lit(1).alias("_all"), target)
    median = exact_quantiles(keyed, ["_all"], target, {"m": 0.5}).select("m").scalar()
    return rows.withColumn("prediction", median)


def ridge(rows: int, deviation: float, alpha: float = 10.0, target: str = TARGET) -> LinearRegression:
    """L2 penalty in the sum-of-squares form.

    Spark divides the loss by the row count and works with a label scaled to unit
    deviation, so the penalty is alpha / n times the label's sample deviation.
    """
    return LinearRegression(featuresCol="features", labelCol=target, elasticNetParam=0.0, standardization=False,
                            regParam=alpha / rows * deviation)


def fit(train: DataFrame, algorithm: str, target: str = TARGET, categorical: Sequence[str] = tuple(CATEGORICAL_FEATURES),
        numerical: Sequence[str] = tuple(NUMERICAL_FEATURES), validation: str | None = None, **params) -> PipelineModel:
    """Fit ridge, random_forest or boosted_trees with optional parameter overrides.

    ``validation`` names a boolean column of rows held out for early stopping.
    """
    check_feature_names([*categorical, *numerical])
    data = coerce(train, categorical, numerical)
    widest = 32
    if algorithm != "ridge" and categorical:  # a tree needs as many bins as its widest category has values, and one for others
        counts = data.agg(*[F.count_distinct(F.col(c)).alias(c) for c in categorical]).first()
        widest = max(widest, *(counts[c] + 2 for c in categorical))
    if algorithm == "ridge":
        size = data.agg(F.count(target).alias("n"), F.stddev_samp(target).alias("s")).first()
        stages = [*linear_stages(size["n"], categorical, numerical),
                  ridge(size["n"], size["s"], params.pop("alpha", 10.0), target)]
    elif algorithm == "random_forest":
        settings = {"numTrees": 100, "maxDepth": 16, "minInstancesPerNode": 4, "seed": 42, "maxBins": widest,
                    "maxMemoryInMB": 1024, "cacheNodeIds": True, **params}
        stages = [*tree_stages(categorical, numerical),
                  ForestRegressor(featuresCol="features", labelCol=target, **settings)]
    elif algorithm == "boosted_trees":
        settings = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": 42, "maxBins": widest, **params}
        if validation:
            settings["validationIndicatorCol"] = validation
        stages = [*tree_stages(categorical, numerical), GBTRegressor(featuresCol="features", labelCol=target, **settings)]
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return Pipeline(stages=stages).fit(data)


def score(model: PipelineModel, rows: DataFrame, model_id: str = "", version: str = "",
          categorical: Sequence[str] = tuple(CATEGORICAL_FEATURES),
          numerical: Sequence[str] = tuple(NUMERICAL_FEATURES), out: str = "predicted") -> DataFrame:
    """Predictions bounded to plausible travel times and rounded, raw value kept."""
    prepared = rows.withColumn("_row", F.struct(*rows.columns))
    scored = model.transform(coerce(prepared, categorical, numerical))
    return scored.select("_row.*", F.col("prediction").alias(f"raw_{out}"),
                         round_to(clip(F.col("prediction"), *SCORE_BOUNDS), 2).alias(out),
                         F.lit(model_id).alias(f"{out}_model_id"), F.lit(version).alias(f"{out}_model_version"))


def dual_score(champion: PipelineModel, candidate: PipelineModel, rows: DataFrame) -> DataFrame:
    """Both models on identical rows, side by side."""
    return score(candidate, score(champion, rows, out="champion"), out="candidate")


def leaderboard(scored: dict[str, DataFrame], actual: str, predicted: str) -> DataFrame:
    """Validation metrics of all models, best MAE first."""
    rows = [regression_metrics(df, actual, predicted).withColumn("model", F.lit(name)) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, rows).orderBy("mae_sec")


def performance_gate(metrics: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Absolute limits on MAE, R2 and P95, with the broken ones named."""
    at = limits or GATE
    rules = {"MAE": F.col("mae_sec") > at["mae_sec"], "R2": F.col("r2") < at["r2"],
             "P95": F.col("p95_error_sec") > at["p95_error_sec"]}
    return metrics.withColumn("failure_reasons", reasons(rules)).withColumn(
        "passed", F.when(F.col("failure_reasons") == "", 1).otherwise(0).cast("long"))


def importances(model: PipelineModel, spark, categorical: Sequence[str] = tuple(CATEGORICAL_FEATURES),
                numerical: Sequence[str] = tuple(NUMERICAL_FEATURES), top: int = 15) -> DataFrame:
    """Normalised importances of a tree model, one entry per feature, the largest first."""
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(name, float(v) / total) for name, v in zip([*categorical, *numerical], values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance")).limit(top)
