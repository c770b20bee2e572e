"""Models: the ridge solution, bounds, unknown categories, comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import models
from fleetlens.operators.evaluation import regression_metrics
from fleetlens.operators.features import LeakageError

CAT, NUM = ["deviceid"], ["u", "v"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        "id", F.concat(F.lit("d"), F.col("id") % 3).alias("deviceid"), (F.rand(1) * 10).alias("u"), F.rand(2).alias("v"))
    noisy = 50 + 4 * F.col("u") - 20 * F.col("v") + F.when(F.col("deviceid") == "d1", 15.0).otherwise(0.0) + F.randn(3)
    return spark.createDataFrame(df.withColumn("y", noisy).toPandas())


def test_ridge_matches_closed_form(spark, rows):
    model = models.fit(rows, "ridge", "y", CAT, NUM, alpha=10.0)
    got = models.score(model, rows, categorical=CAT, numerical=NUM).orderBy("id").toPandas()
    pdf = rows.orderBy("id").toPandas()
    hot = np.stack([(pdf.deviceid == c).to_numpy(float) for c in ("d0", "d1", "d2")], 1)
    scaled = (pdf[NUM] - pdf[NUM].mean()) / pdf[NUM].std(ddof=0)
    x = np.hstack([hot, scaled.to_numpy()])
    xc, y = x - x.mean(0), pdf.y.to_numpy()
    w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(5), xc.T @ (y - y.mean()))
    np.testing.assert_allclose(got.raw_predicted, xc @ w + y.mean(), rtol=1e-4)


def test_scores_are_bounded_and_unknown_categories_score(spark, rows):
    model = models.fit(rows, "random_forest", "y", CAT, NUM, numTrees=5, maxDepth=4)
    strange = rows.limit(3).withColumn("deviceid", F.lit("never seen")).withColumn("u", F.lit(None).cast("double"))
    got = models.score(model, strange, "m", "v1", CAT, NUM).collect()
    assert len(got) == 3 and all(3.0 <= r.predicted <= 3600.0 and r.predicted_model_id == "m" for r in got)
    assert got[0].u is None, "inputs are returned as they came"


def test_learners_beat_the_median(spark, rows):
    train, valid = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    scored = {a: models.score(models.fit(train, a, "y", CAT, NUM, **p), valid, categorical=CAT, numerical=NUM)
              for a, p in {"ridge": {}, "random_forest": {"numTrees": 10, "maxDepth": 6}, "boosted_trees": {"maxIter": 10}}.items()}
    scored["median"] = models.median_prediction(train, valid, "y").withColumnRenamed("prediction", "predicted")
    board = models.leaderboard(scored, "y", "predicted").collect()
    assert board[-1].model == "median" and board[0].mae_sec < 2
    assert [r.mae_sec for r in board] == sorted(r.mae_sec for r in board)


def test_forest_rows_remember_their_node(spark, rows):
    """Else every pass over the rows ships the trees grown so far and walks them from the root; the trees are the same."""
    same = {"numTrees": 5, "maxDepth": 8}
    kept = models.fit(rows, "random_forest", "y", CAT, NUM, **same).stages[-1]
    walked = models.fit(rows, "random_forest", "y", CAT, NUM, cacheNodeIds=False, **same).stages[-1]
    assert kept.getOrDefault("cacheNodeIds") is True
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]


def test_early_stopping_and_importances(spark, rows):
    held = rows.withColumn("is_validation", F.col("id") % 5 == 0)
    model = models.fit(held, "boosted_trees", "y", CAT, NUM, validation="is_validation", maxIter=30)
    got = models.importances(model, spark, CAT, NUM).collect()
    assert sum(r.importance for r in got) == pytest.approx(1.0) and got[0].feature in NUM


def test_bad_requests(spark, rows):
    with pytest.raises(ValueError):
        models.fit(rows, "mystery", "y", CAT, NUM)
    with pytest.raises(LeakageError):
        models.fit(rows, "ridge", "y", CAT, ["actual_eta_sec"])


def test_performance_gate(spark):
    df = spark.createDataFrame([(float(y), y + 100.0) for y in range(20, 60)], "y double, p double")
    got = models.performance_gate(regression_metrics(df, "y", "p")).first()
    assert got.passed == 0 and got.failure_reasons == "MAE; R2"


@pytest.mark.parametrize("name", ["j06_random_forest", "j07_boosted_trees", "j08_leaderboard", "j10_importances", "j11_candidate_fit", "k03_dual_scoring"])
def test_registered_models_have_full_settings(spark, monkeypatch, name):
    import __spark_entry__ as entry

    full, fits = models.fit, []

    def recorded(train, algorithm, target, validation=None, **params):
        fits.append((algorithm, params, validation and {r[0] for r in train.select(validation).distinct().collect()}))
        return full(train, "ridge", target)

    monkeypatch.setattr(models, "fit", recorded)
    monkeypatch.setattr(models, "importances", lambda model, spark: spark.createDataFrame([("u", 1.0)], "feature string, importance double"))
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert fits and all(params == {} for _, params, _ in fits)
    assert all(held == ({False, True} if algorithm == "boosted_trees" else None) for algorithm, _, held in fits)
