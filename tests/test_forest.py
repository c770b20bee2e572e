"""The forest against exhaustive search, and its independence of how rows are dealt out."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import forest, models

CAT, NUM = ["deviceid"], ["u", "v"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        "id", F.concat(F.lit("d"), F.col("id") % 5).alias("deviceid"), F.floor(F.rand(1) * 100).alias("u"), F.rand(2).alias("v"))
    y = 50 + 0.4 * F.col("u") - 20 * F.col("v") + F.when(F.col("deviceid").isin("d1", "d4"), 15.0).otherwise(0.0) + F.randn(3)
    out = df.withColumn("y", y)
    return spark.createDataFrame(out.unionByName(out.limit(30)).toPandas())


def test_trees_do_not_depend_on_partitions(rows):
    """Weights were drawn by partition, so that other files gave another forest."""
    told = [models.fit(df, "random_forest", "y", CAT, NUM, numTrees=3, maxDepth=6).stages[-1].toDebugString.split("\n", 1)[1]
            for df in (rows.coalesce(1), rows.repartition(7, "v"))]
    assert told[0] == told[1] and "feature 0 in" in told[0]


def test_no_histogram_of_a_node_is_shuffled(spark, rows):
    """The fit's shuffles hold a few statistics; Spark's held all bins of all features of every node."""
    context = spark.sparkContext._jsc.sc()
    before = context.newShuffleId()
    models.fit(rows, "random_forest", "y", CAT, NUM, numTrees=4, maxDepth=12)
    assert context.newShuffleId() - before < 12


def best_gain(x, y, nominal, least):
    """The largest decrease of the variance over all cuts, of categories in the order of their means."""
    best = 0.0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if nominal[f]:
            values = sorted(values, key=lambda v: y[x[:, f] == v].mean())
            sides = [np.isin(x[:, f], values[:k]) for k in range(1, len(values))]
        else:
            sides = [x[:, f] <= v for v in values[:-1]]
        for s in sides:
            if least <= s.sum() <= len(y) - least:
                best = max(best, y.var() - s.mean() * y[s].var() - (~s).mean() * y[~s].var())
    return best


def test_every_split_is_the_best_one():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 5, 300), rng.integers(0, 12, 300), rng.integers(0, 8, 300)]).astype(np.uint8)
    y = rng.normal(size=300) + 3 * np.isin(x[:, 0], [1, 3]) + x[:, 1] / 4
    nominal = np.array([True, False, False])
    p = {"numTrees": 1, "maxDepth": 5, "minInstancesPerNode": 4, "minInfoGain": 0.0, "seed": 1, "subsamplingRate": 1.0, "bootstrap": True, "tried": 3}
    t = forest.grow(x, y, nominal, 12, 0, p)
    t["sets"] = t["sets"].reshape(-1, 2)
    checked = []

    def visit(node, at, depth):
        assert t["value"][node] == pytest.approx(y[at].mean()) and t["rows"][node] == len(at)
        best = best_gain(x[at], y[at], nominal, 4) if depth < 5 else 0.0
        assert t["gain"][node] == pytest.approx(best, abs=1e-9)
        f = t["feature"][node]
        checked.append(f)
        if f >= 0:
            value, cut = x[at, f].astype(int), t["cut"][node]
            left = np.unpackbits(t["sets"][cut])[value] == 1 if nominal[f] else value <= cut
            visit(t["left"][node], at[left], depth + 1)
            visit(t["left"][node] + 1, at[~left], depth + 1)

    visit(0, np.arange(300), 0)
    assert {0, 1} <= set(checked) and len(checked) == len(t["feature"]) > 20
    again = pickle.loads(pickle.dumps(forest.Trees([forest.packed(t)]))).open()[0]
    inner = t["feature"] >= 0
    assert (again["left"] == t["left"]).all() and (again["value"][~inner] == t["value"][~inner]).all()
    leaves = forest.walk([again], x, nominal)
    assert ((y - leaves) ** 2).mean() < 0.5 * y.var()


def test_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 20, (500, 6)).astype(np.uint8), rng.normal(size=500).round(2)
    p = {"numTrees": 2, "maxDepth": 7, "minInstancesPerNode": 2, "minInfoGain": 0.0, "seed": 3, "subsamplingRate": 1.0, "bootstrap": True, "tried": 6}
    nominal = np.array([True] + 5 * [False])
    whole = forest.grow(x, y, nominal, 20, 1, p)
    monkeypatch.setattr(forest, "PIECE_ROWS", 37)
    monkeypatch.setattr(forest, "PIECE_CELLS", 250)
    parts = forest.grow(x, y, nominal, 20, 1, p)
    assert all((whole[k] == parts[k]).all() for k in ("feature", "cut", "left", "rows", "sets"))
    np.testing.assert_allclose(whole["value"], parts["value"])


def test_odd_tables(spark, rows):
    flat = rows.withColumn("y", F.lit(7.0))
    model = models.fit(flat, "random_forest", "y", CAT, NUM, numTrees=3, maxDepth=4)
    assert {r.raw_predicted for r in models.score(model, rows, categorical=CAT, numerical=NUM).collect()} == {7.0}
    assert sum(r.importance for r in models.importances(model, spark, CAT, NUM).collect()) == 0.0
    one = models.fit(rows.limit(1), "random_forest", "y", CAT, NUM, numTrees=3, maxDepth=4)
    assert models.score(one, rows.limit(5), categorical=CAT, numerical=NUM).count() == 5
    for bad in (None, float("nan")):
        with pytest.raises(ValueError):
            models.fit(rows.withColumn("y", F.when(F.col("id") != 5, F.col("y")).otherwise(F.lit(bad).cast("double"))), "random_forest", "y", CAT, NUM)


def test_leaderboard_of_a_deep_forest(spark, rows):
    """Trees reach scoring as arrays: the model is a few bytes a node."""
    train, valid = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    model = models.fit(train, "random_forest", "y", CAT, NUM)
    trees = model.stages[-1].trees
    nodes = sum(len(t["feature"]) for t in trees.packs)
    assert len(trees.packs) == 100 and len(pickle.dumps(trees)) < 12 * nodes + 100_000
    scored = {"random_forest": models.score(model, valid, categorical=CAT, numerical=NUM),
              "median": models.median_prediction(train, valid, "y").withColumnRenamed("prediction", "predicted")}
    board = models.leaderboard(scored, "y", "predicted").collect()
    assert [r.model for r in board] == ["random_forest", "median"] and board[0].mae_sec < 0.4 * board[1].mae_sec


def test_importances_follow_the_gains(spark, rows):
    model = models.fit(rows, "random_forest", "y", CAT, NUM, numTrees=4, maxDepth=6)
    forest_ = model.stages[-1]
    own = forest_.gains / forest_.gains.sum(axis=1, keepdims=True)
    got = {r.feature: r.importance for r in models.importances(model, spark, CAT, NUM).collect()}
    assert got == pytest.approx(dict(zip([*CAT, *NUM], own.mean(axis=0)))) and max(got, key=got.get) == "u"
