from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from pricetide.operators import boosting
from pricetide.operators import model as md
from pricetide.sources import tables, writers

WHOLE = md.BoostParams(rounds=5, depth=4, min_rows=5, column_share=1.0, row_share=1.0)


def rows_of(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 200, n), np.round(rng.normal(size=n), 1), rng.integers(-3, 4, n)
    odds = np.sin(a / 20) + b * c / 2 + rng.normal(size=n)
    values = zip(range(n), a.tolist(), b.tolist(), c.tolist(), (odds > 0).astype(int).tolist())
    return spark.createDataFrame(list(values), "id long, a int, b double, c int, y int").repartition(5)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)


@pytest.mark.parametrize("tasks", [1, 64])
def test_equals_sparks_learner(spark, small_blocks, monkeypatch, tasks):
    """Without sampling the trees are those of Spark's own learner: splits, values, gains, scores."""
    monkeypatch.setattr(boosting, "MOST_CELLS", 3 * 256 * 3 * 2)  # two nodes a scan
    monkeypatch.setattr(boosting, "MOST_TASKS", tasks)
    rows = rows_of(spark)
    own = md.train_classifier(rows, ["a", "b", "c"], WHOLE, "y")
    booster = GBTClassifier(labelCol="y", featuresCol="features", **WHOLE.spark())
    theirs = Pipeline(stages=[md._assembler(["a", "b", "c"]), booster]).fit(rows)
    assert own.stages[1].treeWeights == theirs.stages[1].treeWeights == [1.0, *[0.1] * 4]
    for a, b in zip(own.stages[1].trees, theirs.stages[1].trees):
        assert a.numNodes == b.numNodes and a.depth == b.depth
        split = lambda t: [line for line in t.toDebugString.split("\n") if "If" in line or "Else" in line]
        assert split(a) == split(b)
    assert np.allclose(own.stages[1].featureImportances.toArray(), theirs.stages[1].featureImportances.toArray(), atol=1e-6)
    scores = lambda m: {r.id: r.y_prob for r in md.score(m, rows).collect()}
    one, two = scores(own), scores(theirs)
    assert len(one) == 3000 and max(abs(one[i] - two[i]) for i in one) < 1e-6


def test_sampling_learns_as_well(spark, small_blocks):
    rows = rows_of(spark)
    sampled = md.BoostParams(rounds=10, depth=4, min_rows=5, column_share=0.6, row_share=0.7)
    booster = GBTClassifier(labelCol="y", featuresCol="features", **sampled.spark())
    theirs = Pipeline(stages=[md._assembler(["a", "b", "c"]), booster]).fit(rows)
    own = md.train_classifier(rows, ["a", "b", "c"], sampled, "y")
    last = [md.round_losses(m, {"all": rows}, "y").orderBy("round").collect()[-1].log_loss for m in (own, theirs)]
    assert last[0] < 0.69 and last[0] == pytest.approx(last[1], rel=0.1)
    drawn = [boosting._drawn(5, 100_000, seed, 0.7) for seed in (1, 2)]
    assert all(abs(len(d) - 70_000) < 1000 for d in drawn) and abs(len(np.intersect1d(*drawn)) - 49_000) < 1000


def test_saved_and_loaded(spark, tmp_path):
    rows = rows_of(spark, 300)
    model = md.train_classifier(rows, ["a", "b", "c"], WHOLE, "y")
    writers.save_model(model, str(tmp_path / "model"))
    again = tables.load_model(str(tmp_path / "model"))
    scores = lambda m: sorted((r.id, r.y_prob) for r in md.score(m, rows).collect())
    assert scores(again) == scores(model)
    assert again.stages[1].getLabelCol() == "y" and again.stages[1].getNumTrees == 5


def test_rows_are_not_cached(spark):
    """Spark's learner, which weights still take, keeps every row as an object in memory, several times over."""
    jobs = spark.sparkContext.statusTracker()
    rows = rows_of(spark, 2000).withColumn("w", F.lit(1.0))
    names = {}
    for weight in (None, "w"):
        spark.sparkContext.setJobGroup(f"boosting-{weight}", "training")
        md.train_classifier(rows, ["a", "b", "c"], WHOLE, "y", weight)
        found = [jobs.getJobInfo(j) for j in jobs.getJobIdsForGroup(f"boosting-{weight}")]
        stages = [jobs.getStageInfo(s) for job in found if job for s in job.stageIds]
        names[weight] = {stage.name for stage in stages if stage}
    spark.sparkContext.setJobGroup("", "")
    assert any("RandomForest" in name for name in names["w"])
    assert names[None] and not any("RandomForest" in name or "DecisionTree" in name for name in names[None])


@pytest.mark.parametrize("rows", ["(1, 2, CAST(NULL AS INT))", "(1, NULL, 1)", "(1, 2, 3)"])
def test_bad_rows_are_refused(spark, rows):
    frame = spark.sql(f"SELECT * FROM VALUES (1, 1, 0), {rows} AS t(a, b, y)")
    with pytest.raises(Exception, match="must be 0 or 1|is missing"):
        md.train_classifier(frame, ["a", "b"], WHOLE, "y")


def test_few_rows(spark):
    one = spark.sql("SELECT * FROM VALUES (1, 0), (1, 1) AS t(a, y)")
    model = md.train_classifier(one, ["a"], WHOLE, "y")
    assert [r.y_prob for r in md.score(model, one).collect()] == [0.5, 0.5]
    with pytest.raises(ValueError, match="no rows"):
        md.train_classifier(one.limit(0), ["a"], WHOLE, "y")
