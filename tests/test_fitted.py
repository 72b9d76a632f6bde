"""Models fitted on one frame, stored, and applied to another: components, the adaptive bundle, stages of pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from tidewatch.operators import components as K
from tidewatch.operators import contract as C
from tidewatch.operators import detectors as D
from tidewatch.operators import evaluate as V
from tidewatch.operators import stages
from tidewatch.sources import views

FEATURES = ["a", "b", "c", "d"]


def _frame(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ np.array([[3.0, 1.0, -2.0, 0.5], [0.0, 1.0, 1.0, 4.0]]) + rng.normal(size=(n, 4)) * 0.05 + shift
    y = (np.arange(n) % 12 == 0).astype(int)
    x[y == 1] += 9 * rng.choice([-1, 1], size=(y.sum(), 1))
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, is_anomaly int"), x


def test_components_of_another_frame_equal_numpy(spark):
    train, x = _frame(spark, 400, 1)
    other, z = _frame(spark, 90, 2, 5.0)
    table = K.fit_projection(train, FEATURES, 0.95)
    rows = table.orderBy("position").collect()
    assert [r.feature for r in rows] == FEATURES
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    values, axes = np.linalg.eigh(np.cov(scaled.T))
    order = np.argsort(-values)
    kept = int((np.cumsum(values[order]) / values.sum() < 0.95).sum()) + 1
    assert K.names(table) == [f"pc_{i}" for i in range(kept)] and kept < 4
    got = np.array([[r[f"pc_{i}"] for i in range(kept)] for r in K.project(other, table).orderBy("row_id").collect()])
    expected = (z - x.mean(axis=0)) / x.std(axis=0) @ axes[:, order[:kept]]
    assert np.allclose(np.abs(got), np.abs(expected), atol=1e-8)
    # null or absent features count as their mean, which projects to nothing
    odd = K.project(spark.createDataFrame([(1, None, None)], "row_id int, a double, b double"), table).first()
    assert [odd[f"pc_{i}"] for i in range(kept)] == [0.0] * kept
    assert len(K.names(K.fit_projection(train, FEATURES, 3))) == 3


def test_forest_on_components_survives_its_store(spark, tmp_path):
    train, _ = _frame(spark, 600, 3)
    test, _ = _frame(spark, 300, 4)
    own = C.preset("enhanced_forest", FEATURES, trees=25).fit(train)
    assert {"projection", "nodes", "limit"} <= set(own.state)
    before = own.predict(test)
    assert before.columns == [*test.columns, "anomaly_score", "predicted_anomaly"]
    own.save(str(tmp_path / "forest"))
    after = C.Detector.load(spark, str(tmp_path / "forest")).predict(test)
    plain = lambda f: sorted((r.row_id, round(r.anomaly_score, 12), r.predicted_anomaly) for r in f.collect())
    assert plain(before) == plain(after)
    assert V.metrics(before).first().f1 > 0.6


def test_tuned_forests_draw_features_and_know_auto(spark):
    train, _ = _frame(spark, 300, 5)
    grid = {"trees": (5,), "feature_shares": (0.5, 1.0), "contaminations": (0.1, "auto"), "folds": 2}
    own = C.ForestDetector(features=FEATURES, tune=True, grid=grid, components=0.9).fit(train)
    assert own.options["contamination"] in (0.1, "auto") and own.options["feature_share"] in (0.5, 1.0)
    half = C.ForestDetector(features=FEATURES, trees=30, feature_share=0.5, contamination="auto").fit(train)
    used = half.state["nodes"].where("feature >= 0").groupBy("tree").agg(F.count_distinct("feature").alias("n")).agg(F.max("n")).first()[0]
    seen = half.state["nodes"].where("feature >= 0").select("feature").distinct().count()
    assert used <= 2 and seen == 4 and half.state["limit"].first().threshold == 0.5
    hits = half.predict(train)
    assert hits.where("(anomaly_score >= .5) <> (predicted_anomaly = 1)").count() == 0


@pytest.mark.parametrize("improved", [False, True])
def test_adaptive_bundle_is_kept_and_applied(spark, small, tmp_path, improved):
    features = ["bytes", "packets", "duration"]
    net = views.net(spark, small).where("row_id < 400")
    train, test = net.where("row_id % 2 = 0"), net.where("row_id % 2 = 1")
    options = {"features": features, "models": True, "trees": 8, "neighbours": 5, "min_rows": 10, "improved": improved}
    own = C.AdaptiveDetector(**options).fit(train)
    own.save(str(tmp_path / "adaptive"))
    loaded = C.Detector.load(spark, str(tmp_path / "adaptive"))
    plain = lambda f: sorted((r.row_id, round(r.anomaly_score, 9), r.predicted_anomaly, r.anomaly_type, round(r.ml_score, 9)) for r in f.collect())
    got = plain(loaded.predict(test))
    assert got == plain(own.predict(test)) and len(got) == test.count() and any(r[4] > 0 for r in got)
    # The model part is that of both frames together.
    both = D.ml_scores(test, train.where("is_anomaly = 0"), features, mix="share" if improved else "sum", trees=8, neighbours=5)
    lo, hi = both.agg(F.min("ml_score"), F.max("ml_score")).first()
    assert {r.row_id: round((r.ml_score - lo) / (hi - lo), 6) for r in both.collect()} == {r[0]: round(r[4], 6) for r in got}
    without = C.AdaptiveDetector(**(options | {"models": False})).fit(train).predict(test)
    assert "ml_score" not in without.columns


def test_detectors_are_stages(spark, tmp_path):
    train, _ = _frame(spark, 400, 6)
    test, _ = _frame(spark, 200, 7)
    forest = stages.DetectorEstimator(kind="forest", features=FEATURES, trees=10, contamination=0.1)
    profile = stages.DetectorEstimator(kind="profile", options='{"features": ["a", "b", "c", "d"]}', sensitivity="low")
    for estimator in (forest, profile):
        estimator.write().overwrite().save(str(tmp_path / "estimator"))
        back = stages.DetectorEstimator.load(str(tmp_path / "estimator"))
        assert back.detectorOptions() == estimator.detectorOptions()
        model = Pipeline(stages=[estimator]).fit(train)
        path = str(tmp_path / f"model-{estimator.getOrDefault('kind')}")
        model.write().overwrite().save(path)
        again = PipelineModel.load(path)
        plain = lambda f: sorted((r.row_id, r.anomaly_score, r.predicted_anomaly) for r in f.collect())
        assert plain(again.transform(test)) == plain(model.transform(test))
        assert stages.DetectionEvaluator().evaluate(model.transform(test)) == V.metrics(model.transform(test)).first().f1


def test_cross_validation_over_detectors(spark, tmp_path):
    train, _ = _frame(spark, 300, 8)
    profile = stages.DetectorEstimator(kind="profile", features=FEATURES)
    grid = ParamGridBuilder().addGrid(profile.sensitivity, ["low", "high"]).build()
    found = CrossValidator(estimator=profile, estimatorParamMaps=grid, evaluator=stages.DetectionEvaluator(), numFolds=2, seed=1).fit(train)
    assert len(found.avgMetrics) == 2 and all(0 <= m <= 1 for m in found.avgMetrics)
    found.write().overwrite().save(str(tmp_path / "cv"))
    again = CrossValidatorModel.load(str(tmp_path / "cv"))
    plain = lambda f: sorted((r.row_id, r.anomaly_score) for r in f.collect())
    assert plain(again.transform(train)) == plain(found.transform(train))
    forest = stages.DetectorEstimator(kind="forest", features=FEATURES, contamination=0.1)
    best = CrossValidator(estimator=forest, estimatorParamMaps=ParamGridBuilder().addGrid(forest.trees, [3, 9]).build(), evaluator=stages.DetectionEvaluator(), numFolds=2).fit(train).bestModel
    assert best.detector.options["trees"] in (3, 9)
