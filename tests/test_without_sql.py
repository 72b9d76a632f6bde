"""The queries that SQL can't express, each against numpy, a plain version, or what its definition implies."""

import numpy as np
import pytest

from tidewatch.functions import sqltext as S
from tidewatch.operators import detectors as D
from tidewatch.operators import sampling as Z
from tidewatch.plans.registry import BASE, QUERIES
from tidewatch.sources import views


@pytest.fixture(scope="module")
def rows(spark, small):
    """A query's rows; each query runs once."""
    return lambda name: QUERIES[name](spark, small).collect()


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").count()


def _held_out(spark, small):
    return {r.row_id for r in views.net(spark, small).where(Z.bucket("row_id") >= 700).select("row_id").collect()}


def test_q_principal_components(spark, small, rows):
    x = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    m = np.array(list(x.values()), float)
    values, axes = np.linalg.eigh(np.cov(m.T))
    got = {r.vec_id: r for r in rows("q_principal_components")}
    made = np.array([got[i].components for i in x])
    assert np.allclose(np.abs(made), np.abs(m @ axes[:, ::-1][:, :2]), atol=1e-6)
    assert abs(next(iter(got.values())).explained - values[-2:].sum() / values.sum()) < 1e-9


def test_q_isolation_forest(spark, small, rows, events):
    got = rows("q_isolation_forest")
    scores = {r.row_id: r.anomaly_score for r in got}
    assert len(got) == events and all(0 < s < 1 for s in scores.values())
    flagged = [r.anomaly_score for r in got if r.predicted_anomaly]
    plain = [r.anomaly_score for r in got if not r.predicted_anomaly]
    assert 0 < len(flagged) <= 0.06 * events and min(flagged) >= max(plain)
    # Isolation means extremes: flagged rows lie further out than others.
    z = {r.row_id: r for r in views.net(spark, small).select("row_id", *BASE).collect()}
    x = np.array([[z[i][c] or 0.0 for c in BASE] for i in scores], float)
    out = np.abs((x - x.mean(axis=0)) / x.std(axis=0)).max(axis=1)
    is_flagged = np.array([r.predicted_anomaly == 1 for r in got])
    assert out[is_flagged].mean() > 1.3 * out[~is_flagged].mean()


def _stacked(spark, small, rows, name):
    got = rows(name)
    assert {r.row_id for r in got} == _held_out(spark, small)
    assert all(0 <= r.fused_score <= 1 and r.fused_anomaly == int(r.fused_score > 0.5) for r in got if r.fused_score not in (None, 0.5))


def test_q_stacking(spark, small, rows):
    _stacked(spark, small, rows, "q_stacking")


def test_q_forest_stacking(spark, small, rows):
    _stacked(spark, small, rows, "q_forest_stacking")


def test_q_forest_grid(rows):
    got = rows("q_forest_grid")
    assert {(r.trees, r.feature_share, r.contamination) for r in got} == {(n, 1.0, c) for n in (10, 20) for c in ("0.05", "0.2")}
    assert all(0 <= r.f1 <= 1 for r in got) and [r.f1 for r in got] == sorted((r.f1 for r in got), reverse=True)


def test_q_adaptive_models(spark, small, rows, events):
    got = rows("q_adaptive_models")
    assert len({r.row_id for r in got}) == len(got) == events
    assert min(r.anomaly_score for r in got) == 0 and max(r.anomaly_score for r in got) == 1
    assert all((r.anomaly_type == "Normal") == (r.predicted_anomaly == 0) and 0 <= r.ml_score <= 1 for r in got)
    assert {r.anomaly_type for r in got if r.predicted_anomaly} <= set(D.KINDS.values())
    assert min(r.anomaly_score for r in got if r.predicted_anomaly) >= max(r.anomaly_score for r in got if not r.predicted_anomaly)


def test_q_text_forest(spark, small, rows):
    docs = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    learned = {r.doc_id for r in labels.where(Z.bucket("doc_id") < 700).collect()}
    got = {r.doc_id: r.anomaly_score for r in rows("q_text_forest")}
    assert got.keys() == docs - learned and all(0 <= s <= 1 for s in got.values())
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in got}
    ones, others = ([got[d] for d, t in toxic.items() if t == y] for y in (1, 0))
    assert not ones or np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in others]) > 0.5


def test_q_sqli_detect(spark, small, rows, events):
    got = {r.row_id: r for r in rows("q_sqli_detect")}
    texts = {r.row_id: r.query for r in views.sqltext(spark, small).collect()}
    assert got.keys() == texts.keys() and len(got) == events
    for i, r in got.items():
        assert r.decoded == S._decoded(texts[i]) or r.decoded == texts[i]
        assert r.predicted_anomaly == int(r.anomaly_score >= r.threshold) and (r.attack_type is None) == (r.predicted_anomaly == 0)
        assert 0 <= r.anomaly_score <= 1 and 0.4 <= r.threshold <= 0.8
    assert all(got[i].predicted_anomaly for i, t in texts.items() if "DROP TABLE" in t or "OR 1=1" in t)


def test_q_sqli_models(spark, small, rows):
    got = {r.row_id: r for r in rows("q_sqli_models")}
    assert got.keys() == _held_out(spark, small)
    assert all(0 <= r.ml_score <= 1 and 0 <= r.advanced_score <= 1 and r.predicted_anomaly == int(r.anomaly_score >= r.threshold) for r in got.values())


def test_q_sqli_explain(rows, events):
    got = rows("q_sqli_explain")
    assert len(got) == events
    for r in got:
        assert (r.explanation is None) == (r.recommendation is None) == (r.predicted_anomaly == 0)
        assert r.obfuscation_details is None or r.obfuscation_details.original != r.obfuscation_details.deobfuscated
    assert any(r.explanation and "Kind: destructive" in r.explanation for r in got)


def test_q_sqli_differences(rows):
    got = rows("q_sqli_differences")
    assert all((r.differences is None) == (r.query == r.decoded) for r in got)
    assert any(r.differences and "comment" in r.differences for r in got) and any(r.differences and "url" in r.differences for r in got)


def test_decoding_gets_only_texts_with_signs(spark):
    """Plain texts go to Python as nulls; joined lists, strings and codes come back as what they spell."""
    texts = {"SELECT a FROM t": "SELECT a FROM t", "x = 'a' || 'b'": "x = 'ab'", "y = ['1', \"2\", '3'].join('')": "y = '123'", "z%20=%201": "z = 1", None: None, "": ""}
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    assert {r.q: r.d for r in df.select("q", S.decoded(df["q"]).alias("d")).collect()} == texts


def test_similarity_is_linear_and_bounded(spark):
    df = spark.createDataFrame([("abcdef", "abcdef"), ("abcdef", "xyzuvw"), ("abcdef", "abcxef"), ("", "a"), ("a", "a")], "a string, b string")
    got = [round(r[0], 6) for r in df.select(S.similarity(df["a"], df["b"])).collect()]
    assert got == [1.0, 0.0, 0.25, 0.0, 1.0]
