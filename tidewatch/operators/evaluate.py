"""Evaluation: metrics, curves, sweeps and histograms as aggregates of a scored frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order

def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(label: str, predicted: str) -> list[Column]:
    cell = lambda p, y: F.count(F.when((F.col(predicted) == p) & (F.col(label) == y), 1))
    return [cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fn")]


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp)})


def metrics(df: DataFrame, label: str = "is_anomaly", predicted: str = "predicted_anomaly", by: list[str] | None = None) -> DataFrame:
    return with_rates(df.groupBy(*(by or [])).agg(*confusion(label, predicted)))


def metrics_of_many(df: DataFrame, predictions: list[str], label: str = "is_anomaly") -> DataFrame:
    """One row per detector column, in one pass."""
    long = df.unpivot([F.col(label)], [F.col(p).cast("int").alias(p) for p in predictions], "detector", "predicted")
    return metrics(long, label, "predicted", ["detector"])


def sweep(df: DataFrame, score: str, percentiles: list[float], label: str = "is_anomaly", inclusive: bool = False) -> DataFrame:
    """Metrics at each percentile of the score as threshold. All thresholds' cells are counted in one pass, without a shuffle of rows."""
    limits = order.quantiles(df, {score: F.col(score)}, [p / 100 for p in percentiles])[score]
    cells = []
    for i, t in enumerate(limits):
        hit = F.col(score) >= F.lit(t) if inclusive else F.col(score) > F.lit(t)
        cells += [F.count(F.when((hit if p else ~hit) & (F.col(label) == y), 1)).alias(f"{c}_{i}") for c, p, y in (("tp", 1, 1), ("fp", 1, 0), ("tn", 0, 0), ("fn", 0, 1))]
    row = df.agg(*cells)
    each = [F.struct(F.lit(float(p)).alias("percentile"), F.lit(t).cast("double").alias("threshold"), *[F.col(f"{c}_{i}").alias(c) for c in ("tp", "fp", "tn", "fn")]) for i, (p, t) in enumerate(zip(percentiles, limits, strict=True))]
    return with_rates(row.select(F.inline(F.array(*each))))


def best_f1(swept: DataFrame) -> DataFrame:
    """The row of a sweep with the best F1, the first of equals; none where all are 0."""
    return swept.where("f1 > 0").orderBy(F.desc("f1"), "percentile").limit(1)


def metrics_and_auc(df: DataFrame, score: str = "anomaly_score", label: str = "is_anomaly", predicted: str = "predicted_anomaly") -> DataFrame:
    """One row: metrics of the labels, and the AUC of the score (null with a single class)."""
    return metrics(df, label, predicted).crossJoin(F.broadcast(auc(df, score, label)))


def improvement(before: DataFrame, after: DataFrame, measures: list[str] = ["precision", "recall", "f1"]) -> DataFrame:  # noqa: B006
    """One row: by how many per cent each measure of one metrics row exceeds another's; null where that is 0."""
    a, b = before.select(*[F.col(m).alias(f"__a_{m}") for m in measures]), after.select(*[F.col(m).alias(f"__b_{m}") for m in measures])
    return a.crossJoin(F.broadcast(b)).select(*[F.try_divide(100 * (F.col(f"__b_{m}") - F.col(f"__a_{m}")), F.col(f"__a_{m}")).alias(m) for m in measures])


def mean_scores(df: DataFrame, scores: list[str]) -> DataFrame:
    """detector and mean: each detector's mean score."""
    return df.agg(*[F.avg(s).alias(s) for s in scores]).unpivot([], scores, "detector", "mean")


def inferred_types(df: DataFrame, predicted: str = "predicted_anomaly") -> DataFrame:
    """type and n, for frames without types: flagged rows with bytes over the 95th percentile, and with unusual ports."""
    from ..functions import features as X

    limit, hit = order.quantile(df, "bytes", 0.95), F.col(predicted) == 1
    row = df.agg(F.count(F.when(hit & (F.col("bytes") > F.lit(limit)), 1)).alias("volume"), F.count(F.when(hit & F.col("dst_port").isin(X.SUSPICIOUS_PORTS), 1)).alias("port"))
    return row.unpivot([], ["volume", "port"], "type", "n")


def benchmark(train: DataFrame, test: DataFrame, detectors: dict, label: str = "is_anomaly") -> DataFrame:
    """A row of metrics for each detector, fitted on ``train`` and evaluated on ``test``."""
    parts = [d.fit(train).evaluate(test, label).select(F.lit(name).alias("detector"), "*") for name, d in detectors.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))


def auc(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """Exact area under the ROC curve by Mann-Whitney; ties count half; null with a single class. Scores are counted, then summed by ranges."""
    placed = order.running(score_counts(df, score, label), [], "s", ["neg"])
    u = placed.agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return u.select(F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def roc_curve(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """threshold, fpr, tpr and precision at each distinct score."""
    placed = order.running(score_counts(df, score, label), [], "s", ["pos", "neg"], descending=True)
    run = placed.withColumns({"tp": F.col("before_pos") + F.col("pos"), "fp": F.col("before_neg") + F.col("neg")})
    total = placed.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    run = run.crossJoin(F.broadcast(total))
    return run.select(F.col("s").alias("threshold"), _ratio(F.col("fp"), F.col("n")).alias("fpr"), _ratio(F.col("tp"), F.col("p")).alias("tpr"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def histogram(df: DataFrame, score: str, bins: int = 10, label: str = "is_anomaly") -> DataFrame:
    """Counts by label in equal bins between the least and the largest score."""
    bounds = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins))
    return df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(place.cast("int").alias("bin"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, score: str, k: int = 10, tie: str = "row_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)
