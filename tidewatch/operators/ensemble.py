"""Fusion of detectors' scores and labels, and rule-based anomaly types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..sources.staging import staged
from . import order
from . import profiles as P

STRATEGIES: dict[str, Callable[[DataFrame, dict[str, float]], DataFrame]] = {}


def register_strategy(name: str, combine: Callable[[DataFrame, dict[str, float]], DataFrame]) -> None:
    """``combine(frame with score_<detector> and anomaly_<detector>, weights)`` adds fused_score and fused_anomaly."""
    STRATEGIES[name] = combine


def _weighted(kind: str, weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    parts = [F.col(f"{kind}_{d}") * (w / total) for d, w in weights.items()]
    return sum(parts[1:], parts[0])


def majority_vote(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumn("fused_score", _weighted("score", weights)).withColumn("fused_anomaly", (_weighted("anomaly", weights) > 0.5).cast("int"))


def _scaled(df: DataFrame, weights: dict[str, float]) -> dict[str, Column]:
    """Each detector's score scaled to 0..1; all bounds come from one aggregate."""
    found = P.bounds(df, {d: F.col(f"score_{d}") for d in weights})
    return {d: P.scaled(F.col(f"score_{d}"), *found[d]) for d in weights}


def _mean(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total, terms = sum(weights.values()), [parts[d] * (w / sum(weights.values())) for d, w in weights.items()]
    return sum(terms[1:], terms[0]) if total else F.lit(0.0)


def weighted_average(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return P.above_percentile(df.withColumn("fused_score", _mean(_scaled(df, weights), weights)), "fused_score", 0.95, "fused_anomaly")


def rank_fusion(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted ranks, high scores ranking high, ties by their least rank.

    All detectors' scores are counted in one pass and ranked by ranges; ranks join back by score.
    """
    long = df.unpivot([], [F.col(f"score_{d}").cast("double").alias(d) for d in weights], "__detector", "__s").where("__s is not null")
    counts = long.groupBy("__detector", "__s").agg(F.count(F.lit(1)).alias("__n"))
    ranks = staged(order.running(counts, ["__detector"], "__s", ["__n"]), "ranks")
    out = df
    for d in weights:
        own = ranks.where(F.col("__detector") == d).select(F.col("__s").alias(f"__s_{d}"), (F.col("before___n") + 1).alias(f"__r_{d}"))
        out = out.join(own, F.col(f"score_{d}").cast("double") == F.col(f"__s_{d}"), "left").drop(f"__s_{d}")
    raw = staged(out.withColumn("__raw", _mean({d: F.col(f"__r_{d}") for d in weights}, weights)).drop(*[f"__r_{d}" for d in weights]), "fused")
    found = P.bounds(raw, {"r": F.col("__raw")})["r"]
    return P.above_percentile(raw.withColumn("fused_score", P.scaled(F.col("__raw"), *found)).drop("__raw"), "fused_score", 0.95, "fused_anomaly")


def balanced_weight(df: DataFrame, label: str) -> Column | None:
    """Weights that give both classes the same total; None where there is one class only."""
    n, ones = df.agg(F.count(F.lit(1)), F.sum(F.col(label))).first()
    return F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones))) if ones and ones < n else None


def stacking(df: DataFrame, weights: dict[str, float], label: str = "is_anomaly", key: str | None = None, model: str = "logistic") -> DataFrame:
    """A model on the detectors' scores with balanced classes; the weighted average where there is one class.

    ``model``: logistic regression, or a random forest on the labels that the detectors gave. ``key``: the model learns from 70 %
    of the rows by hash of that column; without one, from all rows. Column ``in_training`` says which.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from . import sampling as Z

    own = df.withColumn("in_training", Z.bucket(key, 1000) < 700 if key else F.lit(True))
    train = own.where("in_training")
    weight = balanced_weight(train, label)
    if weight is None:
        return weighted_average(own, weights)
    prefix = "score" if model == "logistic" else "anomaly"
    assembler = VectorAssembler(inputCols=[f"{prefix}_{d}" for d in weights], outputCol="__x", handleInvalid="keep")
    common = {"featuresCol": "__x", "labelCol": label, "weightCol": "__w", "probabilityCol": "__p", "rawPredictionCol": "__raw", "predictionCol": "__y"}
    ready = assembler.transform(train).withColumn("__w", weight)
    fitted = (LogisticRegression(regParam=1.0 / ready.count(), standardization=False, **common) if model == "logistic" else RandomForestClassifier(numTrees=100, seed=42, **common)).fit(ready)
    out = fitted.transform(assembler.transform(own)).withColumn("fused_score", vector_to_array("__p")[1])
    return out.withColumn("fused_anomaly", (F.col("fused_score") > 0.5).cast("int")).drop("__x", "__p", "__raw", "__y")


def forest_stacking(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return stacking(df, weights, model="forest")


def rounded_vote(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Plain majority of the labels; a half rounds to the even number, 0."""
    mean = sum((F.col(f"anomaly_{d}") for d in list(weights)[1:]), F.col(f"anomaly_{next(iter(weights))}")) / len(weights)
    return df.withColumn("fused_score", mean).withColumn("fused_anomaly", (mean > 0.5).cast("int"))


def f1_vote(df: DataFrame, weights: dict[str, float], label: str = "is_anomaly") -> DataFrame:
    """Vote with each detector's F1 on these rows as its weight; nobody is flagged where all are 0."""
    from . import evaluate as V

    rows = V.metrics_of_many(df, [f"anomaly_{d}" for d in weights], label).collect()  # a row per detector
    f1 = {r.detector.removeprefix("anomaly_"): r.f1 for r in rows}
    total = sum(f1.values())
    score = sum((F.col(f"anomaly_{d}") * f1[d] for d in list(weights)[1:]), F.col(f"anomaly_{next(iter(weights))}") * f1[next(iter(weights))]) / (total or 1.0)
    return df.withColumn("fused_score", score).withColumn("fused_anomaly", (score > 0.5).cast("int"))


def adaptive(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The label that all agree on, else that of the detector with the largest scaled score."""
    labels, scores = F.array(*[F.col(f"anomaly_{d}") for d in weights]), F.array(*_scaled(df, weights).values())
    best = F.get(labels, F.array_position(scores, F.array_max(scores)).cast("int") - 1)
    same = F.size(F.array_distinct(labels)) == 1
    return df.withColumn("fused_score", F.array_max(scores)).withColumn("fused_anomaly", F.when(same, F.get(labels, F.lit(0))).otherwise(best))


def cascade(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Flagged by the first detector (meant to miss little) and by the last (meant to be sure)."""
    names = list(weights)
    return df.withColumn("fused_score", F.least(F.col(f"score_{names[0]}"), F.col(f"score_{names[-1]}"))).withColumn("fused_anomaly", (F.col(f"anomaly_{names[0]}") * F.col(f"anomaly_{names[-1]}")).cast("int"))


for _name, _f in (("cascade", cascade), ("majority_vote", majority_vote), ("weighted_average", weighted_average), ("rank_fusion", rank_fusion), ("stacking", stacking), ("forest_stacking", forest_stacking), ("rounded_vote", rounded_vote), ("f1_vote", f1_vote), ("adaptive", adaptive)):
    register_strategy(_name, _f)


def fuse(df: DataFrame, weights: dict[str, float], strategy: str = "weighted_average") -> DataFrame:
    return STRATEGIES[strategy](df, weights)


def anomaly_types(df: DataFrame, predicted: str = "fused_anomaly", dos: str | None = None, sequence: str | None = None, forest: str | None = None) -> DataFrame:
    """First rule that fits: the DoS detector's type; volume over its 99th percentile, unusual port, port scan, unusual time; a sequence
    anomaly; an isolation anomaly, where the forest's score exceeds the 75th percentile of the scores it flagged (their largest, if they are 4 or fewer); else unknown.

    ``dos``: a column of DoS types; ``sequence`` and ``forest``: names of detectors with anomaly_<name> and score_<name>.
    """
    volume = F.col("bytes") / (F.col("duration") + 0.1)
    limit = order.quantile(df, volume, 0.99)
    kind = F.when(F.col(dos) != "Normal", F.col(dos)) if dos else F.when(F.lit(False), "")
    kind = (
        kind.when(volume > F.lit(limit), "Volume Anomaly")
        .when(F.col("dst_port").isin(X.SUSPICIOUS_PORTS), "Unusual Port")
        .when(X.port_scan_like() == 1, "Port Scan")
        .when(X.out_of_hours(F.col("timestamp")), "Unusual Time")
    )
    if sequence:
        kind = kind.when(F.col(f"anomaly_{sequence}") == 1, "Sequence Anomaly")
    if forest:
        own, score = df.where((F.col(predicted) == 1) & (F.col(f"anomaly_{forest}") == 1)), F.col(f"score_{forest}")
        few = own.limit(5).count() <= 4
        high = own.agg(F.max(score)).first()[0] if few else order.quantile(own, score, 0.75)
        kind = kind.when((F.col(f"anomaly_{forest}") == 1) & (score > F.lit(high)), "Isolation Anomaly")
    return df.withColumn("anomaly_type", F.when(F.col(predicted) == 1, kind.otherwise("Unknown Anomaly")).otherwise("Normal"))


def predict(df: DataFrame, detectors: dict[str, object], weights: dict[str, float], strategy: str = "weighted_average", key: str = "row_id") -> DataFrame:
    """Every detector's score and label on one row, the fused ones, and the anomaly type.

    ``detectors``: fitted detectors by name. Each reads ``df`` and keeps its two columns; they meet by ``key``.
    """
    out, kinds = df, {getattr(d, "kind", ""): name for name, d in detectors.items()}
    for name, d in detectors.items():
        own = d.predict(df)
        extra = ["dos_attack_type"] if "dos_attack_type" in own.columns else []
        out = out.join(own.select(key, F.col("anomaly_score").alias(f"score_{name}"), F.col("predicted_anomaly").alias(f"anomaly_{name}"), *extra), key, "left")
    out = staged(out, "detectors")
    fused = fuse(out, weights, strategy)
    fused = fused.withColumns({"anomaly_score": F.col("fused_score"), "predicted_anomaly": F.col("fused_anomaly")})
    return anomaly_types(fused, "fused_anomaly", "dos_attack_type" if "dos_attack_type" in out.columns else None, kinds.get("sequence"), kinds.get("forest"))
