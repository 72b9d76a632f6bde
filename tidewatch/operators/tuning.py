"""Weights, thresholds and parameters found from scored frames; everything is aggregated before it is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import evaluate as V
from . import order
from . import profiles as P


def informative_weights(df: DataFrame, scores: list[str], label: str | None = None, base: dict[str, float] | None = None, alpha: float = 0.7) -> DataFrame:
    """detector, weight: base weights mixed with each score's |correlation| with the label, or its dispersion without one."""
    worth = lambda s: F.abs(F.corr(s, F.col(label).cast("double"))) if label else F.var_pop(s) / (F.avg(s) + 1e-10)
    row = df.agg(*[F.coalesce(F.nanvl(worth(s), F.lit(0.0)), F.lit(0.0)).alias(s) for s in scores])
    long = row.unpivot([], scores, "detector", "worth")
    own = F.create_map(*[x for s in scores for x in (F.lit(s), F.lit((base or {}).get(s, 1 / len(scores))))])
    total = long.agg(F.sum("worth").alias("total"))
    share = F.coalesce(F.try_divide("worth", "total"), F.lit(1 / len(scores)))
    return long.crossJoin(F.broadcast(total)).select("detector", (alpha * own[F.col("detector")] + (1 - alpha) * share).alias("weight"))


def f1_weights(df: DataFrame, predictions: list[str], label: str = "is_anomaly", least: float = 0.01) -> DataFrame:
    """detector, f1, weight: F1 scores, at least ``least``, normalised."""
    rows = V.metrics_of_many(df, predictions, label).withColumn("w", F.greatest(F.col("f1"), F.lit(least)))
    total = rows.agg(F.sum("w").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("detector", "f1", (F.col("w") / F.col("total")).alias("weight"))


def gap_threshold(df: DataFrame, score: str, fallback: float = 0.7, percentile: float = 0.95) -> DataFrame:
    """The score above the first large gap between neighbouring scores, if it exceeds ``fallback``; else the lesser of
    the percentile and ``fallback``. Large: over the 95th percentile of the largest quarter of gaps.

    Distinct scores are ordered by ranges; quantiles are selected, not gathered.
    """
    distinct = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s")).distinct()
    gaps = staged(order.neighbours(distinct, "s").withColumn("gap", F.col("above") - F.col("s")), "gaps")
    quarter = order.quantile(gaps, "gap", 0.75)
    large = None if quarter is None else order.quantile(gaps.where(F.col("gap") >= quarter), "gap", 0.95)
    natural = None if large is None else gaps.where(F.col("gap") > large).agg(F.min("above")).first()[0]
    limit = order.quantile(df, score, percentile)
    found = natural if natural is not None and natural > fallback else None if limit is None else min(limit, fallback)
    return df.sparkSession.createDataFrame([(found,)], "threshold double")


def grid_of(lo: float, hi: float, steps: int = 100) -> list[float]:
    """Evenly spaced thresholds from lo to hi."""
    return [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]


def best_threshold(df: DataFrame, score: str, label: str = "is_anomaly", steps: int = 100) -> float:
    """Of ``steps`` thresholds between the extremes, the first with the best F1 (scores from it on are flagged); one pass for all."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    grid = grid_of(lo, hi, steps)
    cells = [F.count(F.when((F.col(score) >= t) & (F.col(label) == y), 1)).alias(f"{k}{i}") for i, t in enumerate(grid) for k, y in (("tp", 1), ("fp", 0))]
    row = df.agg(F.sum(label).alias("p"), *cells).first()
    return float(grid[max(range(steps), key=lambda i: 2 * row[f"tp{i}"] / max(1, row[f"tp{i}"] + row[f"fp{i}"] + (row.p or 0)))])


def forest_grid(df: DataFrame, features: list[str], key: str = "row_id", trees: tuple[int, ...] = (50, 100, 200), feature_shares: tuple[float, ...] = (0.5, 0.75, 1.0), contaminations: tuple[float | str, ...] = (0.01, 0.05, 0.1, 0.2, "auto"), folds: int = 3, label: str = "is_anomaly", seed: int = 42) -> DataFrame:
    """trees, feature_share, contamination and mean F1 over folds (by hash of ``key``), best first; all contaminations share a fold's forest and scores.

    A tree draws the share of the features for itself. Contamination ``auto`` flags scores over .5, whatever the training scores are.
    """
    from . import models as M
    from . import sampling as Z

    rows, fold = [], Z.bucket(key, folds, seed)
    for n in trees:
        for share in feature_shares:
            for i in range(folds):
                nodes = M.fit_isolation_forest(df.where(fold != i), features, n, seed=seed, feature_share=share)
                scored = staged(M.score_isolation_forest(df.withColumn("__fold", fold), nodes, features).select("__fold", label, "anomaly_score"), "grid")
                shares = [1 - c for c in contaminations if c != "auto"]
                given = iter(order.quantiles(scored.where(F.col("__fold") != i), {"s": F.col("anomaly_score")}, shares)["s"] if shares else ())
                limits = [0.5 if c == "auto" else next(given) for c in contaminations]
                test = scored.where(F.col("__fold") == i)
                cells = [F.count(F.when(hit, 1)) for t in limits for hit in ((F.col("anomaly_score") > F.lit(t)) & (F.col(label) == 1), F.col("anomaly_score") > F.lit(t))]
                found = test.agg(F.sum(label), *cells).first()
                for j, c in enumerate(contaminations):
                    tp, flagged = found[1 + 2 * j], found[2 + 2 * j]
                    rows.append((n, share, str(c), 2.0 * tp / max(1, flagged + (found[0] or 0))))
    out = df.sparkSession.createDataFrame(rows, "trees int, feature_share double, contamination string, f1 double")
    return out.groupBy("trees", "feature_share", "contamination").agg(F.avg("f1").alias("f1")).orderBy(F.desc("f1"), "trees", "feature_share", "contamination")


#: Percentiles, caps and weights of the published search.
PERCENTILES, CAPS = (90, 93, 95, 97, 99), (0.6, 0.65, 0.7, 0.75, 0.8)
SCORE_WEIGHTS = [
    {"statistical_score": 0.3, "contextual_score": 0.4, "ml_score": 0.25, "collective_score": 0.05},
    {"statistical_score": 0.4, "contextual_score": 0.3, "ml_score": 0.2, "collective_score": 0.1},
    {"statistical_score": 0.25, "contextual_score": 0.25, "ml_score": 0.4, "collective_score": 0.1},
    {"statistical_score": 0.3, "contextual_score": 0.3, "ml_score": 0.3, "collective_score": 0.1},
]


def detector_grid(raw: DataFrame, weights: list[dict[str, float]] = SCORE_WEIGHTS, percentiles: tuple[float, ...] = PERCENTILES, caps: tuple[float, ...] = CAPS, label: str = "is_anomaly") -> DataFrame:
    """weights (their number), percentile, cap, threshold and metrics of every combination, from raw scores that are made once.

    As the adaptive detector does: scores are scaled to 0..1, weighed, summed and scaled again; rows from min(percentile, cap) on are flagged, none where
    all sums are equal. Bounds take two passes, all percentiles of all weights the passes of ``order.quantiles``, and all counts one; a score that the frame lacks counts as 0.
    """
    scores = sorted({c for w in weights for c in w} & set(raw.columns))
    found = P.bounds(raw, {c: F.col(c) for c in scores})
    rows = raw.select(label, *[P.scaled(F.col(c), *found[c]).alias(c) for c in scores])
    sums = [sum((F.col(c) * w.get(c, 0.0) for c in scores), F.lit(0.0)) for w in weights]
    ends = P.bounds(rows, {f"w{i}": s for i, s in enumerate(sums)})
    fused = staged(rows.select(label, *[P.scaled(s, *ends[f"w{i}"]).alias(f"w{i}") for i, s in enumerate(sums)]), "grid")
    limits = order.quantiles(fused, {f"w{i}": F.col(f"w{i}") for i in range(len(weights))}, [p / 100 for p in percentiles])
    combinations = [(i, float(p), float(cap), min(limits[f"w{i}"][j], cap) if limits[f"w{i}"][j] is not None else None) for i in range(len(weights)) for j, p in enumerate(percentiles) for cap in caps]
    hit = lambda i, t: (F.col(f"w{i}") >= t) if t is not None and ends[f"w{i}"][1] > ends[f"w{i}"][0] else F.lit(False)
    cells = [F.count(F.when(flag & (F.col(label) == y), 1)).alias(f"{n}_{cell}") for n, (i, _, _, t) in enumerate(combinations) for cell, flag, y in (("tp", hit(i, t), 1), ("fp", hit(i, t), 0), ("tn", ~hit(i, t), 0), ("fn", ~hit(i, t), 1))]
    each = [F.struct(F.lit(i).alias("weights"), F.lit(p).alias("percentile"), F.lit(cap).alias("cap"), F.lit(t).cast("double").alias("threshold"), *[F.col(f"{n}_{c}").alias(c) for c in ("tp", "fp", "tn", "fn")]) for n, (i, p, cap, t) in enumerate(combinations)]
    return V.with_rates(fused.agg(*cells).select(F.inline(F.array(*each))))


def best_of_grid(grid: DataFrame) -> DataFrame:
    """The combination with the best F1, the first of equals in the grid's order."""
    return grid.orderBy(F.desc_nulls_last("f1"), "percentile", "cap", "weights").limit(1)


def weight_grid(df: DataFrame, scores: list[str], weights: list[tuple[float, ...]], thresholds: list[float], label: str = "is_anomaly") -> DataFrame:
    """Metrics of every combination of weights and threshold, in one pass over the scores."""
    cells = []
    for i, w in enumerate(weights):
        parts = [F.col(s) * x for s, x in zip(scores, w, strict=True)]
        fused = sum(parts[1:], parts[0])
        for j, t in enumerate(thresholds):
            for cell, hit, y in (("tp", fused > t, 1), ("fp", fused > t, 0), ("tn", fused <= t, 0), ("fn", fused <= t, 1)):
                cells.append(F.count(F.when(hit & (F.col(label) == y), 1)).alias(f"{i}_{j}_{cell}"))
    row = df.agg(*cells)
    each = [F.struct(F.lit(i).alias("weights"), F.lit(float(t)).alias("threshold"), *[F.col(f"{i}_{j}_{c}").alias(c) for c in ("tp", "fp", "tn", "fn")]) for i in range(len(weights)) for j, t in enumerate(thresholds)]
    return V.with_rates(row.select(F.inline(F.array(*each))))
