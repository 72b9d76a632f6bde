"""Principal components as a fitted table: fitted on one frame, kept beside a detector, and applied to any other in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def fit_projection(df: DataFrame, features: list[str], variance: float = 0.95, scale: bool = True) -> DataFrame:
    """position, feature, mean, deviation and loadings (one for each component kept): a row per feature.

    Features are standardised first (``scale``; else centred only), nulls count as their mean. As many components are kept
    as explain the share of variance; a share of 1 or more is their number.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre = [(stats[f"m{i}"] or 0.0, (stats[f"s{i}"] or 1.0) if scale else 1.0) for i in range(len(features))]
    ready = df.select(array_to_vector(F.array(*[_scaled(c, *centre[i]) for i, c in enumerate(features)])).alias("v"))
    model = PCA(k=len(features), inputCol="v").fit(ready)
    shares, kept, total = model.explainedVariance.toArray(), 0, 0.0
    while kept < len(shares) and (kept < variance if variance >= 1 else total < variance):
        total += float(shares[kept])
        kept += 1
    loadings = model.pc.toArray()[:, : max(1, kept)]
    rows = [(i, c, *centre[i], [float(x) for x in loadings[i]]) for i, c in enumerate(features)]
    return staged(df.sparkSession.createDataFrame(rows, "position int, feature string, mean double, deviation double, loadings array<double>").coalesce(1), "projection")


def _scaled(feature: str, mean: float, deviation: float):
    return F.coalesce((F.col(f"`{feature}`").cast("double") - mean) / (deviation or 1.0), F.lit(0.0))


def names(projection: DataFrame) -> list[str]:
    return [f"pc_{i}" for i in range(len(projection.first().loadings))]


def project(df: DataFrame, projection: DataFrame) -> DataFrame:
    """``df`` with columns pc_0, pc_1, ... A feature that the frame lacks counts as its mean."""
    rows = projection.orderBy("position").collect()  # a row per feature
    parts = [(_scaled(r.feature, r.mean, r.deviation), r.loadings) for r in rows if r.feature in df.columns]
    n = len(rows[0].loadings) if rows else 0
    return df.withColumns({f"pc_{i}": sum((x * own[i] for x, own in parts), F.lit(0.0)) for i in range(n)})
