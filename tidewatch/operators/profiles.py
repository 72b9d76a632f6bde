"""Behaviour profiles as long tables, thresholds, and the scores that are measured against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staged
from . import order, ordered

EPSILON = 1e-10
SENSITIVITY = {"low": 2.0, "medium": 3.0, "high": 4.0}
PROFILE = "context string, key string, feature string, n long, mean double, std double, median double, q1 double, q3 double, iqr double, min double, max double"


def unpivoted(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(f).cast("double").alias(f) for f in features], "feature", "x")


def _key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys]) if keys else F.lit("all")


def support(df: DataFrame) -> int:
    """The least rows of a port's or protocol and port's profile: a hundredth of all rows, at least 10."""
    return max(10, df.count() // 100)


def profile(df: DataFrame, context: str, keys: list[str], features: list[str], min_rows: int = 1) -> DataFrame:
    """One row per key and feature, for groups of any size.

    The first pass gives plain statistics and, from sketches, a bracket for each quartile; it is written once. The second gives exact
    quartiles: of groups up to ``order.MOST`` values in one buffer each, of larger ones from what lies inside their brackets.
    """
    long = unpivoted(df, keys, features).where("x is not null").select(_key(keys).alias("key"), "feature", "x")
    shares, own = [0.25, 0.5, 0.75], ["key", "feature"]
    plain = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    stats = staged(long.groupBy(*own).agg(*plain, order.grouped_brackets("x", shares).alias("edges")).where(F.col("n") >= min_rows), "profile")
    least, most = stats.agg(F.min("n"), F.max("n")).first()
    large, parts = F.col("n") > order.MOST, []
    if least is None or least <= order.MOST:
        few = long if most is None or most <= order.MOST else long.join(stats.where(~large).select(*own), own, "left_semi")
        parts.append(few.groupBy(*own).agg(F.percentile("x", F.array(*[F.lit(x) for x in shares])).alias("q")))
    if most is not None and most > order.MOST:
        parts.append(order.grouped_quantiles(long, own, "x", shares, stats.where(large)))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    q = [F.get("q", F.lit(i)) for i in range(3)]
    return stats.join(found, own).select(F.lit(context).alias("context"), "key", "feature", "n", "mean", "std", q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), "min", "max")


def profile_counts(profiles: DataFrame) -> DataFrame:
    """How many feature profiles each context holds."""
    return profiles.groupBy("context").agg(F.count(F.lit(1)).alias("profiles"))


def lookup(profiles: DataFrame, context: str, key: str | None = None, feature: str | None = None) -> DataFrame:
    """The rows of a context, of one of its keys or features: filters that reach the scan of stored profiles."""
    out = profiles.where(F.col("context") == context)
    out = out if key is None else out.where(F.col("key") == key)
    return out if feature is None else out.where(F.col("feature") == feature)


def threshold_of(limits: DataFrame, wanted: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """``wanted`` (feature) with its threshold times the multiplier; infinite where there is none."""
    return wanted.join(limits, "feature", "left").withColumn("threshold", F.coalesce(F.col("threshold"), F.lit(float("inf"))) * multiplier)


def moments(df: DataFrame, contexts: dict[str, tuple[list[str], int]], features: list[str]) -> DataFrame:
    """context, key, and mean and deviation of each feature, for several contexts (keys, least rows) in one pass: grouping sets.

    The table has a row per key of each context and is written once, as every context is joined by itself.
    """
    keys = list(dict.fromkeys(k for ks, _ in contexts.values() for k in ks))
    rows = df.select(*[F.col(k) for k in keys], *[F.col(f).cast("double").alias(f) for f in features])
    stats = [x for f in features for x in (F.avg(f).alias(f"mean_{f}"), F.stddev_samp(f).alias(f"std_{f}"))]
    sets = [[F.col(k) for k in ks] for ks, _ in contexts.values()]
    grouped = rows.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set"), *stats)
    number = lambda ks: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks)
    context, key, least = F.lit(None).cast("string"), F.lit("all"), F.lit(1)
    for name, (ks, n) in contexts.items():
        own = F.col("set") == number(ks)
        context, key, least = F.when(own, name).otherwise(context), F.when(own, _key(ks)).otherwise(key), F.when(own, n).otherwise(least)
    out = grouped.select(context.alias("context"), key.alias("key"), "n", least.alias("least"), *[f"{m}_{f}" for f in features for m in ("mean", "std")])
    return staged(out.where("n >= least").drop("least"), "moments")


def score_by(df: DataFrame, table: DataFrame, context: str, keys: list[str], features: list[str], name: str, sigmas: float) -> DataFrame:
    """The summed excess of a row's features over its key in a table of ``moments``."""
    prefix = f"__{name}"
    own = table.where(F.col("context") == context).select(F.col("key").alias(f"{prefix}_key"), *[F.col(f"{m}_{f}").alias(f"{prefix}_{m}_{f}") for f in features for m in ("mean", "std")])
    joined = df.withColumn(f"{prefix}_own", _key(keys)).join(own, F.col(f"{prefix}_own") == F.col(f"{prefix}_key"), "left")
    parts = [excess(F.col(f).cast("double"), F.col(f"{prefix}_mean_{f}"), F.col(f"{prefix}_std_{f}"), sigmas) for f in features]
    return joined.withColumn(name, sum(parts[1:], parts[0])).drop(*own.columns, f"{prefix}_own")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Share of each value; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def thresholds(stats: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """feature, threshold: the larger of mean + k deviations and q3 + 1.5 iqr; 1.5 means where that is under 1.2 means."""
    t = F.greatest(F.col("mean") + sigmas * F.col("std"), F.col("q3") + 1.5 * F.col("iqr"))
    return stats.select("feature", F.when(t < 1.2 * F.col("mean"), 1.5 * F.col("mean")).otherwise(t).alias("threshold"))


def quantile_thresholds(df: DataFrame, features: list[str], percentile: float) -> DataFrame:
    """One row with each feature's quantile."""
    found = order.quantiles(df, {f: F.col(f) for f in features}, [percentile / 100])
    return df.sparkSession.createDataFrame([tuple(found[f][0] for f in features)], ", ".join(f"`{f}` double" for f in features))


def excess(x: Column, mean: Column, std: Column, sigmas: float) -> Column:
    """How far |z| goes beyond ``sigmas``; 0 without a profile."""
    return F.coalesce(F.greatest(F.lit(0.0), F.abs(x - mean) / (std + EPSILON) - sigmas), F.lit(0.0))


def score_against(df: DataFrame, stats: DataFrame, keys: list[str], features: list[str], name: str, sigmas: float = 3.0) -> DataFrame:
    """The summed excess of a row's features over the profile of its key; a key without profile adds 0.

    A profile has a row per key, so Spark broadcasts it while it is small and joins by key beyond.
    """
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    table = stats.groupBy("key").agg(*[pick(f, c).alias(f"{c}_{f}") for f in features for c in ("mean", "std")])
    return score_by(df, table.withColumn("context", F.lit("own")), "own", keys, features, name, sigmas)


def bounds(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Least and largest value of each column, all in one aggregate; (0, 0) without values."""
    row = df.agg(*[f(c.cast("double")).alias(f"{n}_{name}") for name, c in columns.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"] or 0.0, row[f"hi_{c}"] or 0.0) for c in columns}


def scaled(column: Column, lo: float, hi: float) -> Column:
    """0 to 1 between the bounds; 0 where they are equal."""
    return F.coalesce((column - lo) / (hi - lo), F.lit(0.0)) if hi > lo else F.lit(0.0)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1; a constant one becomes 0. One aggregate reads ``df`` first; the result doesn't join it with itself."""
    found = bounds(df, {c: F.col(c) for c in columns})
    return df.withColumns({c: scaled(F.col(c), *found[c]) for c in columns})


def above_percentile(df: DataFrame, column: str, p: float, name: str, cap: float | None = None, inclusive: bool = False) -> DataFrame:
    """1 where the column exceeds its own percentile (or ``cap``, if that is less); 0 for all if it is constant.

    The percentile is selected from ``df`` first, in a few passes of bounded memory: stage a frame that is more than a scan.
    """
    lo, hi = bounds(df, {column: F.col(column)})[column]
    t = order.quantile(df, column, p)
    if t is None or hi <= lo:
        return df.withColumn(name, F.lit(0))
    t = t if cap is None else min(t, cap)
    return df.withColumn(name, F.coalesce(((F.col(column) >= t) if inclusive else (F.col(column) > t)).cast("int"), F.lit(0)))


def collective_spikes(df: DataFrame, features: list[str], partition: list[str], order: list[str], width: int = 10) -> DataFrame:
    """Sudden changes in order, within each partition: in every window of ``width`` rows, a step over three times
    the window's mean step adds its excess to the rows at both its ends.

    The means of the windows that a step belongs to are gathered by a frame of at most width - 1 rows, so each
    partition is streamed once, whatever its length. Without a partition the order is the whole table's, in ranges.
    """
    if not partition:
        return ordered.over_ranges(df, order, width, width, lambda rows, own: collective_spikes(rows, features, own, order, width))
    by = Window.partitionBy(*partition).orderBy(*order)
    total = F.lit(0.0)
    for f in features:
        step, mean, full = f"__step_{f}", f"__mean_{f}", f"__full_{f}"
        frame = by.rowsBetween(-(width - 2), 0)
        df = df.withColumn(step, F.abs(F.col(f) - F.lag(f).over(by)))
        df = df.withColumn(mean, F.avg(step).over(frame)).withColumn(full, F.count(step).over(frame) == width - 1)
        means = F.collect_list(F.when(F.col(full), F.col(mean))).over(by.rowsBetween(0, width - 2))
        hits = F.aggregate(F.filter(means, lambda m: (m != 0) & (F.col(step) > 3 * m)), F.lit(0.0), lambda acc, m: acc + F.col(step) / (m + EPSILON) - 3)
        df = df.withColumn(f"__hit_{f}", F.when(F.col(step).isNull(), 0.0).otherwise(hits))
        total = total + F.col(f"__hit_{f}") + F.coalesce(F.lead(f"__hit_{f}").over(by), F.lit(0.0))
    return df.withColumn("collective_score", total).drop(*[f"__{x}_{f}" for f in features for x in ("step", "mean", "full", "hit")])
