"""Samples and splits by hashed keys: the same rows in every run and engine, without a shuffle where the share is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hashed(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def bucket(key: str, buckets: int = 1000, seed: int = 42) -> Column:
    return (F.conv(F.substring(hashed(key, seed), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def split(df: DataFrame, key: str, shares: list[float], seed: int = 42) -> list[DataFrame]:
    """Parts of about these shares; every row is in one part. Strata keep their proportions on the whole, as the hash knows none."""
    edges, b = [0.0], bucket(key, 1000, seed)
    for s in shares:
        edges.append(edges[-1] + s)
    edges[-1] = 1.0
    return [df.where((b >= round(1000 * lo)) & (b < round(1000 * hi))) for lo, hi in zip(edges, edges[1:], strict=False)]


def stratified_split(df: DataFrame, key: str, stratum: str, shares: list[float], seed: int = 42) -> DataFrame:
    """``df`` with ``part``: in each stratum exactly these shares (rounded), by the order of hashed keys.

    Rows are ordered by ranges of (stratum, hash), and each range's ranks go on from those before it, so a hot stratum is many tasks.
    """
    from . import order

    keyed = df.select(F.col(key).alias("__key"), F.col(stratum).cast("string").alias("__stratum"), hashed(key, seed).alias("__hash"), F.lit(1).alias("__n"))
    keyed = keyed.withColumns({"__stratum": F.coalesce("__stratum", F.lit("null")), "__hash": F.concat("__hash", F.lit(":"), F.coalesce(F.col("__key").cast("string"), F.lit("")))})
    placed = order.running(keyed, ["__stratum"], "__hash", ["__n"])
    sizes = placed.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__size"))
    part, edge = F.lit(len(shares) - 1), 0.0
    for i, s in list(enumerate(shares))[:-1][::-1]:
        edge = sum(shares[: i + 1])
        part = F.when(F.col("before___n") < F.round(edge * F.col("__size")), i).otherwise(part)
    parts = placed.join(sizes, "__stratum").select("__key", part.alias("part"))
    return df.join(parts, df[key].eqNullSafe(parts["__key"]), "left").drop("__key")


def without(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``taken``'s."""
    return df.join(taken.select(key).distinct(), key, "left_anti")


def per_stratum(df: DataFrame, stratum: str, key: str, most: dict[int, int], seed: int = 42) -> DataFrame:
    """At most so many rows of each stratum, by hash; each task keeps no more than that before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hashed(key, seed), key))
    top = max(most.values())
    limit = F.lit(0)
    for value, n in most.items():
        limit = F.when(F.col(stratum) == value, n).otherwise(limit)
    return df.withColumn("__rank", rank).where(F.col("__rank") <= top).where(F.col("__rank") <= limit).drop("__rank")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer): a top-n by hash."""
    return df.orderBy(hashed(key, seed), key).limit(n)
