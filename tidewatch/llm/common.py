"""Helpers that the training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import Workspace, release, scratch_dir, staged

__all__ = ["Workspace", "release", "scratch_dir"]

#: Stands for a null id wherever rows are ordered or joined by id: null sorts before every id.
NULL_KEY = -(1 << 63)
#: A document among others, in this order: its id, then two seeded 64-bit hashes of its text. Rows equal in id and text are one document.
KEY = ["k", "t", "u"]
#: A shuffle's partitions hold about so many bytes of input at most.
PARTITION_BYTES = 128 << 20

#: White space as the word and line rules of this package understand it.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    return staged(df, label)


def order_key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY))


def text_hashes(text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows of one id apart."""
    data = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return F.xxhash64(data), F.xxhash64(F.lit(7), data)


def document_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    t, u = text_hashes(text_col)
    return [order_key(id_col).alias("k"), t.alias("t"), u.alias("u")]


def keyed(docs: DataFrame) -> DataFrame:
    """k, t, u, doc_id, text: what the operators on whole documents work on."""
    return docs.select(*document_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def compact(base: DataFrame) -> DataFrame:
    """``keyed`` rows whose text hashes are 0 where no id has two texts: then ids alone tell documents apart, in 16 bytes less a row."""
    hashes = [f("t") for f in (F.min, F.max)] + [f("u") for f in (F.min, F.max)]
    spread = base.groupBy("k").agg(*[h.alias(n) for h, n in zip(hashes, ("t0", "t1", "u0", "u1"), strict=True)]).where("t0 <> t1 or u0 <> u1")
    return base.withColumns({"t": F.lit(0).cast("long"), "u": F.lit(0).cast("long")}) if spread.isEmpty() else base


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ... and these names by the old ones: then no name of a table meets one that an operator uses."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def partitions_for(df: DataFrame, growth: float = 1.0) -> int:
    """Shuffle partitions for rows made from ``df``: the session's number, or more where its input is large.

    ``growth``: bytes shuffled per byte that ``df`` reads, roughly. Sizes are those the optimizer knows from the files, so ``df``
    is a scan or what filters and maps make of one; a join's size isn't known before it has run.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, math.ceil(size * growth / PARTITION_BYTES))
