"""Window functions over one order of a whole table, without one task for all of it.

Rows are range-partitioned by the order. Each range is given the rows that its windows reach: the last ``before`` rows of
the ranges in front of it and the first ``after`` rows of those behind (its halo), from several ranges where they are short. A window
function whose frame stays within that reach then runs range by range, and gives each row what it would give in one
order over everything. Halo rows are dropped again; every row of the table comes back once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import Workspace

RANGE, OWN = "__range", "__own"


def pulls(sizes: dict[int, int], before: int, after: int) -> list[tuple[int, int, int, int]]:
    """(range, target, first, last): the places of a range's rows that a target range reads besides its own.

    ``sizes``: rows of each range, a number a partition. A target asks only as many ranges as its reach needs.
    """
    order = sorted(sizes)
    out = []
    for i, target in enumerate(order):
        need, j = before, i - 1
        while need > 0 and j >= 0:
            out.append((order[j], target, max(0, sizes[order[j]] - need), sizes[order[j]] - 1))
            need, j = need - sizes[order[j]], j - 1
        need, j = after, i + 1
        while need > 0 and j < len(order):
            out.append((order[j], target, 0, min(sizes[order[j]], need) - 1))
            need, j = need - sizes[order[j]], j + 1
    return out


def over_ranges(df: DataFrame, order: list[str], before: int, after: int, compute: Callable[[DataFrame, list[str]], DataFrame], ranges: int | None = None) -> DataFrame:
    """``compute(rows, partition)`` in one order of all rows: windows by ``partition``, in ``order``, no wider than ``before`` and ``after``.

    ``order`` tells all rows apart. ``compute`` returns each of its rows once, with more columns. ``ranges``: how many, the
    session's shuffle partitions where not given.
    """
    spark = df.sparkSession
    if set(df.columns) & {RANGE, OWN, "__place", "__target", "__source"}:
        raise ValueError("column names that begin with __range, __own, __place, __target or __source are used here")
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ws = Workspace(spark)
    parted = ws.keep(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")
    by = Window.partitionBy(RANGE).orderBy(*order)
    sizes = {r[0]: r[1] for r in parted.groupBy(RANGE).count().collect()}  # a row per range
    own = parted.withColumn(OWN, F.lit(True))
    if len(sizes) > 1:
        reach = spark.createDataFrame(pulls(sizes, before, after), "__source int, __target int, __first long, __last long")
        placed = parted.withColumn("__place", F.row_number().over(by) - 1)
        halo = placed.join(F.broadcast(reach), (F.col(RANGE) == F.col("__source")) & F.col("__place").between(F.col("__first"), F.col("__last")))
        halo = halo.withColumn(RANGE, F.col("__target")).withColumn(OWN, F.lit(False)).select(*own.columns)
        own = own.unionByName(ws.keep(halo, "halo"))
    return compute(own, [RANGE]).where(OWN).drop(RANGE, OWN)
