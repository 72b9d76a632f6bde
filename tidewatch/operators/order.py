"""Order statistics of large columns: quantiles by bounded selection, and running sums without a single task.

Quantiles here are exact and linearly interpolated. A selection reads its frame a few times, however many columns and
shares it is for, and returns numbers, so a frame that is more than a scan is staged first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import Workspace

#: Values that a single buffer may hold; columns with more are narrowed to brackets first.
MOST = 100_000
#: Of ``percentile_approx``: ranks are off by n / ACCURACY at most.
ACCURACY = 10_000


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], most: int = MOST) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, nulls left out; None for a column without values.

    All columns and shares go together: one pass counts and, from sketches, gives each quantile a bracket that surely holds the
    ranks beside it; one counts what is below and inside each bracket; one picks the values at the ranks from inside. Columns of
    ``most`` values or fewer are picked in the second pass already. Brackets of over ``most`` different values are narrowed by two
    passes more, to a few thousandths of their rows each time.
    """
    values = df.select(*[c.cast("double").alias(name) for name, c in columns.items()])
    edge = 2 / ACCURACY
    edges = [min(1.0, max(0.0, s + d)) for s in shares for d in (-edge, edge)]
    col = lambda c: F.col(f"`{c}`")
    first = values.agg(*[x for i, c in enumerate(columns) for x in (F.count(col(c)).alias(f"n{i}"), F.percentile_approx(col(c), edges, ACCURACY).alias(f"e{i}"))]).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    small, open_ = [c for c in columns if 0 < counts[c] <= most], []
    for i, c in enumerate(columns):
        if counts[c] > most:
            for j, s in enumerate(shares):
                b = _Bracket(c, j, s * (counts[c] - 1), *first[f"e{i}"][2 * j : 2 * j + 2])
                if b.low == b.high:
                    out[c][j] = float(b.low)
                else:
                    open_.append(b)
    exact = [F.percentile(col(c), F.array(*[F.lit(s) for s in shares])).alias(f"q{i}") for i, c in enumerate(small)]
    while open_ or exact:
        inside = [F.when(col(b.column).between(b.low, b.high), col(b.column)) for b in open_]
        below = [F.count(F.when(col(b.column) < b.low, 1)).alias(f"b{i}") for i, b in enumerate(open_)]
        kinds = [x for i, v in enumerate(inside) for x in (F.count(v).alias(f"m{i}"), F.approx_count_distinct(v).alias(f"d{i}"))]
        row = values.agg(*exact, *below, *kinds).first()
        for i, c in enumerate(small if exact else ()):
            out[c] = list(row[f"q{i}"])
        exact, wide = [], []
        for i, b in enumerate(open_):
            shrunk = b.size is None or row[f"m{i}"] < b.size
            b.below, b.size = row[f"b{i}"], row[f"m{i}"]
            if row[f"d{i}"] > most and shrunk:
                wide.append(b)
        if not wide:
            break
        # What is inside gives each wide bracket a narrower one, by the ranks within it.
        held = [F.when(col(b.column).between(b.low, b.high), col(b.column)) for b in wide]
        row = values.agg(*[F.percentile_approx(v, b.edges(edge), ACCURACY).alias(f"e{i}") for i, (b, v) in enumerate(zip(wide, held, strict=True))]).first()
        for i, b in enumerate(wide):
            b.low, b.high = row[f"e{i}"]
        for b in [b for b in wide if b.low == b.high]:
            out[b.column][b.share] = float(b.low)
            open_.remove(b)
    for b, value in _picked(values, open_):
        out[b.column][b.share] = value
    return out


@dataclass
class _Bracket:
    """Values between which a quantile lies: of a column, for one of the shares, at a rank (with a part) among the column's values."""

    column: str
    share: int
    rank: float
    low: float
    high: float
    below: int = 0
    size: int | None = None

    def edges(self, slack: float) -> list[float]:
        at = lambda r, d: min(1.0, max(0.0, (r - self.below) / max(1, self.size - 1) + d))
        return [at(math.floor(self.rank), -slack), at(math.ceil(self.rank), slack)]


def _picked(values: DataFrame, brackets: list[_Bracket]) -> list[tuple[_Bracket, float]]:
    """The quantile of each bracket, from what it holds: counted by value, summed in order, and read at both ranks, in one job."""
    if not brackets:
        return []
    found = F.array(*[F.when((x := F.col(f"`{b.column}`")).between(b.low, b.high), F.struct(F.lit(i).alias("b"), x.alias("x"))) for i, b in enumerate(brackets)])
    counted = values.select(F.explode(F.array_compact(found)).alias("h")).groupBy("h.b", "h.x").agg(F.count(F.lit(1)).alias("n"))
    last = F.sum("n").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    ranks = F.array(*[F.array(F.lit(math.floor(b.rank) - b.below), F.lit(math.ceil(b.rank) - b.below)) for b in brackets])
    placed = counted.withColumn("last", last).withColumn("r", F.get(ranks, F.col("b")))
    at = lambda i: F.min(F.when(F.get("r", F.lit(i)) <= F.col("last"), F.col("x")))
    rows = {r.b: r for r in placed.groupBy("b").agg(at(0).alias("one"), at(1).alias("two")).collect()}  # a row per bracket
    return [(b, rows[i].one + (b.rank - math.floor(b.rank)) * (rows[i].two - rows[i].one)) for i, b in enumerate(brackets)]


def quantile(df: DataFrame, column: str | Column, share: float) -> float | None:
    return quantiles(df, {"x": F.col(column) if isinstance(column, str) else column}, [share])["x"][0]


def running(counts: DataFrame, keys: list[str], order: str, sums: list[str], *, descending: bool = False) -> DataFrame:
    """``counts`` with before_<sum>: what the rows of the same keys that come earlier in the order add up to.

    Rows are range-partitioned and each partition is summed once; the partitions' totals (one row per partition and key)
    give each partition what comes before it, so no task sorts more than its own range. Orders are unique within the keys.
    """
    ws, by = Workspace(counts.sparkSession), F.desc(order) if descending else F.asc(order)
    parted = ws.keep(counts.repartitionByRange(*keys, by).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = parted.groupBy(*keys, "__part").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums])
    within = Window.partitionBy(*keys, "__part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    rows = parted.withColumns({f"__w_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}).join(offsets, [*keys, "__part"])
    return rows.withColumns({f"before_{s}": F.col(f"__w_{s}") + F.col(f"__o_{s}") for s in sums}).select(*counts.columns, *[f"before_{s}" for s in sums])


def neighbours(values: DataFrame, column: str) -> DataFrame:
    """Distinct values (``column``) with the next larger one as ``above``, by ranges; the largest has none and is left out."""
    ws = Workspace(values.sparkSession)
    parted = ws.keep(values.repartitionByRange(F.asc(column)).withColumn("__part", F.spark_partition_id()), "ranges")
    firsts = parted.groupBy("__part").agg(F.min(column).alias("__first"))
    after = firsts.select("__part", F.lead("__first").over(Window.orderBy("__part")).alias("__next"))  # a row per partition
    above = F.lead(column).over(Window.partitionBy("__part").orderBy(column))
    return parted.withColumn("above", above).join(F.broadcast(after), "__part").withColumn("above", F.coalesce("above", "__next")).where("above is not null").select(column, "above")


def grouped_brackets(value: str, shares: list[float]) -> Column:
    """An aggregate: for each share, two values between which its quantile surely lies, in a group of ten times ``ACCURACY`` or more (from a sketch)."""
    return F.percentile_approx(value, [min(1.0, max(0.0, s + d)) for s in shares for d in (-2 / ACCURACY, 2 / ACCURACY)], ACCURACY)


def grouped_quantiles(long: DataFrame, keys: list[str], value: str, shares: list[float], brackets: DataFrame) -> DataFrame:
    """keys and q (array): exact quantiles of each large group, however large.

    ``brackets``: keys, ``n`` (the group's values) and ``edges`` (``grouped_brackets``). What lies below a bracket is counted in the
    tasks, what lies inside (a few thousandths of a large group) is counted by value, summed in order, and read at the ranks.
    """
    rows = long.join(brackets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "edges"), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    x, low, high = F.col(value), lambda i: F.get("edges", F.lit(2 * i)), lambda i: F.get("edges", F.lit(2 * i + 1))
    place = lambda i: F.struct(F.lit(i).alias("share"), F.when(x >= low(i), x).alias("x"))
    hits = F.array_compact(F.array(*[F.when(x <= high(i), place(i)) for i in range(len(shares))]))
    counted = rows.select(*keys, F.explode(hits).alias("h")).groupBy(*keys, "h.share", "h.x").agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(*keys, "share").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("__last", F.sum("__n").over(by) - 1)
    sized = placed.join(brackets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("n").alias("__size")), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    rank = F.get(F.array(*[F.lit(s) for s in shares]), F.col("share")) * (F.col("__size") - 1)
    at = lambda r: F.min(F.when(r <= F.col("__last"), F.col("x")))
    found = sized.groupBy(*keys, "share").agg(at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"), F.max(rank - F.floor(rank)).alias("f"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == i, F.col("a") + F.col("f") * (F.col("b") - F.col("a")))).alias(f"__q{i}") for i in range(len(shares))]).select(*keys, F.array(*[f"__q{i}" for i in range(len(shares))]).alias("q"))
