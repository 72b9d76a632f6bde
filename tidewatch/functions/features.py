"""Feature expressions: columns of the JVM only, chosen from the input's schema when the plan is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Ports and protocol numbers.
COMMON_PORTS = [80, 443, 22, 21, 25, 53, 3389, 8080, 8443, 3306]
SUSPICIOUS_PORTS = [6667, 31337, 4444, 9001, 1337, 8080]
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}
NOT_FEATURES = {"row_id", "is_anomaly", "label", "class", "difficulty"}


def temporal(ts: Column) -> dict[str, Column]:
    day = F.weekday(ts)
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "is_working_hours": (F.hour(ts).between(9, 17) & (day < 5)).cast("int"),
        "month": F.month(ts),
        "day_of_month": F.dayofmonth(ts),
        "week_of_year": F.weekofyear(ts),
    }


def out_of_hours(ts: Column) -> Column:
    return ~(F.hour(ts).between(8, 18) & (F.weekday(ts) < 5))


def ip_bucket(ip: Column, buckets: int = 10_000) -> Column:
    """A stable bucket of an address (MD5: equal in every process and engine)."""
    return (F.conv(F.substring(F.md5(ip.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def port_class(port: Column) -> Column:
    """Common ports as they are; else 1 for system, 2 for registered and 3 for other ports."""
    return F.when(port.isin(COMMON_PORTS), port).when((port > 0) & (port < 1024), 1).when((port > 0) & (port < 49152), 2).otherwise(3)


def suspicious(port: Column) -> Column:
    return port.isin(SUSPICIOUS_PORTS).cast("int")


def protocol_number(protocol: Column) -> Column:
    out = F.lit(0)
    for name, number in PROTOCOLS.items():
        out = F.when(protocol == name, number).otherwise(out)
    return out


def is_protocol(df: DataFrame, name: str) -> Column:
    """1 where the protocol's text holds the name or its number is the name's."""
    column = "protocol_type" if "protocol_type" in df.columns else "protocol"
    text = F.lower(F.col(column).cast("string"))
    return F.coalesce((text.contains(name) | (text == F.lit(str(PROTOCOLS[name])))).cast("int"), F.lit(0))


def one_hot(column: str, values: list[str]) -> dict[str, Column]:
    return {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}


def rates(pad: float = 0.1) -> dict[str, Column]:
    return {"bytes_per_second": F.col("bytes") / (F.col("duration") + pad), "packets_per_second": F.col("packets") / (F.col("duration") + pad)}


def byte_ratios() -> dict[str, Column]:
    return {"bytes_ratio": F.try_divide(F.col("src_bytes"), F.col("dst_bytes") + 1), "total_bytes": F.col("src_bytes") + F.col("dst_bytes")}


def connection_rate() -> Column:
    return F.try_divide(F.col("count"), F.col("srv_count") + 1)


def positions(df: DataFrame, order: list[str], seconds: int = 10, start: str = "2023-01-01 00:00:00") -> DataFrame:
    """order (0 to n - 1), order_normalized (order / n) and a surrogate clock that advances so many seconds a row.

    Rows are ordered by ranges: each range is numbered by itself, and the counts of the ranges before it are added.
    """
    from ..sources.staging import Workspace

    parted = Workspace(df.sparkSession).keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in parted.groupBy("__part").count().collect()}  # a row per partition
    n, before, offsets = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    table = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = parted.withColumn("__rank", rank).join(F.broadcast(table), "__part").withColumn("order", (F.col("__rank") + F.col("__before")).cast("long")).drop("__part", "__rank", "__before")
    clock = F.timestamp_add("SECOND", F.col("order") * seconds, F.lit(start).cast("timestamp_ntz"))
    return out.withColumns({"order_normalized": F.col("order") / n if n else F.lit(0.0), "clock": clock})


def adaptive_pipeline(df: DataFrame, features: list[str], key: str = "src_ip", seconds: int = 60) -> DataFrame:
    """The adaptive detector's features in one go: temporal, network (counts, rates, flags of ports and protocols), derived and scaled numeric columns.

    Derived ones are those whose columns the frame has: byte ratio and total, connection rate, error sum, diversity; and is_dos_like, a
    count over the 95th percentile of all counts, which is selected first. ``categorise`` tells the result's numeric columns from the others.
    """
    from ..operators import order
    from ..sources.staging import staged

    own = set(df.columns)
    out = df.withColumns(temporal(F.col("timestamp")))
    out = window_counts(out, key, seconds).withColumns(rates())
    derived = (byte_ratios() if {"src_bytes", "dst_bytes"} <= own else {}) | ({"connection_rate": connection_rate()} if {"count", "srv_count"} <= own else {})
    out = staged(out.withColumns(derived | error_rates(df.columns)), "pipeline")
    crowd = order.quantile(out, "connection_count", 0.95)
    out = out.withColumn("is_dos_like", F.coalesce((F.col("connection_count") > F.lit(crowd)).cast("int"), F.lit(0)))
    out = out.withColumns({"port_class": port_class(F.col("dst_port")), "dst_port_suspicious": suspicious(F.col("dst_port")), "is_port_scan_like": port_scan_like(), "protocol_num": protocol_number(F.col("protocol"))})
    scaled = standardised(out.withColumns({f"scaled_{f}": F.col(f) for f in features}), [f"scaled_{f}" for f in features])
    return scaled


def error_rates(columns: list[str]) -> dict[str, Column]:
    """Sum of the error rates and mean of the diversity rates that are there; nulls are skipped."""
    errors = [c for c in ("serror_rate", "rerror_rate", "srv_serror_rate", "srv_rerror_rate") if c in columns]
    variety = [c for c in ("same_srv_rate", "diff_srv_rate", "srv_diff_host_rate") if c in columns]
    out = {}
    if errors:
        out["total_error_rate"] = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in errors[1:]), F.coalesce(F.col(errors[0]), F.lit(0.0)))
    if variety:
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in variety[1:]), F.coalesce(F.col(variety[0]), F.lit(0.0)))
        out["service_diversity"] = F.try_divide(total, sum((F.col(c).isNotNull().cast("int") for c in variety[1:]), F.col(variety[0]).isNotNull().cast("int")))
    return out


def port_scan_like() -> Column:
    return ((F.col("packets") <= 3) & (F.col("duration") < 0.5)).cast("int")


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window of a time without zone."""
    unix = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(unix / seconds) * seconds).cast("timestamp_ntz")


def window_counts(df: DataFrame, key: str, seconds: int, name: str = "connection_count") -> DataFrame:
    """How many rows share a row's time window and key. A count over a window needs one shuffle and no join back."""
    spec = Window.partitionBy(bucket(F.col("timestamp"), seconds), key)
    return df.withColumn(name, F.count(F.lit(1)).over(spec))


def categorise(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and other columns, label columns aside."""
    fields = [f for f in df.schema.fields if f.name not in NOT_FEATURES]
    return [f.name for f in fields if isinstance(f.dataType, T.NumericType)], [f.name for f in fields if not isinstance(f.dataType, T.NumericType)]


def aligned(df: DataFrame, features: list[str]) -> DataFrame:
    """Just these features in this order; absent ones are 0."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(0.0).alias(f) for f in features])


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, 1 for a deviation of 0; nulls become 0. One aggregate row, broadcast."""
    return standardised_by(df, df, columns)


def scale_of(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's mean and population deviation."""
    return train.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])


def scaled_by(df: DataFrame, scale: DataFrame, columns: list[str]) -> DataFrame:
    """``standardised`` with a row of ``scale_of``."""
    at = lambda c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")), F.lit(0.0))
    return df.crossJoin(F.broadcast(scale)).withColumns({c: at(c) for c in columns}).drop(*scale.columns)


def standardised_by(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """``standardised`` with the means and deviations of ``train``."""
    return scaled_by(df, scale_of(train, columns), columns)


def quintile(df: DataFrame, column: str, name: str, parts: int = 5) -> DataFrame:
    """Right-closed quantile code from linearly interpolated edges; equal edges are one. The edges are selected from ``df`` first."""
    from ..operators import order

    edges = order.quantiles(df, {column: F.col(column)}, [i / parts for i in range(parts + 1)])[column]
    inner = sorted({e for e in edges if e is not None})[1:-1]
    code = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), code))
