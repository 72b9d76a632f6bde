"""File sources and sinks, and synthetic traffic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..operators import order
from ..operators import sampling as Z
from .staging import staged

#: Values of a text column that may get a column each without being named; more are an error, never left out.
MOST_VALUES = 1000

# The columns of the KDD-99 connection records, in order.
KDD_TEXT = ["protocol_type", "service", "flag"]
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate",
]


def _kdd_schema(*more: str) -> str:
    kind = lambda c: "string" if c in KDD_TEXT else "double" if c.endswith("_rate") else "long"
    return ", ".join([*(f"{c} {kind(c)}" for c in KDD_COLUMNS), *more])


def read_kdd(spark: SparkSession, path: str, sample_size: int | None = None) -> DataFrame:
    """KDD-99 records (CSV without header, also gzipped) with is_anomaly; ``sample_size``: the first so many rows."""
    df = spark.read.schema(_kdd_schema("label string")).csv(path)
    df = df.limit(sample_size) if sample_size else df
    return df.withColumn("is_anomaly", (F.col("label") != "normal.").cast("int"))


def prepare_kdd(df: DataFrame, values: dict[str, list[str]] | None = None) -> DataFrame:
    """Features of KDD records: one-hot text columns, logarithms, byte ratio, error sum, diversity and connection rate; numbers standardised.

    ``values``: the values that get a column each, by text column; all those found in ``df``, where not given
    (``ValueError`` where they are more than ``MOST_VALUES``: a table that wide has to be asked for by name).
    """
    hot = {}
    for c in KDD_TEXT:
        hot |= X.one_hot(c, (values or {}).get(c) or _values(df, c))
    logs = {f"{c}_log": F.log1p(c) for c in ("duration", "src_bytes", "dst_bytes", "count", "srv_count")}
    out = df.withColumns(hot | logs).drop(*KDD_TEXT)
    numbers = [c for c in KDD_COLUMNS if c not in KDD_TEXT] + list(logs)
    out = X.standardised(out, numbers)
    return out.withColumns({"bytes_ratio": X.byte_ratios()["bytes_ratio"], "error_rate_sum": F.col("serror_rate") + F.col("rerror_rate"), "service_diversity": (F.col("diff_srv_rate") + F.col("dst_host_diff_srv_rate")) / 2, "connection_rate": X.connection_rate()})


def _values(df: DataFrame, column: str) -> list[str]:
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise ValueError(f"{column} has over {MOST_VALUES} values: name those that get a column each")
    return sorted(r[0] for r in found)


def load_kdd(spark: SparkSession, path: str, sample_size: int | None = 20_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test part (70 and 30 per cent of each class) of prepared KDD records."""
    rows = staged(prepare_kdd(read_kdd(spark, path, sample_size)).withColumn("row_id", F.monotonically_increasing_id()), "kdd")
    parts = staged(Z.stratified_split(rows, "row_id", "is_anomaly", [0.7, 0.3], seed), "kdd_parts")
    return parts.where("part = 0").drop("part"), parts.where("part = 1").drop("part")


def read_nsl_kdd(spark: SparkSession, path: str, sample_size: int | None = None, seed: int = 42, header: bool = False, codes: bool = False) -> DataFrame:
    """NSL-KDD records without ``class`` and ``difficulty``, with is_anomaly; ``sample_size``: an exact sample by hashed rows.

    ``header``: as ``prepare_nsl_kdd`` writes them (``codes``: its text columns are numbers).
    """
    schema = _kdd_schema("class string", "difficulty long", *(["is_anomaly int"] if header else []))
    for c in KDD_TEXT if codes else []:
        schema = schema.replace(f"{c} string", f"{c} int")
    df = spark.read.schema(schema).option("header", header).csv(path)
    df = df if header else df.withColumn("is_anomaly", (F.col("class") != "normal").cast("int"))
    if sample_size:
        df = df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(sample_size)
    return df.drop("class", "difficulty")


def prepare_nsl_kdd(spark: SparkSession, source: str, target: str) -> None:
    """Headerless records to CSV with a header, is_anomaly and alphabetical category codes (fitted on this file)."""
    df = spark.read.schema(_kdd_schema("class string", "difficulty long")).csv(source).withColumn("is_anomaly", (F.col("class") != "normal").cast("int"))
    coded, _ = category_codes(df, df)
    write_csv(coded.select(*KDD_COLUMNS, "class", "difficulty", "is_anomaly"), target)


def category_codes(train: DataFrame, other: DataFrame, columns: list[str] = KDD_TEXT) -> tuple[DataFrame, DataFrame]:
    """Alphabetical codes fitted on ``train`` and applied to both; values unknown to it get -1, nulls stay null.

    Values are ranked by ranges and join back by value, so a column of many values costs a shuffle, not a task.
    """
    for c in columns:
        values = train.where(F.col(c).isNotNull()).select(F.col(c).alias("__value")).distinct().withColumn("__one", F.lit(1))
        table = staged(order.running(values, [], "__value", ["__one"]).select("__value", F.col("before___one").cast("int").alias("__code")), "codes")
        code = lambda df: df.join(table, F.col(c) == F.col("__value"), "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("__code", F.lit(-1)))).drop("__value", "__code")  # noqa: B023, E731
        train, other = code(train), code(other)
    return train, other


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def load_profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _exponential(mean: float, seed: int) -> Column:
    return -F.log(1 - F.rand(seed)) * mean


def synthetic_traffic(spark: SparkSession, n: int = 1000, anomaly_ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Minute-spaced traffic whose anomalies are of four kinds: volume x 10, suspicious port, night hour, packet rate x 20."""
    ids = spark.range(n).withColumn("is_anomaly", (F.rand(seed) < anomaly_ratio).cast("int"))
    kind = F.when(F.col("is_anomaly") == 1, F.floor(F.rand(seed + 1) * 4)).otherwise(-1)
    df = ids.withColumn("kind", kind)
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    night = F.when(F.col("kind") == 2, F.make_dt_interval(F.lit(0), (3 - F.hour(F.timestamp_add("MINUTE", F.col("id"), start))).cast("int"))).otherwise(F.make_dt_interval())
    df = df.select(
        "id",
        (F.timestamp_add("MINUTE", F.col("id"), start) + night).alias("timestamp"),
        (_exponential(1000, seed + 2) * F.when(F.col("kind") == 0, 10).otherwise(1)).alias("bytes"),
        ((1 + _exponential(10, seed + 3)) * F.when(F.col("kind") == 3, 20).otherwise(1)).alias("packets"),
        _exponential(30, seed + 4).alias("duration"),
        F.when(F.rand(seed + 5) < 0.7, 6).otherwise(17).alias("protocol_num"),
        F.when(F.col("kind") == 1, 31337).otherwise(F.when(F.rand(seed + 6) < 0.5, 80).otherwise(443)).alias("dst_port"),
        "is_anomaly",
    )
    return df.withColumns({"bytes_per_second": F.col("bytes") / (F.col("duration") + 1), "packets_per_second": F.col("packets") / (F.col("duration") + 1)})


def _poisson(mean: float, draw: Column) -> Column:
    """A Poisson draw by its cumulative shares: how many of them the uniform draw exceeds."""
    shares, p, total = [], math.exp(-mean), 0.0
    for i in range(1, 60):
        total += p
        shares.append(total)
        p *= mean / i
    return sum((F.when(draw > s, 1).otherwise(0) for s in shares if s < 1), F.lit(0))


def _gamma(n: int, seed: int) -> Column:
    return sum((_exponential(1.0, seed + i) for i in range(1, n)), _exponential(1.0, seed))


def _beta(one: str, two: str) -> Column:
    """A beta draw from two gamma draws."""
    return F.col(one) / (F.col(one) + F.col(two))


def _pick(values: list, draw: Column, shares: list[float] | None = None) -> Column:
    """One of the values, by cumulative shares (equal ones, where not given) of a uniform draw."""
    shares = shares or [1 / len(values)] * len(values)
    out, total = F.lit(values[-1]), 1.0
    for v, s in list(zip(values, shares, strict=True))[:-1][::-1]:
        total = sum(shares[: values.index(v) + 1])
        out = F.when(draw < total, v).otherwise(out)
    return out


def synthetic_points(spark: SparkSession, n: int = 10_000, anomaly_ratio: float = 0.05, n_features: int = 10, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Gaussian features with point, contextual and collective anomalies (a third each), dressed as traffic with attacks' marks.

    Point anomalies lie at five deviations with a spread of five; contextual ones have two features turned round three times over; collective ones
    share one direction. Of the anomalies, three in ten each look like a flood, a port scan, or use unusual ports (these may overlap).
    """
    # Every draw is a column of its own: used in several places, it is the same number in all of them.
    draw = lambda i: F.col(f"__d{i}")
    gammas = {"__g10": (10, 2000), "__g1": (1, 2100), "__g1b": (1, 3000), "__g20": (20, 3100), "__g5": (5, 4000), "__g1c": (1, 4100), "__g1d": (1, 5000), "__g30": (30, 5100)}
    drawn = {f"__d{i}": F.rand(seed + 1000 + i) for i in range(22)} | {c: _gamma(k, seed + at) for c, (k, at) in gammas.items()}
    df = spark.range(n).withColumns(drawn).withColumn("row_id", F.col("id")).withColumn("is_anomaly", (F.rand(seed) < anomaly_ratio).cast("int"))
    df = df.withColumn("kind", F.when(F.col("is_anomaly") == 1, _pick(["point", "contextual", "collective"], draw(0))).otherwise("normal"))
    df = df.withColumns({"__turn": F.floor(draw(1) * n_features), "__step": 1 + F.floor(draw(2) * (n_features - 1)), "__common": F.randn(seed + 3)})
    turned = lambda i: (F.col("__turn") == i) | (F.pmod(F.col("__turn") + F.col("__step"), F.lit(n_features)) == i)
    df = df.withColumns({f"__x{i}": F.randn(seed + 10 + i) for i in range(n_features)})
    for i in range(n_features):
        x = F.col(f"__x{i}")
        own = F.when(F.col("kind") == "point", 5 * x + 5).when((F.col("kind") == "contextual") & turned(i), -3 * x).when(F.col("kind") == "collective", F.col("__common") * (n_features / 2 + i % 3) + 0.5 * x).otherwise(x)
        df = df.withColumn(f"feature_{i}", own + noise * F.randn(seed + 500 + i))
    bad = F.col("is_anomaly") == 1
    df = df.withColumns({"__flood": bad & (draw(3) < 0.3), "__scan": bad & (draw(4) < 0.3), "__odd": bad & (draw(5) < 0.3)})
    flood, scan = F.col("__flood"), F.col("__scan")
    services, flags = ["http", "ftp", "smtp", "ssh", "dns", "pop3", "imap", "ldap", "ntp"], ["SF", "S0", "REJ", "RSTO", "RSTR", "SH", "S1", "S2", "S3", "OTH"]
    flag = F.when(bad, _pick(["S0", "REJ", "RSTO"], draw(6))).otherwise(_pick(flags, draw(7), [0.7, 0.1, 0.05, 0.03, 0.03, 0.02, 0.02, 0.02, 0.02, 0.01]))
    packets = (1 + F.floor(F.log(1 - draw(8)) / math.log(0.9))).cast("long")
    common = _pick([80, 443, 22, 23, 25, 53, 110, 143, 3389], draw(9))
    df = df.withColumns(
        {
            "timestamp": F.timestamp_add("MINUTE", F.col("id"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")),
            "protocol": _pick([6, 17, 1], draw(10), [0.8, 0.15, 0.05]),
            "src_port": (1024 + F.floor(draw(11) * 64_511)).cast("int"),
            "dst_port": F.when(F.col("__odd"), _pick(X.SUSPICIOUS_PORTS, draw(12))).when(draw(13) < 0.75, common).otherwise((1024 + F.floor(draw(14) * 8976)).cast("int")),
            "duration": F.when(scan, 0.001 + 0.099 * draw(15)).otherwise(_exponential(10, seed + 16)),
            "bytes": _exponential(1000, seed + 17) * F.when(flood, 5).otherwise(1),
            "packets": F.when(scan, 1 + F.floor(draw(18) * 2)).otherwise(packets * F.when(flood, 10).otherwise(1)).cast("long"),
            "service": _pick(services, draw(19)),
            "flag": flag,
            "count": _poisson(3, draw(20)) * F.when(flood, 5).otherwise(1),
            "srv_count": _poisson(2, draw(21)) * F.when(flood, 5).otherwise(1),
            "serror_rate": F.when(scan, _beta("__g10", "__g1")).otherwise(_beta("__g1b", "__g20")),
            "rerror_rate": F.when(scan, _beta("__g5", "__g1c")).otherwise(_beta("__g1d", "__g30")),
        }
    )
    return df.withColumns(X.one_hot("service", services) | X.one_hot("flag", flags)).drop("id", "kind", "service", "flag", "__turn", "__step", "__common", "__flood", "__scan", "__odd", *drawn, *[f"__x{i}" for i in range(n_features)])


def load_synthetic(spark: SparkSession, n: int = 10_000, anomaly_ratio: float = 0.05, n_features: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test part (70 and 30 per cent of each class) of synthetic points, measures standardised."""
    rows = synthetic_points(spark, n, anomaly_ratio, n_features, seed=seed)
    numbers = [*[f"feature_{i}" for i in range(n_features)], "duration", "bytes", "packets", "count", "srv_count", "serror_rate", "rerror_rate"]
    rows = staged(X.standardised(staged(rows, "points"), numbers), "synthetic")
    parts = staged(Z.stratified_split(rows, "row_id", "is_anomaly", [0.7, 0.3], seed), "synthetic_parts")
    return parts.where("part = 0").drop("part"), parts.where("part = 1").drop("part")
