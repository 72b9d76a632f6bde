"""Views of the given tables: network traffic and SQL text out of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = [80, 443, 22, 31337, 53, 8080, 4444, 25, 3389, 50000, 1024, 8443]

#: Query texts by event number; {u} is the user, {k} the number in the event's properties.
TEMPLATES = [
    "SELECT name FROM items WHERE id = {k}",
    "SELECT a, b FROM orders WHERE user_id = {u} AND k = {k}",
    "INSERT INTO logs (u, k) VALUES ({u}, {k})",
    "UPDATE items SET price = {k} WHERE id = {u}",
    "SELECT * FROM users WHERE id = {u} OR 1=1",
    "SELECT a FROM t WHERE x = '{u}' OR '1'='1'",
    "SELECT a FROM t WHERE id = {k} UNION SELECT name FROM users",
    "SELECT a FROM t; DROP TABLE users",
    "SELECT a FROM t WHERE id = {k} -- note",
    "SELECT SLEEP({k})",
    "SELECT a FROM t; WAITFOR DELAY '0:0:{k}'",
    "EXEC xp_cmdshell 'dir {k}'",
    "SELECT a FROM t INTO OUTFILE '/tmp/{k}'",
    "SELECT CONVERT(int, name) FROM t WHERE a IS NULL",
    "SELECT a FROM t WHERE id = {k} ORDER BY 5",
    "SELECT CHAR(65) FROM t LIMIT 1, {k}",
    "SELECT a FROM t JOIN s ON t.id = s.id GROUP BY a HAVING count(*) > {k}",
    "SELECT a FROM t WHERE b = 'it",
    "SELECT version() FROM information_schema.tables",
    "DELETE FROM carts WHERE user_id = {u}",
    "SELECT COALESCE(a, {k}) FROM t WHERE b LIKE '%{u}%'",
    "SELECT a FROM (SELECT b FROM s WHERE c = {k}) q",
    "SELECT CASE WHEN a > {k} THEN 1 ELSE 2 END FROM t",
    "SELECT a FROM t WHERE id%20=%20{k}",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic records: row_id, timestamp, src_ip, service, bytes, packets, duration, dst_port, protocol, flag, is_anomaly."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.col("event_id")
    ports = F.array(*[F.lit(p) for p in PORTS])
    kind = F.pmod(event, F.lit(10))
    return table(spark, sf_dir, "events").select(
        event.alias("row_id"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("src_ip"),
        F.col("event_type").alias("service"),
        (F.col("value") * 20).alias("bytes"),
        (1 + F.pmod(k, F.lit(20))).cast("long").alias("packets"),
        (F.pmod(event, F.lit(100)).cast("double") / 10).alias("duration"),
        F.get(ports, F.pmod(k, F.lit(len(PORTS)))).alias("dst_port"),
        F.when(kind < 7, "tcp").when(kind < 9, "udp").otherwise("icmp").alias("protocol"),
        F.when(F.col("event_type") == "error", "S0").otherwise("SF").alias("flag"),
        F.coalesce((F.col("event_type") == "error").cast("int"), F.lit(0)).alias("is_anomaly"),
    )


def sqltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts: row_id, ts, ip, query."""
    k = F.get_json_object("props", "$.k").cast("int").cast("string")
    user = F.col("user_id").cast("string")
    text = F.get(F.array(*[F.lit(t) for t in TEMPLATES]), F.pmod("event_id", F.lit(len(TEMPLATES))).cast("int"))
    query = F.replace(F.replace(text, F.lit("{u}"), user), F.lit("{k}"), k)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "ts", user.alias("ip"), query.alias("query"))


def number_or_null(df: DataFrame) -> DataFrame:
    """Infinite and NaN doubles become null, so that comparisons and aggregates skip them."""
    kinds = {c for c, t in df.dtypes if t in ("double", "float")}
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), None).otherwise(F.col(c))
    return df.select(*[clean(c).alias(c) if c in kinds else F.col(c) for c in df.columns])
