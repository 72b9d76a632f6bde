"""Streams: address history, profiles with quartiles, late rows counted over a query's life."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import sqltext as S
from tidewatch.operators import profiles as P
from tidewatch.sources import views
from tidewatch.streaming import history, traffic


def _files(df, order, path, parts):
    """``df`` in so many files, in order of time, for a stream that takes one of them a batch."""
    rows = df.orderBy(*order).collect()
    for i in range(parts):
        own = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        df.sparkSession.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
    return f"{path}/*"


def _run(stream, tmp_path, name, mode="append"):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None
    return run


def test_address_history_equals_the_batch_score(spark, small, tmp_path):
    """Flags and scores of a stream in several batches are those of one window over everything."""
    rnd, texts = random.Random(3), ["SELECT a FROM t WHERE id = {}", "SELECT version() FROM information_schema.tables WHERE id = {}", "SELECT a FROM (SELECT b FROM s WHERE c = {}) q UNION SELECT 1", "x"]
    rows = [(i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}.{rnd.randrange(10)}", rnd.choice(["a", "b", "c", None]), texts[min(i // 40, 3) if rnd.random() < 0.7 else rnd.randrange(4)].format(i if rnd.random() < 0.8 else 3)) for i in range(180)]
    made = spark.createDataFrame(rows, "row_id long, t string, ip string, query string").select("row_id", F.to_timestamp("t").alias("ts"), "ip", "query")
    given = views.sqltext(spark, small).where("row_id < 300").select((F.col("row_id") + 1000).alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), "ip", "query")
    both = made.unionByName(given)
    path = _files(both, ["ts", "row_id"], tmp_path / "in", 4)
    history.use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(path)
        run = _run(history.address_context(stream), tmp_path, "context")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.row_id: r for r in spark.table("context").collect()}
    expected = {r.row_id: r.context_score for r in S.context_score(both).select("row_id", "context_score").collect()}
    assert len(run.recentProgress) >= 4 and got.keys() == expected.keys()
    assert all(abs(got[i].context_score - x) < 1e-9 for i, x in expected.items())
    assert any(r.scan for r in got.values()) and any(r.escalates for r in got.values()) and any(r.probing for r in got.values()) and any(not r.scan for r in got.values())


def test_history_flags_equal_expressions(spark):
    rnd = random.Random(5)
    lists = [[rnd.choice([1, 2, 2, 3, 5, 9]) for _ in range(rnd.randint(0, 6))] for _ in range(200)]
    rows = spark.createDataFrame([(i, v, [x / 2 for x in v]) for i, v in enumerate(lists)], "i int, v array<long>, c array<double>")
    for r in rows.select("i", S.is_scan(F.col("v")).alias("scan"), S.escalates(F.col("c")).alias("up")).collect():
        v = lists[r.i]
        assert bool(r.scan) == history.scanning(v) and bool(r.up) == history.escalating([x / 2 for x in v]), v


def test_profiles_of_a_stream_have_quartiles(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = {"a": rng.exponential(100, 6000), "b": rng.normal(5, 1, 3000), "c": np.array([2.0])}
    rows = [(k, float(x), int(i)) for k, v in values.items() for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, ("a", None, 1)], "k string, x double, s int").select("k", "x", F.timestamp_seconds(1_700_000_000 + F.col("s") * 5).alias("ts"))
    path = _files(df, ["ts", "k"], tmp_path / "in", 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _run(traffic.profile_updates(stream, "k", "x"), tmp_path, "sketches", "complete")
    assert spark.table("sketches").count() > 8
    merged = traffic.merged_profile(spark.table("sketches"))
    got = {r.key: r for r in merged.collect()}
    for k, v in values.items():
        r, ordered = got[k], np.sort(v)
        assert (r.n, r.min, r.max) == (len(v), v.min(), v.max()) and abs(r.mean - v.mean()) < 1e-6 * abs(v.mean())
        for share, q in ((0.25, r.q1), (0.5, r.median), (0.75, r.q3)):
            lo, hi = np.searchsorted(ordered, q, "left") / len(v), np.searchsorted(ordered, q, "right") / len(v)
            assert lo - traffic.RANK_ERROR - 1 / len(v) <= share <= hi + traffic.RANK_ERROR + 1 / len(v)
    limits = {r.key: r.threshold for r in traffic.stream_thresholds(merged).collect()}
    exact = {r.feature: r.threshold for r in P.thresholds(P.profile(df.withColumnRenamed("x", "a").where("k = 'a'"), "c", [], ["a"])).collect()}
    assert abs(limits["a"] - exact["a"]) < 0.05 * exact["a"]


def test_late_rows_are_counted_over_all_batches(spark, tmp_path):
    """More batches than recent progress remembers; every late row counts once."""
    late = traffic.LateRows()
    spark.streams.addListener(late)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for i in range(14):
            rows = [(i * 10 + j, "k", 1.0, 1_700_000_000 + i * 600 - (9000 if i > 8 and j < 2 else 0)) for j in range(4)]
            spark.createDataFrame(rows, "event_id long, k string, value double, s long").select("event_id", "k", "value", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
        stream = spark.readStream.schema("event_id long, k string, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        run = _run(traffic.window_counts(stream, "k"), tmp_path, "late")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert len(run.recentProgress) <= 3 and late.batches[str(run.id)] >= 14
        assert late.of(run) == 2 * 5 and traffic.late_rows(run) < 10
    finally:
        spark.streams.removeListener(late)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
