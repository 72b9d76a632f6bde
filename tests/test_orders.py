"""Orders over whole tables: ranges with a halo, and quantiles in shared passes."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import ordered


@pytest.mark.parametrize(("rows", "ranges", "before", "after"), [(200, 6, 5, 3), (40, 20, 10, 12), (7, 16, 9, 9), (1, 4, 3, 3), (0, 4, 3, 3), (60, 1, 4, 4)])
def test_ranges_equal_one_window(spark, rows, ranges, before, after):
    """Also where ranges are shorter than the reach, of which a range may need several."""
    rnd = random.Random(rows)
    data = [(i, rnd.choice([1, 2, 2, 3, None]), rnd.random()) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, t int, x double").repartition(3)

    def windows(frame, partition):
        by = Window.partitionBy(*partition).orderBy("t", "id")
        return frame.withColumns({"lag": F.lag("x", before).over(by), "lead": F.lead("x", after).over(by), "sum": F.sum("x").over(by.rowsBetween(-before, after)), "n": F.count("x").over(by.rowsBetween(-before, -1))})

    got = ordered.over_ranges(df, ["t", "id"], before, after, windows, ranges)
    expected = windows(df, [])
    rounded = lambda f: sorted((r.id, r.t, r.lag, r.lead, r["sum"] and round(r["sum"], 9), r.n) for r in f.collect())
    assert got.columns == expected.columns and sorted(map(str, rounded(got))) == sorted(map(str, rounded(expected)))


def test_ranges_run_in_many_tasks(spark):
    df = spark.range(1000).withColumn("x", F.rand(1))
    seen = ordered.over_ranges(df, ["id"], 2, 2, lambda frame, part: frame.withColumn("r", F.col(part[0])), 8).groupBy("r").count().collect()
    assert len(seen) == 8 and sum(r["count"] for r in seen) == 1000 and max(r["count"] for r in seen) < 300


def test_pulls_reach_over_short_ranges():
    assert ordered.pulls({0: 5, 1: 1, 2: 2, 3: 4}, 4, 2) == [(1, 0, 0, 0), (2, 0, 0, 0), (0, 1, 1, 4), (2, 1, 0, 1), (1, 2, 0, 0), (0, 2, 2, 4), (3, 2, 0, 1), (2, 3, 0, 1), (1, 3, 0, 0), (0, 3, 4, 4)]


def test_names_in_use_are_refused(spark):
    with pytest.raises(ValueError, match="__range"):
        ordered.over_ranges(spark.range(3).withColumn("__range", F.lit(1)), ["id"], 1, 1, lambda f, p: f)


def _jobs(spark, run):
    """What ``run`` returns, and how many passes it made Spark run: jobs, where adaptive execution doesn't cut them into stages."""
    spark.sparkContext.setJobGroup("passes", "passes")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("passes"))
    try:
        out = run()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    count = len(spark.sparkContext.statusTracker().getJobIdsForGroup("passes")) - before
    spark.sparkContext._jsc.clearJobGroup()
    return out, count


@pytest.mark.parametrize("most", [100_000, 500, 20])
def test_quantiles_of_many_columns_share_their_passes(spark, most):
    import numpy as np

    rng = np.random.default_rng(most)
    n = 20_000
    table = {"a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float), "c": rng.exponential(size=n).round(2), "d": np.arange(n) * 1.0, "e": np.zeros(n), "f": np.where(rng.random(n) < 0.9, 3.0, rng.random(n))}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in table.values()), strict=True)), ", ".join(f"{c} double" for c in table)).withColumn("g", F.lit(None).cast("double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    from tidewatch.operators import order

    got, passes = _jobs(spark, lambda: order.quantiles(df, {c: F.col(c) for c in [*table, "g"]}, shares, most))
    for c, v in table.items():
        assert np.allclose(got[c], np.quantile(v, shares)), c
    assert got["g"] == [None] * 6 and passes <= 3


def test_wide_brackets_are_narrowed(spark, monkeypatch):
    import numpy as np

    from tidewatch.operators import order

    monkeypatch.setattr(order, "ACCURACY", 20)
    x = np.random.default_rng(3).normal(size=30_000)
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "x double, y double")
    got, passes = _jobs(spark, lambda: order.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, [0.3, 0.9], 200))
    assert np.allclose(got["x"], np.quantile(x, [0.3, 0.9])) and np.allclose(got["y"], np.quantile(-x, [0.3, 0.9])) and 4 < passes < 10


def test_profiles_of_groups_of_any_size(spark, monkeypatch):
    import numpy as np

    from tidewatch.operators import order
    from tidewatch.operators import profiles as P

    monkeypatch.setattr(order, "ACCURACY", 50)
    monkeypatch.setattr(order, "MOST", 600)
    rng = np.random.default_rng(8)
    rows = [(["big", "tie", None][min(i % 10, 2) if i < 5000 else 0], float(v), float(i % 3)) for i, v in enumerate(rng.normal(size=9000))] + [("one", 4.0, None), ("two", 1.0, 2.0), ("two", 2.0, 2.0)]
    got = {(r.key, r.feature): r for r in P.profile(spark.createDataFrame(rows, "k string, x double, y double"), "c", ["k"], ["x", "y"]).collect()}
    for key in ("big", "tie", None, "one", "two"):
        for i, feature in ((1, "x"), (2, "y")):
            own = [r[i] for r in rows if r[0] == key and r[i] is not None]
            if not own:
                assert (key, feature) not in got
                continue
            r = got[key or "null", feature]
            assert r.n == len(own) and np.allclose([r.q1, r.median, r.q3, r.min, r.max, r.mean], [*np.quantile(own, [0.25, 0.5, 0.75]), min(own), max(own), np.mean(own)])


@pytest.mark.parametrize(("dims", "eps"), [(2, 0.2), (5, 0.9), (12, 2.5)])
def test_metric_noise_equals_brute_force(spark, monkeypatch, dims, eps):
    """Also with many small cells and chunks, and as the grid gives it in two dimensions."""
    import numpy as np

    from tidewatch.operators import models as M

    monkeypatch.setattr(M, "CHUNK", 40)
    rng = np.random.default_rng(dims)
    x = np.r_[rng.normal(size=(500, dims)) * 0.6, rng.normal(size=(150, dims)) * 3, np.repeat(rng.normal(size=(1, dims)), 60, axis=0)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    dense = d.sum(axis=1) >= 5
    expected = {i: int(not dense[i] and not (d[i] & dense).any()) for i in range(len(x))}
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"f{i} double" for i in range(dims)))
    vectors = df.select("row_id", F.array(*[f"f{i}" for i in range(dims)]).alias("v"))
    assert {r.key: r.noise for r in M.metric_noise(vectors, "row_id", "v", eps).collect()} == expected and 0 < sum(expected.values()) < len(x)
    if dims != 2:
        return
    assert {r.key: r.noise for r in M.density_noise(df, "row_id", ["f0", "f1"], eps).collect()} == expected
    odd = spark.createDataFrame([(1, None), (2, [0.0])], "row_id long, v array<double>")
    assert {r.key: r.noise for r in M.metric_noise(odd, "row_id", "v", 1.0, 1).collect()} == {1: 1, 2: 0}
    assert M.metric_noise(odd.limit(0), "row_id", "v").count() == 0


def test_scratch_is_cleared(spark):
    import os
    from urllib.parse import urlparse

    from tidewatch.sources import staging

    staging.clear(spark)
    own = staging.Workspace(spark)
    table = own.keep(spark.range(5), "x")
    folder = urlparse(own.path).path
    assert table.count() == 5 and os.path.isdir(folder)
    assert staging.clear(spark) == 1 and not os.path.exists(folder) and staging.clear(spark) == 0
