"""Operators on small made tables: rules, models, files and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import features as X
from tidewatch.functions import sqltext as S
from tidewatch.functions import sqltokens as K
from tidewatch.operators import detectors as D
from tidewatch.operators import ensemble as E
from tidewatch.operators import evaluate as V
from tidewatch.operators import models as M
from tidewatch.operators import profiles as P
from tidewatch.sources import files, views
from tidewatch.streaming import traffic


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_collective_spikes_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.exponential(1, 60)
    x[[20, 41]] *= 40
    out = P.collective_spikes(frame(spark, [(i, 0, float(v)) for i, v in enumerate(x)], "i int, g int, x double"), ["x"], ["g"], ["i"], 10)
    got = [r.collective_score for r in out.orderBy("i").collect()]
    expected = np.zeros(60)
    for lo in range(51):
        d = np.abs(np.diff(x[lo : lo + 10]))
        for j in np.flatnonzero(d > 3 * d.mean()):
            expected[[lo + j, lo + j + 1]] += d[j] / (d.mean() + 1e-10) - 3
    assert np.allclose(got, expected) and expected.max() > 0


def test_quintiles_share_edges(spark):
    out = X.quintile(frame(spark, [(float(v),) for v in [1, 1, 1, 1, 2, 3, 9]], "x double"), "x", "q")
    assert [r.q for r in out.orderBy("x").collect()] == [0, 0, 0, 0, 1, 2, 2]


def test_nan_and_infinity_become_null(spark):
    df = views.number_or_null(frame(spark, [(float("nan"),), (float("inf"),), (1.5,)], "x double"))
    assert sorted([r.x for r in df.collect()], key=str) == [1.5, None, None]


def test_constant_scores_flag_nobody(spark):
    df = frame(spark, [(i, 2.0) for i in range(5)], "row_id int, s double")
    assert P.above_percentile(df, "s", 0.95, "hit", cap=0.7, inclusive=True).agg(F.sum("hit")).first()[0] == 0
    assert P.min_max(df, ["s"]).agg(F.max("s")).first()[0] == 0


def test_zero_threshold_is_off(spark):
    rows = [(i, "2024-01-01 00:00:00", "a", 10.0, 5, 1.0, "tcp", "SF") for i in range(20)]
    df = frame(spark, rows, "row_id int, t string, src_ip string, bytes double, packets int, duration double, protocol string, flag string").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    out = D.dos_detect(df).agg(F.sum("predicted_anomaly"), F.max("anomaly_score")).first()
    assert tuple(out) == (0, 0.0)


@pytest.mark.parametrize(
    ("text", "decoded"),
    [
        ("SELECT%20a%zz+b", "SELECT a%zz+b"),
        ("x 0x4f52 1", "x OR 1"),
        ("\\u004fR 1=1", "OR 1=1"),
        ("a/* x */b -- c", "a b "),
        ("'O'+'R' CHAR(65)", "'OR' 'A'"),
        ("plain", "plain"),
    ],
)
def test_decoding(spark, text, decoded):
    assert frame(spark, [(text,)], "q string").select(S.decoded(F.col("q")).alias("d")).first().d == decoded


def test_text_rules(spark):
    texts = {"SELECT a FROM t": 0.0, "a OR 1=1": 1.0, "b = 'x": 0.6, "SELECT * FROM t WHERE a IS NULL": 0.3, None: 0.0}
    out = frame(spark, [(t,) for t in texts], "q string").select("q", F.round(S.pattern_score(F.col("q")), 6).alias("s"))
    assert {r.q: r.s for r in out.collect()} == texts


def test_text_detection_has_the_contract(spark, small):
    out = S.detect(views.sqltext(spark, small))
    assert {"predicted_anomaly", "anomaly_score", "threat_level", "attack_type", "obfuscation_details"} <= set(out.columns)
    worst = out.where(F.col("query").contains("UNION SELECT"))
    assert worst.where("predicted_anomaly = 0").count() == 0
    assert {r.attack_type for r in worst.collect()} == {"union_based"}


def test_strategies_can_be_registered(spark):
    E.register_strategy("loudest", lambda df, w: df.withColumn("fused_score", F.greatest(*[f"score_{d}" for d in w])).withColumn("fused_anomaly", F.lit(0)))
    df = frame(spark, [(1, 0.2, 0.7)], "row_id int, score_a double, score_b double")
    assert E.fuse(df, {"a": 1, "b": 1}, "loudest").first().fused_score == 0.7


def test_auc_of_ties_and_one_class(spark):
    df = frame(spark, [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert V.auc(df, "s", "y").first().auc == 0.875
    assert V.auc(df.where("y = 1"), "s", "y").first().auc is None


def test_forest_and_factor_find_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(300)] + [(1000 + i, 9.0 + i, -9.0) for i in range(4)]
    df = frame(spark, rows, "row_id int, a double, b double")
    best = M.isolation_forest(df, ["a", "b"], trees=40).orderBy(F.desc("anomaly_score")).limit(4).collect()
    assert {r.row_id for r in best} == {1000, 1001, 1002, 1003}
    vectors = df.select("row_id", F.array("a", "b").alias("v"))
    best = M.local_outlier_factor(vectors, vectors.where("row_id < 1000"), "v", "row_id").orderBy(F.desc("anomaly_score")).limit(4).collect()
    assert {r.row_id for r in best} == {1000, 1001, 1002, 1003}
    noise = M.density_noise(df, "row_id", ["a", "b"], 0.8, 5)
    assert {r.key for r in noise.where("noise = 1").collect()} >= {1000, 1001, 1002, 1003}


def test_files_round_trip(spark, tmp_path):
    line = "0,tcp,http,SF," + ",".join(["1"] * 37)
    (tmp_path / "kdd.csv").write_text(f"{line},normal.\n{line},smurf.\n")
    (tmp_path / "nsl.csv").write_text(f"{line},normal,20\n{line},neptune,3\n{line.replace('tcp', 'udp')},normal,9\n")
    kdd = files.read_kdd(spark, str(tmp_path / "kdd.csv"))
    assert len(kdd.columns) == 43 and [r.is_anomaly for r in kdd.orderBy("label").collect()] == [0, 1]
    nsl = files.read_nsl_kdd(spark, str(tmp_path / "nsl.csv"))
    assert "class" not in nsl.columns and files.read_nsl_kdd(spark, str(tmp_path / "nsl.csv"), 2).count() == 2
    train, test = files.category_codes(nsl, kdd)
    assert sorted(r.protocol_type for r in train.collect()) == [0, 0, 1] and {r.flag for r in test.collect()} == {0}
    profile = P.profile(kdd, "global", [], ["duration", "count"])
    files.save_profiles(profile, str(tmp_path / "p"))
    assert sorted(map(str, files.load_profiles(spark, str(tmp_path / "p"), P.PROFILE).select(profile.columns).collect())) == sorted(map(str, profile.collect()))
    files.write_csv(nsl, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_synthetic_traffic(spark):
    df = files.synthetic_traffic(spark, 2000, 0.1)
    n, hits = df.agg(F.count(F.lit(1)), F.sum("is_anomaly")).first()
    assert n == 2000 and 120 < hits < 280
    assert df.where("is_anomaly = 0 and dst_port = 31337").count() == 0 < df.where("dst_port = 31337").count()


def test_stream_counts_equal_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    source = str(tmp_path / "in")
    events.unionByName(events.limit(20)).write.parquet(source)
    stream = traffic.window_counts(traffic.events_stream(spark, source, events.schema.simpleString()[7:-1].replace(":", " ")), "event_type", "6 hours", "60 days")
    out = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").count()
    got = spark.table("counts")
    assert got.count() == batch.count() and got.agg(F.sum("n")).first()[0] == events.count()


def test_detectors_keep_their_contract(spark, small, tmp_path):
    from tidewatch.operators import contract as C

    net = views.net(spark, small)
    factor = {"features": ["bytes", "duration"], "neighbours": 5}
    members = {"floods": ("dos", {"key": "service", "seconds": 21600, "percentile": 99.0}), "steps": ("sequence", {}), "trees": ("forest", {"features": ["bytes"], "trees": 10, "scale": True})}
    options = {"ensemble": {"members": members, "learn_weights": True}, "adaptive": {"features": ["bytes", "packets", "duration"], "sensitivity": "low"}, "factor": factor, "dos": {"key": "service", "seconds": 21600, "percentile": 99.0}, "sequence": {}, "profile": {"features": ["bytes", "duration"], "sensitivity": "low"}, "forest": {"features": ["bytes", "packets"], "trees": 10, "best_f1": True}}
    for kind, own in options.items():
        fitted = C.DETECTORS[kind](**own).fit(net)
        scored = fitted.predict(net)
        assert {"predicted_anomaly", "anomaly_score"} <= set(scored.columns) and scored.count() == net.count()
        fitted.save(str(tmp_path / kind))
        again = C.Detector.load(spark, str(tmp_path / kind))
        assert json.dumps(again.options) == json.dumps(fitted.options)
        pick = lambda d: sorted((r.row_id, round(r.anomaly_score, 9)) for r in d.predict(net).select("row_id", "anomaly_score").collect())
        assert pick(again) == pick(fitted)
        m = fitted.evaluate(net).first()
        assert m.tp + m.fp + m.tn + m.fn == net.count()


def test_reduced_features(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    rows = [(i, float(x), float(2 * x), float(y)) for i, (x, y) in enumerate(zip(a, rng.normal(size=200), strict=True))]
    from tidewatch.operators import contract as C

    out, names = C.reduced(frame(spark, rows, "row_id int, a double, b double, c double"), ["a", "b", "c"])
    assert names == ["pc_0", "pc_1"] and out.count() == 200


def test_samples_and_splits(spark):
    from tidewatch.operators import sampling as Z

    df = frame(spark, [(i, int(i % 10 == 0)) for i in range(2000)], "row_id int, y int")
    parts = [p.count() for p in Z.split(df, "row_id", [0.7, 0.3])]
    assert sum(parts) == 2000 and abs(parts[0] - 1400) < 80
    assert Z.sample(df, "row_id", 33).count() == 33
    counts = {r.y: r["count"] for r in Z.per_stratum(df, "y", "row_id", {0: 70, 1: 30}).groupBy("y").count().collect()}
    assert counts == {0: 70, 1: 30}


def test_tokens_and_findings(spark):
    texts = {"SELECT a FROM t WHERE b = 1 OR 1=1": ["boolean"], "x UNION ALL SELECT y": ["union"], "SELECT SLEEP(5)": ["time"], "a; DROP TABLE t": ["destructive"], "SELECT 'or true' FROM t": [], "": []}
    out = frame(spark, [(t,) for t in texts], "q string").withColumn("tokens", K.tokens(F.col("q"))).select("q", K.findings(F.col("tokens")).alias("f"))
    assert {r.q: r.f for r in out.collect()} == texts


def test_explanations(spark, small):
    out = S.detect_and_explain(views.sqltext(spark, small)).where(F.col("query").contains("DROP TABLE")).first()
    assert out.attack_type == "destructive" and out.recommendation == S.ADVICE["destructive"] and "DROP" in out.explanation.upper()


def test_base64_and_own_patterns(spark):
    import base64

    packed = base64.b64encode(b"1 UNION SELECT a").decode()
    out = frame(spark, [(f"x = {packed}", "elevator operation")], "q string, w string").select(S.decoded(F.col("q")).alias("q"), S.decoded(F.col("w")).alias("w"), S.pattern_score(F.col("w"), [r"operat\w+"]).alias("s")).first()
    assert tuple(out) == ("x = 1 UNION SELECT a", "elevator operation", 1.0)


def test_feature_expressions(spark):
    df = frame(spark, [(10, 4, 0.5, None, 0.2, 1.0), (0, -1, None, None, None, None)], "src_bytes int, dst_bytes int, serror_rate double, rerror_rate double, same_srv_rate double, diff_srv_rate double")
    out = df.withColumns(X.byte_ratios() | X.error_rates(df.columns)).orderBy(F.desc("src_bytes")).collect()
    assert [(r.bytes_ratio, r.total_bytes, r.total_error_rate, r.service_diversity) for r in out] == [(2.0, 14, 0.5, 0.6), (None, -1, 0.0, None)]
    assert X.categorise(df)[0] == df.columns
    assert X.aligned(df, ["dst_bytes", "absent"]).first().asDict() == {"dst_bytes": 4, "absent": 0.0}


def test_stream_pace_of_addresses(spark, tmp_path):
    rows = [("a", 1.0), ("a", 1.2), ("a", 1.9), ("b", 1.0), ("a", 9.0), ("b", 9.0)]
    df = frame(spark, rows, "ip string, t double").select("ip", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ip string, ts timestamp").parquet(str(tmp_path / "in"))
    run = traffic.address_pace(stream).writeStream.format("memory").queryName("pace").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r.ip, r.events, r.counter) for r in spark.table("pace").collect()} == {("a", 4, 1.5), ("b", 2, 0.0)}


def test_quantiles_by_selection(spark):
    """Narrowed brackets give what sorting gives: ties, few values, nulls, ends."""
    from tidewatch.operators import order

    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=3000), np.zeros(1500), rng.integers(0, 4, 500)]
    df = frame(spark, [(float(v),) for v in rng.permutation(x)] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.1, 0.333, 0.5, 0.95, 1.0]
    for most in (100_000, 60, 1):
        assert np.allclose(order.quantiles(df, {"x": F.col("x")}, shares, most)["x"], np.quantile(x, shares))
    assert order.quantile(df.where("x > 100"), "x", 0.5) is None
    grouped = df.where("x is not null").select(F.when(F.col("x") > 0, "a").otherwise("b").alias("g"), "x")
    brackets = grouped.groupBy("g").agg(F.count("x").alias("n"), F.array(F.min("x"), F.max("x"), F.min("x"), F.max("x")).alias("edges"))
    got = {r.g: r.q for r in order.grouped_quantiles(grouped, ["g"], "x", [0.25, 0.5], brackets).collect()}
    assert np.allclose(got["a"], np.quantile(x[x > 0], [0.25, 0.5])) and np.allclose(got["b"], np.quantile(x[x <= 0], [0.25, 0.5]))


def test_large_groups_have_the_same_profile(spark, small, monkeypatch):
    from tidewatch.operators import order

    net = views.net(spark, small)
    rows = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in P.profile(net, "x", ["protocol"], ["bytes", "packets"]).collect())
    plain = rows()
    monkeypatch.setattr(order, "MOST", 100)
    monkeypatch.setattr(order, "ACCURACY", 10)
    assert rows() == plain


def test_running_sums_over_ranges(spark):
    from tidewatch.operators import order

    df = frame(spark, [(g, i, 1 + i % 3) for g in "ab" for i in range(200)], "g string, s int, n int").repartition(7)
    for down in (False, True):
        got = {(r.g, r.s): r.before_n for r in order.running(df, ["g"], "s", ["n"], descending=down).collect()}
        assert got == {(g, i): sum(1 + j % 3 for j in (range(i + 1, 200) if down else range(i))) for g in "ab" for i in range(200)}


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 3)), 1)
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "key long, v array<double>").repartition(4)
    monkeypatch.setattr(M, "CHUNK", 90)
    monkeypatch.setattr(M, "PIVOTS", 9)
    got = {r.key: [(n.d, n.key) for n in r.near] for r in M.nearest(df, df, 4).collect()}
    for i in range(700):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        expected = sorted((d[j], j) for j in range(700) if j != i)[:4]
        assert [k for _, k in got[i]] == [k for _, k in expected] and np.allclose([v for v, _ in got[i]], [v for v, _ in expected])


def test_text_models_and_their_store(spark, small, tmp_path):
    from tidewatch.operators import contract as C

    text = views.sqltext(spark, small)
    assert M.TextModels.fit(text.limit(5)) is None
    own = C.TextDetector(trees=5, tokens=True).fit(text)
    scored = own.predict(text)
    assert scored.where("ml_score not between 0 and 1 or advanced_score not between 0 and 1").count() == 0
    assert scored.where(F.col("query").contains("UNION SELECT") & (F.col("predicted_anomaly") == 0)).count() == 0
    own.save(str(tmp_path / "text"))
    again = C.Detector.load(spark, str(tmp_path / "text"))
    pick = lambda d: sorted((r.row_id, round(r.anomaly_score, 9)) for r in d.predict(text).select("row_id", "anomaly_score").collect())
    assert pick(again) == pick(own)
    assert S.attack_texts(text.limit(0)).count() == len(S.ATTACK_TEXTS)


def test_rules_test_plain_parts_first(spark):
    assert S.needle(r"'\s*or\s*0=0\s*#") == "0=0" and S.needle(r"\|\|") == "||" and S.needle("a(b|c)d") == "" and S.needle(r"colou?r") == "colo"
    texts = ["GROUP BY a HAVING 1=1", "x || y", "IS  NOT  NULL", "nothing", "when", ") when 3 then"]
    rows = frame(spark, [(t,) for t in texts], "q string")
    for p in S.CRITICAL + S.SECONDARY + S.RECON:
        low = F.lower("q")
        assert rows.where(S.matches(low, p) != low.rlike(p.lower())).count() == 0


@pytest.mark.parametrize(("text", "decoded"), [('"O" + "R"', '"OR"'), ("CONCAT('a', 'b')", "'ab'"), ("'a'.concat('b')", "'ab'"), ("select 1", "SELECT 1"), ("sElEcT 'x'||'y'", "SELECT 'xy'"), ("%30x4f52", "OR")])
def test_joined_and_mixed_case_texts(spark, text, decoded):
    assert frame(spark, [(text,)], "q string").select(S.decoded(F.col("q")).alias("d")).first().d == decoded


def test_synthetic_points(spark):
    train, test = files.load_synthetic(spark, 2000, 0.2, 4)
    n, m = train.count(), test.count()
    assert n + m == 2000 and abs(n - 1400) <= 1
    share = lambda df: df.agg(F.avg("is_anomaly")).first()[0]
    assert abs(share(train) - share(test)) < 0.01 and 0.15 < share(train) < 0.25
    every = train.unionByName(test)
    stats = every.agg(F.avg("bytes"), F.stddev_pop("bytes"), F.avg("feature_0")).first()
    assert abs(stats[0]) < 1e-9 and abs(stats[1] - 1) < 1e-9 and {"service_http", "flag_SF", "serror_rate", "timestamp"} <= set(every.columns)
    raw = files.synthetic_points(spark, 4000, 0.2, 4)
    assert abs(raw.agg(F.avg("count")).first()[0] - 3 * (1 + 0.2 * 0.3 * 4)) < 0.3 and raw.where("is_anomaly = 1 and flag_SF = 1").count() == 0


def test_prepared_files(spark, tmp_path):
    line = "0,tcp,http,SF," + ",".join(["1"] * 37)
    (tmp_path / "nsl.csv").write_text("".join(f"{line.replace('tcp', p)},{c},20\n" for p, c in (("tcp", "normal"), ("udp", "neptune"), ("icmp", "smurf"))))
    files.prepare_nsl_kdd(spark, str(tmp_path / "nsl.csv"), str(tmp_path / "out"))
    back = files.read_nsl_kdd(spark, str(tmp_path / "out"), header=True, codes=True)
    assert sorted((r.protocol_type, r.is_anomaly) for r in back.collect()) == [(0, 1), (1, 0), (2, 1)]
    (tmp_path / "kdd.csv").write_text("".join(f"{line},{c}.\n" for c in ["normal"] * 20 + ["smurf"] * 10))
    train, test = files.load_kdd(spark, str(tmp_path / "kdd.csv"))
    assert (train.count(), test.count(), test.agg(F.sum("is_anomaly")).first()[0]) == (21, 9, 3)
    assert {"protocol_type_tcp", "connection_rate", "bytes_ratio", "src_bytes_log"} <= set(train.columns)


def test_streamed_thresholds_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "a" if i % 3 else "b", float(np.round(rng.choice([0.1, 0.15, 0.7]), 2))) for i in range(90)]
    df = frame(spark, rows, "row_id long, ip string, score double").withColumn("ts", F.timestamp_seconds("row_id"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = traffic.adaptive_labels(stream, history=100).writeStream.format("memory").queryName("labels").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    batch = S.adaptive_threshold(df, "score", ["ip"], ["ts", "row_id"])
    assert {(r.row_id, round(r.threshold, 9)) for r in spark.table("labels").collect()} == {(r.row_id, round(r.threshold, 9)) for r in batch.collect()}
    assert traffic.late_rows(run) == 0


def test_profiles_grow_with_the_stream(spark, tmp_path):
    df = frame(spark, [("a", float(i), i) for i in range(50)] + [("b", 2.0, 3)], "k string, x double, t long").withColumn("ts", F.timestamp_seconds(F.col("t") * 600))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = traffic.profile_updates(stream, "k", "x").writeStream.format("memory").queryName("updates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {r.key: (r.n, r.mean, r.std) for r in traffic.merged_profile(spark.table("updates")).collect()}
    assert got["a"][:2] == (50, 24.5) and abs(got["a"][2] - np.arange(50).std(ddof=1)) < 1e-9 and got["b"] == (1, 2.0, None)


def test_benchmark_of_presets(spark):
    from tidewatch.operators import contract as C

    train, test = files.load_synthetic(spark, 900, 0.2, 3)
    features = ["feature_0", "feature_1", "feature_2"]
    out = V.benchmark(train, test, {n: C.preset(n, features, **({"trees": 10} if "forest" in n else {"neighbours": 5})) for n in C.PRESETS})
    assert {r.detector for r in out.where("tp + fp + tn + fn > 200").collect()} == set(C.PRESETS)
