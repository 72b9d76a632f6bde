"""The registered queries over the given tables; ``oracle`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import sqltext as S
from ..functions import sqltokens as K
from ..operators import detectors as D
from ..operators import ensemble as E
from ..operators import evaluate as V
from ..operators import models as M
from ..operators import profiles as P
from ..operators import sampling as Z
from ..operators import tuning as U
from ..sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BASE = ["bytes", "packets", "duration"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def profile_columns() -> list[Column]:
    return [F.col("key"), F.col("feature"), F.col("n"), *r6("mean", "std", "median", "q1", "q3", "iqr", "min", "max")]


@query
def q_temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    net, t = views.net(spark, sf), X.temporal(F.col("timestamp"))
    return net.select("row_id", *[c.cast("long").alias(n) for n, c in t.items()], X.out_of_hours(F.col("timestamp")).alias("out_of_hours"))


@query
def q_port_features(spark: SparkSession, sf: str) -> DataFrame:
    port = F.col("dst_port")
    return views.net(spark, sf).select("row_id", port.cast("long").alias("dst_port"), X.port_class(port).cast("long").alias("port_class"), X.suspicious(port).cast("long").alias("suspicious"), F.when(port.isin(X.COMMON_PORTS), port).otherwise(0).cast("long").alias("common_port"), X.port_scan_like().cast("long").alias("port_scan_like"))


@query
def q_protocol_onehot(spark: SparkSession, sf: str) -> DataFrame:
    hot = X.one_hot("protocol", ["tcp", "udp", "icmp"]) | X.one_hot("flag", ["SF", "S0"])
    return views.net(spark, sf).select("row_id", X.protocol_number(F.col("protocol")).cast("long").alias("protocol_num"), *[c.cast("long").alias(n) for n, c in hot.items()])


@query
def q_ip_hash(spark: SparkSession, sf: str) -> DataFrame:
    return views.net(spark, sf).groupBy("src_ip", X.ip_bucket(F.col("src_ip")).cast("long").alias("src_ip_hash")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_rates(spark: SparkSession, sf: str) -> DataFrame:
    return views.net(spark, sf).withColumns(X.rates()).withColumn("bytes_log", F.log1p("bytes")).select("row_id", *r6("bytes_per_second", "packets_per_second", "bytes_log"))


@query
def q_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = X.window_counts(views.net(spark, sf), "service", 6 * 3600, "service_6h")
    return X.window_counts(out, "src_ip", 86400, "user_day").select("row_id", "service_6h", "user_day")


@query
def q_dos_like(spark: SparkSession, sf: str) -> DataFrame:
    counts = X.window_counts(views.net(spark, sf), "service", 6 * 3600)
    return P.above_percentile(counts, "connection_count", 0.95, "is_dos_like").select("row_id", "connection_count", F.col("is_dos_like").cast("long").alias("is_dos_like"))


@query
def q_global_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(views.net(spark, sf), "global", [], BASE).select(*profile_columns())


@query
def q_lineitem_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(views.table(spark, sf, "lineitem"), "contextual", ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"], 10).select(*profile_columns())


@query
def q_category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    net = views.net(spark, sf)
    parts = [P.distribution(net, c).select(F.lit(c).alias("feature"), "value", "n", *r6("share")) for c in ("service", "protocol", "flag")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def q_hour_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(views.net(spark, sf).withColumn("hour", F.hour("timestamp")), "hour", ["hour"], BASE).select(*profile_columns())


@query
def q_day_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(views.net(spark, sf).withColumn("day", F.weekday("timestamp")), "day", ["day"], BASE).select(*profile_columns())


@query
def q_protocol_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(views.net(spark, sf), "protocol", ["protocol"], BASE).select(*profile_columns())


@query
def q_service_profile_min_support(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(views.net(spark, sf), "service", ["service"], BASE, 1000).select(*profile_columns())


@query
def q_protocol_port_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(views.net(spark, sf), "contextual", ["protocol", "dst_port"], BASE, 10).select(*profile_columns())


@query
def q_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    net = views.net(spark, sf)
    fixed = P.quantile_thresholds(net, BASE, 99.9).select(*[F.col(f).cast("double").alias(f) for f in BASE]).unpivot([], BASE, "feature", "p999")
    return P.thresholds(P.profile(net, "global", [], BASE)).join(fixed, "feature").select("feature", *r6("threshold", "p999"))


@query
def q_standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    return X.standardised(views.net(spark, sf), BASE).select("row_id", *r6(*BASE))


@query
def q_qcut_state(spark: SparkSession, sf: str) -> DataFrame:
    out = X.quintile(views.net(spark, sf), "bytes", "bytes_code")
    return out.select("row_id", F.concat_ws("_", F.coalesce("service", F.lit("null")), F.coalesce("protocol", F.lit("null")), F.col("bytes_code").cast("string")).alias("state"))


@query
def q_statistical_score(spark: SparkSession, sf: str) -> DataFrame:
    net = views.net(spark, sf)
    table = P.moments(net.where("is_anomaly = 0"), {"global": ([], 1)}, BASE)
    return P.score_by(net, table, "global", [], BASE, "statistical_score", 2.0).select("row_id", *r6("statistical_score"))


@query
def q_contextual_score(spark: SparkSession, sf: str) -> DataFrame:
    net = views.net(spark, sf)
    keys = ["protocol", "dst_port"]
    table = P.moments(net.where("is_anomaly = 0"), {"contextual": (keys, 10)}, BASE)
    return P.score_by(net, table, "contextual", keys, BASE, "contextual_score", 1.5).select("row_id", *r6("contextual_score"))


@query
def q_collective_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return P.collective_spikes(views.net(spark, sf), ["bytes"], ["src_ip"], ["timestamp", "row_id"]).select("row_id", *r6("collective_score"))


@query
def q_adaptive_detect(spark: SparkSession, sf: str) -> DataFrame:
    return D.adaptive_detect(views.net(spark, sf), BASE, 2.0).select("row_id", F.round("anomaly_score", 5).alias("anomaly_score"), F.col("predicted_anomaly").cast("long").alias("predicted_anomaly"), "anomaly_type")


@query
def q_transition_probs(spark: SparkSession, sf: str) -> DataFrame:
    return D.transitions(views.net(spark, sf), F.col("service"), ["src_ip"], ["timestamp", "row_id"]).select("state", "next_state", "n", *r6("p"))


@query
def q_order_transitions(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders")
    return D.transitions(orders, F.concat_ws("_", "o_orderstatus", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("state", "next_state", "n", *r6("p"))


@query
def q_sequence_score(spark: SparkSession, sf: str) -> DataFrame:
    net, state, by, order = views.net(spark, sf), F.concat_ws("_", "service", "protocol"), ["src_ip"], ["timestamp", "row_id"]
    return D.sequence_scores(net, D.transitions(net, state, by, order), state, by, order).select("row_id", *r6("raw_score"))


@query
def q_dos_detect(spark: SparkSession, sf: str) -> DataFrame:
    out = D.dos_detect(views.net(spark, sf), "service", 6 * 3600, 99.0)
    return out.select("row_id", *r6("anomaly_score"), F.col("predicted_anomaly").cast("long").alias("predicted_anomaly"), "dos_attack_type")


@query
def q_sqli_patterns(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return views.sqltext(spark, sf).select("row_id", S.any_hit(q, S.CRITICAL).alias("critical"), S.hits(q, S.SECONDARY).cast("long").alias("n_secondary"), F.round(S.pattern_score(q), 6).alias("pattern_score"))


@query
def q_sqli_pages(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts of each kind the critical rules flag over whole texts; pages nearly always hold comment signs."""
    pages = views.table(spark, sf, "pages").select(F.lit("pages").alias("kind"), F.col("html").alias("t"))
    docs = views.table(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("text").alias("t"))
    every = pages.unionByName(docs).unionByName(views.table(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("text").alias("t")))
    flagged = F.count(F.when(S.any_hit(F.col("t"), S.CRITICAL), 1)).alias("flagged")
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.contains("t", F.lit("--")) | F.contains("t", F.lit("#")), 1)).alias("comment_signs"), flagged)


@query
def q_sqli_attack_type(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return views.sqltext(spark, sf).select("row_id", S.attack_type(q).alias("attack_type"), S.threat_level(S.pattern_score(q)).alias("threat_level"), S.odd_quotes(q).alias("odd_quotes"))


@query
def q_sqli_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return views.sqltext(spark, sf).select("row_id", F.round(S.complexity(F.col("query")), 6).alias("complexity"))


@query
def q_sqli_adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.sqltext(spark, sf).withColumn("score", S.pattern_score(F.col("query")))
    return S.adaptive_threshold(scored, "score", ["ip"], ["ts", "row_id"]).select("row_id", *r6("threshold"))


@query
def q_sqli_context(spark: SparkSession, sf: str) -> DataFrame:
    return S.context_score(views.sqltext(spark, sf)).select("row_id", *r6("context_score"))


@query
def q_sqli_detect(spark: SparkSession, sf: str) -> DataFrame:
    return S.detect(views.sqltext(spark, sf)).select("row_id", "decoded", *r6("anomaly_score", "threshold"), "predicted_anomaly", "attack_type", "threat_level")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Three detectors' scores and labels on one row: volume, duration and port."""
    net = views.net(spark, sf)
    port = 0.5 * F.coalesce(F.col("dst_port").isin(X.SUSPICIOUS_PORTS).cast("int"), F.lit(0)) + 0.25 * (F.col("packets") <= 3).cast("int")
    return net.withColumns({"score_volume": F.col("bytes"), "score_duration": F.col("duration"), "score_port": port}).withColumns(
        {"anomaly_volume": (F.col("bytes") > 2000).cast("int"), "anomaly_duration": (F.col("duration") < 1).cast("int"), "anomaly_port": (port >= 0.5).cast("int")}
    )


WEIGHTS = {"volume": 1.5, "duration": 1.0, "port": 1.0}


def fused(df: DataFrame) -> DataFrame:
    return df.select("row_id", *r6("fused_score"), F.col("fused_anomaly").cast("long").alias("fused_anomaly"))


@query
def q_majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.majority_vote(scored(spark, sf), WEIGHTS))


@query
def q_weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.weighted_average(scored(spark, sf), WEIGHTS))


@query
def q_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.rank_fusion(scored(spark, sf), WEIGHTS))


@query
def q_adaptive_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.adaptive(scored(spark, sf), WEIGHTS))


@query
def q_stacking(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of rows that the model hasn't learned from."""
    return fused(E.stacking(scored(spark, sf), WEIGHTS, key="row_id").where("not in_training"))


@query
def q_anomaly_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.majority_vote(scored(spark, sf), WEIGHTS).withColumn("fused_anomaly", (F.col("fused_score") >= 0).cast("int"))
    return E.anomaly_types(rows).select("row_id", "anomaly_type")


@query
def q_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = V.metrics_of_many(scored(spark, sf), [f"anomaly_{d}" for d in WEIGHTS])
    return out.select("detector", "tp", "fp", "tn", "fn", *r6("accuracy", "precision", "recall", "f1", "fpr", "fnr"))


@query
def q_metrics_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = V.sweep(scored(spark, sf), "score_volume", [50, 75, 90, 95, 99])
    return out.select(*r6("percentile", "threshold"), "tp", "fp", "tn", "fn", *r6("precision", "recall", "f1"))


@query
def q_auc(spark: SparkSession, sf: str) -> DataFrame:
    joined = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return V.auc(joined.where("quality is not null"), "n_chars", "quality").select(*r6("auc"))


@query
def q_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return V.roc_curve(scored(spark, sf), "score_duration").select(*r6("threshold", "fpr", "tpr", "precision"))


@query
def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return V.histogram(scored(spark, sf), "score_volume", 30).select(F.col("bin").cast("long").alias("bin"), F.col("label").cast("long").alias("label"), "n")


@query
def q_top_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return V.top_k(views.net(spark, sf), "bytes", 10).select("row_id", "service", *r6("bytes"))


@query
def q_density_noise(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.standardised(views.net(spark, sf), ["bytes", "duration"])
    return M.density_noise(rows, "row_id", ["bytes", "duration"], 0.1, 5).select(F.col("key").alias("row_id"), F.col("noise").cast("long").alias("noise"))


@query
def q_isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    return M.isolation_forest(views.net(spark, sf).select("row_id", *BASE), BASE, trees=50).select("row_id", "anomaly_score", "predicted_anomaly")


@query
def q_local_outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    vectors = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return M.local_outlier_factor(vectors, vectors, "embedding", "vec_id").select("vec_id", *r6("anomaly_score"))


@query
def q_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each vector."""
    rows = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    near = M.nearest(rows, rows, 5).select("key", F.posexplode("near").alias("rank", "x"))
    return near.select(F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.col("x.key").alias("other"), F.round("x.d", 6).alias("d"))


@query
def q_principal_components(spark: SparkSession, sf: str) -> DataFrame:
    out, share = M.principal_components(views.table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", "components", F.lit(share).alias("explained"))


@query
def q_text_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents from character n-grams: learnt from seven in ten labelled documents, scores for all others, labelled or not."""
    docs = views.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn = views.table(spark, sf, "labels").where(Z.bucket("doc_id") < 700).select("doc_id", "toxic")
    train = docs.join(drawn, "doc_id")
    model = M.text_forest(train.where("toxic = 0"), train.where("toxic = 1"), "text", 3)
    rest = docs.join(drawn, "doc_id", "left_anti")
    return M.score_text(model, rest, "text", 3, "doc_id")


@query
def q_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return Z.per_stratum(views.net(spark, sf), "is_anomaly", "row_id", {0: 700, 1: 300}).select("row_id", F.col("is_anomaly").cast("long").alias("is_anomaly"))


@query
def q_train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    """Which part each row is in: 60, 20 and 20 per cent by hash."""
    parts = Z.split(views.net(spark, sf), "row_id", [0.6, 0.2, 0.2])
    rows = [p.select("row_id", F.lit(i).cast("long").alias("part")) for i, p in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly 70 and 30 per cent of each class."""
    return Z.stratified_split(views.net(spark, sf), "row_id", "is_anomaly", [0.7, 0.3]).select("row_id", F.col("part").cast("long").alias("part"))


@query
def q_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Traffic rows that a sample of 70 % left out."""
    net = views.net(spark, sf)
    return Z.without(net, Z.split(net, "row_id", [0.7, 0.3])[0], "row_id").select("row_id")


@query
def q_informative_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = scored(spark, sf), [f"score_{d}" for d in WEIGHTS]
    a = U.informative_weights(rows, names, "is_anomaly").withColumnRenamed("weight", "by_label")
    b = U.informative_weights(rows, names).withColumnRenamed("weight", "by_dispersion")
    return a.join(b, "detector").select("detector", *r6("by_label", "by_dispersion"))


@query
def q_f1_weights(spark: SparkSession, sf: str) -> DataFrame:
    return U.f1_weights(scored(spark, sf), [f"anomaly_{d}" for d in WEIGHTS]).select("detector", *r6("f1", "weight"))


@query
def q_gap_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return U.gap_threshold(scored(spark, sf), "score_volume", 2500.0).select(*r6("threshold"))


@query
def q_weight_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = U.weight_grid(scored(spark, sf), ["score_volume", "score_duration"], [(1.0, 0.0), (0.5, 0.5), (0.2, 10.0)], [50, 500, 1000])
    return grid.select(F.col("weights").cast("long").alias("weights"), "threshold", "tp", "fp", "tn", "fn", *r6("f1"))


@query
def q_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.cascade(scored(spark, sf), WEIGHTS))


@query
def q_top_states(spark: SparkSession, sf: str) -> DataFrame:
    """The states of most edges in the transition graph of orders, edges of a hundredth and more."""
    edges = D.transitions(views.table(spark, sf, "orders"), F.concat_ws("_", "o_orderstatus", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).where("p > 0.01")
    ends = edges.select(F.explode(F.array("state", "next_state")).alias("state"))
    return ends.groupBy("state").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "state").limit(15)


@query
def q_sqli_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    return S.synthetic_injections(views.sqltext(spark, sf)).select("row_id", "made.kind", "made.attack")


@query
def q_sqli_advice(spark: SparkSession, sf: str) -> DataFrame:
    kind = S.attack_type(F.col("query"))
    return views.sqltext(spark, sf).groupBy(kind.alias("attack_type"), S.recommendation(kind).alias("recommendation")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_sqli_explain(spark: SparkSession, sf: str) -> DataFrame:
    return S.detect_and_explain(views.sqltext(spark, sf)).select("row_id", "predicted_anomaly", "detected_by", "explanation", "recommendation", "obfuscation_details")


@query
def q_sqli_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.sqltext(spark, sf).select("row_id", K.tokens(F.col("query")).alias("own"))
    return rows.select("row_id", F.size("own").cast("long").alias("n_tokens"), token_text(F.col("own")).alias("tokens"), F.array_join(K.findings(F.col("own")), ",").alias("findings"))


def token_text(tokens: Column) -> Column:
    return F.sha2(F.array_join(F.transform(tokens, lambda t: F.concat(t["type"], F.lit(" "), t["value"])), "\n"), 256)


@query
def q_sqli_text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, findings and rule scores of whole documents and pages."""
    docs = views.table(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = views.table(spark, sf, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    rows = docs.unionByName(pages).withColumn("own", K.tokens(F.coalesce("t", F.lit(""))))
    return rows.select("kind", "id", F.size("own").cast("long").alias("n_tokens"), token_text(F.col("own")).alias("tokens"), F.array_join(K.findings(F.col("own")), ",").alias("findings"), S.pattern_score(F.col("t")).alias("pattern_score"))


@query
def q_customer_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Balance profile of customers by region and nation: dimension tables are broadcast while they are small."""
    nation = views.table(spark, sf, "nation").join(views.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = views.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return P.profile(rows, "contextual", ["r_name", "n_name"], ["c_acctbal"]).select(*profile_columns())


@query
def q_anomaly_subtypes(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.window_counts(views.net(spark, sf), "service", 6 * 3600)
    return D.statistical_subtype(rows).select("row_id", "anomaly_subtype")


@query
def q_dominant_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("volume", F.col("bytes") / 1000).withColumn("time", F.col("duration"))
    return D.dominant_type(rows, {"volume": 0.4, "time": 0.1, "score_port": 1.0}, 0.5).select("row_id", "dominant")


@query
def q_sequence_statistics(spark: SparkSession, sf: str) -> DataFrame:
    model = D.transitions(views.net(spark, sf), F.concat_ws("_", "service", "protocol"), ["src_ip"], ["timestamp", "row_id"])
    return D.sequence_statistics(model).select("states", "edges", "likely", *r6("least_p", "mean_p"))


@query
def q_transition_heat_map(spark: SparkSession, sf: str) -> DataFrame:
    states = ["click", "error", "purchase", "signup", "view"]
    model = D.transitions(views.net(spark, sf), F.col("service"), ["src_ip"], ["timestamp", "row_id"])
    return D.heat_map(model, states).select("state", *r6(*states))


@query
def q_profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    net = views.net(spark, sf)
    return P.profile_counts(P.profile(net, "global", [], BASE).unionByName(P.profile(net, "protocol", ["protocol"], BASE))).select("context", "profiles")


@query
def q_port_profile_support(spark: SparkSession, sf: str) -> DataFrame:
    """Ports with a hundredth of all rows at least, and 10."""
    net = views.net(spark, sf)
    return P.profile(net, "port", ["dst_port"], BASE, P.support(net)).select(*profile_columns())


@query
def q_profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return P.lookup(P.profile(views.net(spark, sf), "protocol", ["protocol"], BASE), "protocol", "udp", "bytes").select(*profile_columns())


@query
def q_threshold_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of wanted features, one and a half times; infinite for one without."""
    limits = P.thresholds(P.profile(views.net(spark, sf), "global", [], BASE))
    wanted = spark.createDataFrame([("bytes",), ("duration",), ("unknown",)], "feature string")
    return P.threshold_of(limits, wanted, 1.5).select("feature", F.when(F.col("threshold") < 1e300, F.round("threshold", 6)).alias("threshold"), F.isnull(F.when(F.col("threshold") < 1e300, 1)).alias("unbounded"))


@query
def q_mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    return V.mean_scores(scored(spark, sf), [f"score_{d}" for d in WEIGHTS]).select("detector", *r6("mean"))


@query
def q_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Position in time, by ranges, and a surrogate clock."""
    return X.positions(views.net(spark, sf).select("row_id", "timestamp"), ["timestamp", "row_id"]).select("row_id", "order", *r6("order_normalized"), F.date_format("clock", "yyyy-MM-dd HH:mm:ss").alias("clock"))


@query
def q_inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    return V.inferred_types(scored(spark, sf).withColumn("predicted_anomaly", F.col("anomaly_volume"))).select("type", "n")


@query
def q_best_f1(spark: SparkSession, sf: str) -> DataFrame:
    swept = V.sweep(scored(spark, sf), "score_duration", [70, 75, 80, 85, 90, 95], inclusive=True)
    return V.best_f1(swept).select(*r6("percentile", "threshold"), *r6("f1"))


@query
def q_metrics_and_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and AUC of the text rules against the critical texts that a plain search for signs finds."""
    rows = views.sqltext(spark, sf).select(S.pattern_score(F.col("query")).alias("anomaly_score"), F.col("query").rlike("--|#|;").cast("int").alias("is_anomaly"))
    return V.metrics_and_auc(rows.withColumn("predicted_anomaly", (F.col("anomaly_score") >= 0.6).cast("int"))).select("tp", "fp", "tn", "fn", *r6("precision", "recall", "f1", "auc"))


@query
def q_improvement(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    return V.improvement(V.metrics(rows, predicted="anomaly_port"), V.metrics(rows, predicted="anomaly_duration")).select(*r6("precision", "recall", "f1"))


@query
def q_rounded_vote(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.rounded_vote(scored(spark, sf), WEIGHTS))


@query
def q_f1_vote(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.f1_vote(scored(spark, sf), WEIGHTS))


@query
def q_forest_stacking(spark: SparkSession, sf: str) -> DataFrame:
    return fused(E.stacking(scored(spark, sf), WEIGHTS, key="row_id", model="forest").where("not in_training"))


@query
def q_ensemble_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types with the DoS, sequence and isolation rules; stand-ins for those detectors' columns come from the three scores."""
    rows = scored(spark, sf).withColumns({"dos": F.when(F.col("bytes") > 1800, "SYN Flood").otherwise("Normal"), "fused_anomaly": F.lit(1)})
    return E.anomaly_types(rows, dos="dos", sequence="duration", forest="volume").select("row_id", "anomaly_type")


@query
def q_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """A DoS and a sequence detector, fitted, fused by the mean of their scaled scores, and typed."""
    from ..operators.contract import EnsembleDetector

    net = views.net(spark, sf)
    members = {"dos": ("dos", {"key": "service", "seconds": 21600, "percentile": 99.0}), "steps": ("sequence", {})}
    return EnsembleDetector(members=members).fit(net).predict(net).select("row_id", *r6("anomaly_score"), F.col("predicted_anomaly").cast("long").alias("predicted_anomaly"), "anomaly_type")


@query
def q_adaptive_models(spark: SparkSession, sf: str) -> DataFrame:
    """The adaptive detector with forest, factor and noise as well."""
    return D.adaptive_detect(views.net(spark, sf), BASE, 2.0, models=True).select("row_id", "ml_score", "anomaly_score", "predicted_anomaly", "anomaly_type")


@query
def q_improved_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types by the share of four scores; the scores are plain expressions here."""
    net = X.window_counts(views.net(spark, sf), "service", 6 * 3600).withColumns(X.rates())
    rows = net.withColumns({"is_dos_like": (F.col("connection_count") > 20).cast("int"), "is_port_scan_like": X.port_scan_like(), "hour_of_day": F.hour("timestamp"), "predicted_anomaly": F.lit(1)})
    rows = rows.withColumns({"statistical_score": F.coalesce(F.col("bytes") / 4000, F.lit(0.0)), "contextual_score": F.col("duration") / 10, "ml_score": F.col("packets") / 20, "collective_score": F.when(F.col("protocol") == "icmp", 0.9).otherwise(0.1)})
    return D.improved_types(rows).select("row_id", "anomaly_type")


@query
def q_forest_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A small grid of forests, scored by F1 over folds."""
    return U.forest_grid(views.net(spark, sf), BASE, trees=(10, 20), feature_shares=(1.0,), contaminations=(0.05, 0.2), folds=2)


@query
def q_factor_labels(spark: SparkSession, sf: str) -> DataFrame:
    vectors = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return M.local_outlier_labels(vectors, vectors, "embedding", "vec_id").select("vec_id", *r6("anomaly_score"), F.col("predicted_anomaly").cast("long").alias("predicted_anomaly"))


@query
def q_sqli_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses whose last numbers after WHERE go one way."""
    from pyspark.sql.window import Window

    last = Window.partitionBy("ip").orderBy("ts", "row_id").rowsBetween(-10, 0)
    rows = views.sqltext(spark, sf).withColumn("value", S.scanned_value(F.col("query")))
    rows = rows.withColumn("values", F.collect_list("value").over(last))
    return rows.select("row_id", F.coalesce("value", F.lit(-1)).alias("value"), S.is_scan(F.col("values")).alias("scan"))


@query
def q_sqli_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of patterns and two stand-ins for models, combined, and the threshold rules."""
    q = F.col("query")
    rows = views.sqltext(spark, sf).withColumns({"p": S.pattern_score(q), "m": F.pmod("row_id", F.lit(11)) / 10, "a": F.pmod("row_id", F.lit(7)) / 6})
    limit = S.final_threshold(F.lit(0.58), F.col("p"), q, F.when(F.pmod("row_id", F.lit(3)) == 0, F.lit("other")).otherwise(q))
    rows = rows.withColumns({"score": S.combine(F.col("p"), F.col("m"), F.col("a")), "threshold": limit})
    by = S.sources(F.col("p"), F.col("m"), F.col("a"), F.lit(0.1), F.col("threshold"))
    return rows.select("row_id", *r6("score", "threshold"), by.alias("detected_by"))


@query
def q_sqli_models(spark: SparkSession, sf: str) -> DataFrame:
    """Detection with both models' scores: learned from seven in ten queries, applied to the others."""
    text = views.sqltext(spark, sf)
    models = M.TextModels.fit(text.where(Z.bucket("row_id") < 700), trees=20)
    return S.detect(models.score(text.where(Z.bucket("row_id") >= 700))).select("row_id", "ml_score", "advanced_score", "anomaly_score", "threshold", "predicted_anomaly", "attack_type", "detected_by")


@query
def q_sqli_differences(spark: SparkSession, sf: str) -> DataFrame:
    text = views.sqltext(spark, sf).select("query").distinct()
    rows = text.withColumn("decoded", S.decoded(F.col("query")))
    return rows.select("query", "decoded", S.differences(F.col("query"), F.col("decoded")).alias("differences"))


@query
def q_feature_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    out = X.adaptive_pipeline(views.net(spark, sf), BASE, "src_ip", 86400)
    return out.select("row_id", F.col("connection_count").alias("connection_count"), F.col("port_class").cast("long").alias("port_class"), F.col("is_port_scan_like").cast("long").alias("is_port_scan_like"), F.col("is_dos_like").cast("long").alias("is_dos_like"), *r6("bytes_per_second", "scaled_bytes", "scaled_duration"))


@query
def q_vector_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Density noise of embeddings: a neighbourhood of fixed radius in 64 dimensions."""
    rows = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return M.metric_noise(rows, "vec_id", "embedding", 1.0, 5).select(F.col("key").alias("vec_id"), F.col("noise").cast("long").alias("noise"))


@query
def q_detector_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles, caps and weights of three scores, all from one frame of scores."""
    rows = scored(spark, sf).select("is_anomaly", F.col("score_volume").alias("statistical_score"), F.col("score_duration").alias("contextual_score"), F.col("score_port").alias("collective_score"))
    grid = U.detector_grid(rows, percentiles=(90, 95, 99), caps=(0.6, 0.8))
    return grid.select(F.col("weights").cast("long").alias("weights"), "percentile", "cap", "tp", "fp", "tn", "fn", *r6("threshold", "f1"))


@query
def q_top_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Services around the rows of most bytes, in the order of the whole table."""
    out = D.top_sequences(views.net(spark, sf), "bytes", F.col("service"), ["timestamp", "row_id"], 10, 10)
    return out.select(F.col("rank").cast("long").alias("rank"), "position", *r6("score"), "sequence", "around", F.col("states").cast("long").alias("states"))


# One order of the whole table: windows by ranges with a halo.


@query
def q_whole_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return P.collective_spikes(views.net(spark, sf), ["bytes"], [], ["timestamp", "row_id"]).select("row_id", *r6("collective_score"))


@query
def q_whole_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return D.transitions(views.net(spark, sf), F.col("service"), [], ["timestamp", "row_id"]).select("state", "next_state", "n", *r6("p"))


@query
def q_whole_sequence_score(spark: SparkSession, sf: str) -> DataFrame:
    net, state, order = views.net(spark, sf), F.concat_ws("_", "service", "protocol"), ["timestamp", "row_id"]
    return D.sequence_scores(net, D.transitions(net, state, [], order), state, [], order).select("row_id", *r6("raw_score"))


@query
def q_sqli_whole_history(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.sqltext(spark, sf).withColumn("score", S.pattern_score(F.col("query")))
    return S.adaptive_threshold(scored, "score", [], ["ts", "row_id"]).select("row_id", *r6("threshold"))
