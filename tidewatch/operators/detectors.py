"""Rule and sequence detectors; each adds ``predicted_anomaly`` (0/1) and ``anomaly_score``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as X
from ..sources.staging import staged
from . import models as M
from . import order, ordered
from . import profiles as P

DOS_FEATURES = ["connection_count", "bytes_per_second", "traffic_intensity", "syn_flag", "icmp_flag", "udp_flag"]


def dos_features(df: DataFrame, key: str, seconds: int) -> DataFrame:
    out = X.window_counts(df, key, seconds)
    return out.withColumns(
        {
            "bytes_per_second": F.col("bytes") / (F.col("duration") + 0.1),
            "traffic_intensity": (F.col("connection_count") * F.col("packets")).cast("double"),
            "syn_flag": (F.col("flag").contains("S0") | F.col("flag").contains("SYN")).cast("int"),
            "icmp_flag": X.is_protocol(df, "icmp"),
            "udp_flag": X.is_protocol(df, "udp"),
        }
    )


def dos_detect(df: DataFrame, key: str = "src_ip", seconds: int = 30, percentile: float = 99.9) -> DataFrame:
    """Score: excess of each feature over its threshold, in thresholds, by the largest sum. A threshold of 0 is off."""
    rows = staged(dos_features(df, key, seconds), "dos_features")
    return dos_score(rows, P.quantile_thresholds(rows, DOS_FEATURES, percentile))


def dos_score(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Scores of a frame with the features against one row of limits; ``rows`` is read once for the largest sum and once for the scores."""
    limit = limits.first()
    part = lambda f: F.coalesce(F.greatest(F.lit(0.0), F.col(f) / limit[f] - 1), F.lit(0.0)) if (limit[f] or 0) > 0 else F.lit(0.0)
    parts = [part(f) for f in DOS_FEATURES]
    raw = sum(parts[1:], parts[0])
    top = rows.agg(F.max(raw)).first()[0] or 0.0
    out = rows.withColumn("anomaly_score", raw / top if top > 0 else F.lit(0.0))
    kind = F.when(F.col("udp_flag") == 1, "UDP Flood").when(F.col("icmp_flag") == 1, "ICMP Flood").when(F.col("syn_flag") == 1, "SYN Flood").otherwise("Generic DoS")
    hit = F.col("anomaly_score") > 0
    return out.withColumn("predicted_anomaly", hit.cast("int")).withColumn("dos_attack_type", F.when(hit, kind).otherwise("Normal"))


def transitions(df: DataFrame, state: Column, partition: list[str], order: list[str], min_freq: int = 5) -> DataFrame:
    """state, next_state, n, p. A transition seen fewer than ``min_freq`` times has probability 0.

    Without a partition the order is the whole table's, in ranges.
    """
    pairs = followed(df.withColumn("state", state), F.col("state"), partition, order, "next_state").where("next_state is not null")
    counts = pairs.groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("state"))
    return counts.withColumn("p", F.when(F.col("n") >= min_freq, share).otherwise(0.0))


def followed(df: DataFrame, state: Column, partition: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the next row's state."""
    if partition:
        return df.select(*df.columns, F.lead(state).over(Window.partitionBy(*partition).orderBy(*order)).alias(name))
    return ordered.over_ranges(df, order, 0, 1, lambda rows, own: followed(rows, state, own, order, name))


def sequence_scores(df: DataFrame, model: DataFrame, state: Column, partition: list[str], order: list[str], length: int = 10) -> DataFrame:
    """Mean -log(p / least p) of the transitions in the window of ``length`` rows that begins here; unseen ones count 10.

    Without a partition the order is the whole table's, in ranges.
    """
    if not partition:
        return ordered.over_ranges(df, order, 0, length, lambda rows, own: sequence_scores(rows, model, state, own, order, length))
    by = Window.partitionBy(*partition).orderBy(*order)
    least = model.where("p > 0").agg(F.coalesce(F.min("p"), F.lit(0.001)).alias("__least"))
    rows = df.withColumn("__state", state).withColumn("__next", F.lead(state).over(by))
    table = model.select(F.col("state").alias("__s"), F.col("next_state").alias("__n"), F.col("p").alias("__p"))
    joined = rows.join(table, (F.col("__state") == F.col("__s")) & (F.col("__next") == F.col("__n")), "left").crossJoin(F.broadcast(least))
    step = F.when(F.col("__next").isNull(), None).when(F.col("__p") > 0, -F.log(F.col("__p") / F.col("__least"))).otherwise(10.0)
    scored = joined.withColumn("__step", step).withColumn("raw_score", F.coalesce(F.avg("__step").over(by.rowsBetween(0, length - 2)), F.lit(0.0)))
    return scored.drop("__state", "__next", "__s", "__n", "__p", "__least", "__step")


def sequence_detect(df: DataFrame, state: Column, partition: list[str], order: list[str], min_freq: int = 5, length: int = 10) -> DataFrame:
    return sequence_labels(sequence_scores(df, transitions(df, state, partition, order, min_freq), state, partition, order, length))


def sequence_labels(raw: DataFrame) -> DataFrame:
    """anomaly_score (by the largest raw score) and a label from the 95th percentile on."""
    raw = staged(raw, "sequence_scores")
    top, limit = P.bounds(raw, {"s": F.col("raw_score")})["s"][1], order.quantile(raw, "raw_score", 0.95)
    out = raw.withColumn("anomaly_score", F.col("raw_score") / (top if top > 0 else 1.0))
    return out.withColumn("predicted_anomaly", (F.col("raw_score") >= F.lit(limit)).cast("int")).drop("raw_score")


#: Weights of the adaptive detector's scores, and of the models within theirs: two published mixes of forest, factor and noise.
WEIGHTS = {"statistical_score": 0.4, "contextual_score": 0.3, "ml_score": 0.2, "collective_score": 0.1}
IMPROVED_WEIGHTS = {"statistical_score": 0.3, "contextual_score": 0.4, "ml_score": 0.25, "collective_score": 0.05}
MODEL_MIXES = {"sum": (0.5, 0.5, 0.3), "share": (0.5, 0.3, 0.2)}
KINDS = {"statistical_score": "Statistical Anomaly", "contextual_score": "Contextual Anomaly", "ml_score": "Complex Anomaly", "collective_score": "Collective Anomaly"}


def normal_moments(rows: DataFrame, features: list[str], min_rows: int | None = 10) -> DataFrame:
    """Profiles of the normal rows (all, without labels) for all contexts of the adaptive detector, from one pass over them.

    ``min_rows``: of a protocol and port; None: a hundredth of all, 10 at least.
    """
    normal = rows.where("is_anomaly = 0") if "is_anomaly" in rows.columns else rows
    least = P.support(normal) if min_rows is None else min_rows
    return P.moments(normal, {name: (keys, least if name == "port" else 1) for name, keys in CONTEXTS.items()}, features)


CONTEXTS = {"global": [], "hour": ["hour_of_day"], "working": ["is_working_hours"], "port": ["protocol", "dst_port"]}


def profile_scores(rows: DataFrame, table: DataFrame, features: list[str], sigmas: float) -> DataFrame:
    """``rows`` with statistical, contextual and collective raw scores, written once."""
    out = rows
    for name, keys in CONTEXTS.items():
        out = P.score_by(out, table, name, keys, features, f"__c_{name}", sigmas)
    context = [F.col(f"__c_{name}") for name in CONTEXTS if name != "global"]
    out = out.withColumn("statistical_score", F.col("__c_global")).withColumn("contextual_score", sum(context[1:], context[0])).drop(*[f"__c_{name}" for name in CONTEXTS])
    return staged(P.collective_spikes(out, features[:3], ["src_ip"], ["timestamp", "row_id"]), "adaptive_scores")


def adaptive_scores(df: DataFrame, features: list[str], sigmas: float = 3.0, normal_only: bool = True, min_rows: int | None = 10) -> DataFrame:
    """``df`` with raw scores against profiles of its own normal rows."""
    rows = df.withColumns(X.temporal(F.col("timestamp")))
    return profile_scores(rows, normal_moments(rows if normal_only else rows.drop("is_anomaly"), features, min_rows), features, sigmas)


def fit_ml(train: DataFrame, features: list[str], key: str = "row_id", trees: int = 100, neighbours: int = 20) -> dict[str, DataFrame]:
    """What ``score_ml`` needs of a training frame, as tables: its scale (a row), the forest's nodes, and the factor's points with their densities."""
    scale = staged(X.scale_of(train, features), "scale")
    own = X.scaled_by(train, scale, features)
    nodes = staged(M.fit_isolation_forest(own, features, trees, key=key), "nodes")
    return {"scale": scale, "nodes": nodes, "factor": M.fit_local_outlier_factor(own.select(F.col(key).alias("key"), F.array(*features).alias("v")), "v", "key", neighbours)}


def score_ml(df: DataFrame, tables: dict[str, DataFrame], features: list[str], key: str = "row_id", mix: str = "sum", eps: float = 0.5, neighbours: int = 20) -> DataFrame:
    """``df`` with ml_score: scaled isolation forest and local outlier factor as fitted, and density noise of ``df`` itself.

    Features are standardised by the training frame for the forest and the factor, by ``df`` for the noise.
    """
    w_forest, w_factor, w_noise = MODEL_MIXES[mix]
    scaled = X.scaled_by(df, tables["scale"], features)
    forest = staged(M.score_isolation_forest(scaled, tables["nodes"], features).withColumnRenamed("anomaly_score", "__forest"), "forest")
    asked = scaled.select(F.col(key).alias("key"), F.array(*features).alias("v"))
    factor = staged(M.score_local_outlier_factor(asked, tables["factor"], "v", "key", neighbours).select(F.col("key").alias(key), F.col("anomaly_score").alias("__factor")), "factor")
    noise = M.density_noise(X.standardised_by(df, df, features), key, features, eps).select(F.col("key").alias(key), F.col("noise").alias("__noise"))
    found = {**P.bounds(forest, {"f": F.col("__forest")}), **P.bounds(factor, {"l": F.col("__factor")})}
    both = forest.select(key, "__forest").join(factor, key).join(noise, key)
    score = w_forest * P.scaled(F.col("__forest"), *found["f"]) + w_factor * P.scaled(F.col("__factor"), *found["l"]) + w_noise * F.col("__noise")
    return df.join(both.select(key, score.alias("ml_score")), key)


def ml_scores(df: DataFrame, train: DataFrame, features: list[str], key: str = "row_id", mix: str = "sum", trees: int = 100, eps: float = 0.5, neighbours: int = 20) -> DataFrame:
    """``fit_ml`` on one frame and ``score_ml`` of another."""
    return score_ml(df, fit_ml(train, features, key, trees, neighbours), features, key, mix, eps, neighbours)


def combined(raw: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores scaled to 0..1, their weighted sum scaled again, a label from min(95th percentile, .7) on, and the leading score's type."""
    scores = list(weights)
    found = P.bounds(raw, {c: F.col(c) for c in scores})
    out = raw.withColumns({c: P.scaled(F.col(c), *found[c]) for c in scores})
    total = sum((F.col(c) * weights[c] for c in scores[1:]), F.col(scores[0]) * weights[scores[0]])
    lo, hi = P.bounds(out, {"t": total})["t"]
    out = out.withColumn("anomaly_score", P.scaled(total, lo, hi))
    out = P.above_percentile(out, "anomaly_score", 0.95, "predicted_anomaly", cap=0.7, inclusive=True)
    top, kind = F.greatest(*scores), None
    for c in scores:
        kind = F.when(F.col(c) == top, KINDS[c]) if kind is None else kind.when(F.col(c) == top, KINDS[c])
    return out.withColumn("anomaly_type", F.when(F.col("predicted_anomaly") == 1, kind).otherwise("Normal"))


def adaptive_detect(df: DataFrame, features: list[str], sigmas: float = 3.0, normal_only: bool = True, models: bool = False) -> DataFrame:
    """Statistical, contextual, model and collective scores against profiles of normal rows, weighed .4, .3, .2 and .1.

    Without ``models`` (no forest, factor and noise) the .2 adds nothing. Raw scores are written once; bounds and percentile read that.
    """
    raw = adaptive_scores(df, features, sigmas, normal_only)
    if models:
        train = df.where("is_anomaly = 0") if normal_only and "is_anomaly" in df.columns else df
        raw = staged(ml_scores(raw, train, features), "adaptive_models")
    return combined(raw, {c: w for c, w in WEIGHTS.items() if models or c != "ml_score"})


#: How far, in deviations, a row must be from a profile: the base detector's scale and the improved one's, which runs the other way.
IMPROVED_SENSITIVITY = {"low": 5.0, "medium": 3.0, "high": 1.5}


def improved_types(df: DataFrame, least: float = 0.3) -> DataFrame:
    """anomaly_type of flagged rows (scaled scores, is_dos_like, is_port_scan_like, rates, dst_port, hour_of_day): the kind whose share of the four scores is largest and
    at least ``least``, statistical ones in detail; else mixed. Rates are compared with three times the frame's mean.
    """
    scores = list(KINDS)
    total = sum((F.col(c) for c in scores[1:]), F.col(scores[0])) + P.EPSILON
    mean = df.agg(F.avg("bytes_per_second").alias("b"), F.avg("packets_per_second").alias("p")).first()
    burst = F.col("packets_per_second") > 3 * (mean.p or 0.0)
    detail = (
        F.when((F.col("is_dos_like") == 1) & (F.col("bytes_per_second") > 5000), "High-Bandwidth DoS Attack")
        .when(F.col("is_dos_like") == 1, "DoS Attack")
        .when(F.col("is_port_scan_like") == 1, "Port Scan")
        .when((F.col("bytes_per_second") > 3 * (mean.b or 0.0)) & burst, "Traffic Burst")
        .when(F.col("bytes_per_second") > 3 * (mean.b or 0.0), "Volume Anomaly")
        .when(F.col("dst_port").isin(X.SUSPICIOUS_PORTS), "Suspicious Port")
        .when((F.col("hour_of_day") < 6) | (F.col("hour_of_day") > 22), "After-Hours Activity")
        .otherwise("Statistical Anomaly")
    )
    top = F.greatest(*scores)
    kind = F.when(top / total < least, "Mixed Anomaly").when(F.col("statistical_score") == top, detail)
    for c in scores[1:]:
        kind = kind.when(F.col(c) == top, KINDS[c])
    return df.withColumn("anomaly_type", F.when(F.col("predicted_anomaly") == 1, kind).otherwise("Normal"))


def statistical_subtype(df: DataFrame) -> DataFrame:
    """What a statistical anomaly is about; the first that fits: DoS, port scan, volume (over three times the mean
    rate), suspicious port, time (before 6 or after 22), else statistical."""
    rate = F.col("bytes") / (F.col("duration") + 0.1)
    mean = df.agg(F.avg(rate)).first()[0]
    crowd = order.quantile(df, "connection_count", 0.95)
    hour = F.hour("timestamp")
    kind = (
        F.when(F.col("connection_count") > F.lit(crowd), "DoS Attack")
        .when(X.port_scan_like() == 1, "Port Scan")
        .when(rate > 3 * F.lit(mean), "Volume Anomaly")
        .when(F.col("dst_port").isin(X.SUSPICIOUS_PORTS), "Suspicious Port")
        .when((hour < 6) | (hour > 22), "Time Anomaly")
        .otherwise("Statistical Anomaly")
    )
    return df.withColumn("anomaly_subtype", kind)


def dominant_type(df: DataFrame, weights: dict[str, float], least: float = 0.3) -> DataFrame:
    """The score with the largest weighted share, if that reaches ``least``; else mixed, and none where all are 0."""
    parts = {s: F.coalesce(F.col(s), F.lit(0.0)) * w for s, w in weights.items()}
    total = sum(list(parts.values())[1:], next(iter(parts.values())))
    top = F.greatest(*parts.values())
    name = None
    for s, p in parts.items():
        name = F.when(p == top, s) if name is None else name.when(p == top, s)
    return df.withColumn("dominant", F.when(total <= 0, "none").when(top / total >= least, name).otherwise("mixed"))


def top_sequences(scored: DataFrame, score: str, state: Column, order_by: list[str], k: int = 10, length: int = 10, shown: int = 5, width: int = 30) -> DataFrame:
    """rank, position, score and sequence of the ``k`` highest scores (ties: first in order): the states around each, half of ``length`` to either side.

    Positions are those of one order over the table, counted by ranges; only the places around the best are joined back, k times (length + 1) at
    most. A sequence of over ``shown`` states is its first and last two, a text of over ``width`` letters is cut; columns ``around`` and ``states`` have all.
    """
    rows = scored.select(F.struct(*order_by).alias("__o"), F.col(score).alias("__score"), state.cast("string").alias("__state"), F.lit(1).alias("__one"))
    placed = staged(order.running(rows, [], "__o", ["__one"]).select(F.col("before___one").alias("position"), "__score", "__state"), "positions")
    best = placed.where("__score is not null").orderBy(F.desc("__score"), "position").limit(k)
    best = staged(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__score"), "position"))).select("rank", "position", F.col("__score").alias("score")), "best")  # k rows
    half = length // 2
    places = best.select("rank", F.explode(F.sequence(F.col("position") - half, F.col("position") + half)).alias("position"))
    around = places.join(placed.select("position", "__state"), "position").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("__state", F.lit("null")).alias("state")))).alias("x"))
    states = F.transform("x", lambda s: s["state"])
    dots = F.array(F.lit("..."))
    short = F.when(F.size(states) > shown, F.concat(F.slice(states, 1, 2), dots, F.slice(states, -2, 2))).otherwise(states)
    text = F.array_join(short, " -> ")
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
    return best.join(around, "rank").select("rank", "position", "score", cut.alias("sequence"), F.array_join(states, " -> ").alias("around"), F.size(states).alias("states"))


def sequence_statistics(model: DataFrame) -> DataFrame:
    """One row about a transition table: states, edges, edges with a probability, and the least and mean probability."""
    return model.agg(F.count_distinct("state").alias("states"), F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("p") > 0, 1)).alias("likely"), F.min(F.when(F.col("p") > 0, F.col("p"))).alias("least_p"), F.avg(F.when(F.col("p") > 0, F.col("p"))).alias("mean_p"))


def heat_map(model: DataFrame, states: list[str]) -> DataFrame:
    """A row per state and a column per next state with its probability, for the states given."""
    return model.where(F.col("state").isin(states)).groupBy("state").pivot("next_state", states).agg(F.max("p")).na.fill(0.0)
