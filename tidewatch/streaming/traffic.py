"""Traffic as a stream: window counts with a watermark, and per-address query rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import profiles as P


def events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files that appear in a folder, with the zone-less event time as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(stream: DataFrame, key: str, window: str = "5 minutes", watermark: str = "1 minute", event_id: str = "event_id") -> DataFrame:
    """Events by window and key, each event once; later than the watermark means dropped."""
    once = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([event_id])
    counts = once.groupBy(F.window("ts", window).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "key", "n", "total")


def bursts(stream: DataFrame, key: str, most: int, window: str = "5 minutes", watermark: str = "1 minute") -> DataFrame:
    """Windows in which a key has more than ``most`` events."""
    return window_counts(stream, key, window, watermark).where(F.col("n") > most)


PACE = "ip string, events long, counter double, last_ts timestamp"


def _pace(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Adds 1 for each event within half a second of the one before, .5 within a second; state goes after an hour without events."""
    if state.hasTimedOut:
        state.remove()
        return
    events, counter, last = state.get if state.exists else (0, 0.0, None)
    times = pd.concat([p["ts"] for p in parts]).sort_values()
    before = times.shift()
    if last is not None:
        before.iloc[0] = pd.Timestamp(last, unit="us")
    gaps = (times - before).dt.total_seconds()
    counter += float((gaps < 0.5).sum() + 0.5 * ((gaps >= 0.5) & (gaps < 1)).sum())
    events, newest = events + len(times), times.iloc[-1]
    state.update((events, counter, int(newest.value // 1000)))
    state.setTimeoutDuration(3_600_000)
    yield pd.DataFrame({"ip": [key[0]], "events": [events], "counter": [counter], "last_ts": [newest]})


def address_pace(stream: DataFrame) -> DataFrame:
    """Running pace of each address (columns ip, ts): keyed state, one row an address and batch."""
    return stream.select("ip", "ts").groupBy("ip").applyInPandasWithState(_pace, PACE, "events long, counter double, last long", "update", "ProcessingTimeTimeout")


SCORED = "ip string, row_id long, ts timestamp, score double, threshold double, predicted_anomaly int"


def _thresholds(base: float, most: int):
    def each(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "row_id"])
        limits = []
        for score in rows["score"]:
            limits.append(threshold_of(past, base))
            past = [*past, float(score)][-most:]
        state.update((past,))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"ip": key[0], "row_id": rows["row_id"], "ts": rows["ts"], "score": rows["score"], "threshold": limits, "predicted_anomaly": [int(s >= t) for s, t in zip(rows["score"], limits, strict=True)]})

    return each


def threshold_of(past: list[float], base: float = 0.5) -> float:
    """From over ten past scores: the middle of the gap, if sorted scores part by more than .15; else mean and two deviations; in [.4, .8]."""
    if len(past) <= 10:
        return base
    own = sorted(past)
    gaps = [i for i in range(1, len(own)) if own[i] - own[i - 1] > 0.15]
    mean = sum(own) / len(own)
    found = (own[gaps[0] - 1] + own[gaps[-1]]) / 2 if gaps else mean + 2 * (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5
    return min(0.8, max(0.4, found))


def adaptive_labels(stream: DataFrame, base: float = 0.5, history: int = 100) -> DataFrame:
    """Scored rows (ip, row_id, ts, score) labelled against the last ``history`` scores of their address: keyed state, in order of time within a batch."""
    return stream.select("ip", "row_id", "ts", "score").groupBy("ip").applyInPandasWithState(_thresholds(base, history), SCORED, "past array<double>", "append", "ProcessingTimeTimeout")


#: Size of a quantile sketch: quartiles are off by half a per cent of the ranks at most (KLL, 99 of 100 times).
SKETCH = 600
RANK_ERROR = 0.005


def profile_updates(stream: DataFrame, key: str, value: str, window: str = "1 hour", watermark: str = "10 minutes", size: int = SKETCH) -> DataFrame:
    """Profiles that grow with the stream: count, sums, ends and a quantile sketch by key and window. ``merged_profile`` adds up what a sink has of them."""
    x = F.col(value).cast("double")
    timed = stream.withWatermark("ts", watermark).where(x.isNotNull())
    out = timed.groupBy(F.window("ts", window).alias("w"), F.col(key).alias("key")).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("min"), F.max(x).alias("max"), F.kll_sketch_agg_double(x, size).alias("sketch"))
    return out.select(F.col("w.start").alias("window_start"), "key", "n", "total", "squares", "min", "max", "sketch")


def merged_profile(updates: DataFrame) -> DataFrame:
    """key, n, mean, sample deviation, quartiles, their range and ends from partial profiles; quartiles within ``RANK_ERROR`` of the exact ranks."""
    sums = updates.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))
    mean = F.col("total") / F.col("n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1))))
    q = {n: F.kll_sketch_get_quantile_double("sketch", F.lit(s)) for n, s in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return sums.select("key", "n", mean.alias("mean"), spread.alias("std"), *[c.alias(n) for n, c in q.items()], (q["q3"] - q["q1"]).alias("iqr"), "min", "max")


def stream_thresholds(merged: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """key and threshold: the rule of ``profiles.thresholds`` on a merged profile."""
    return P.thresholds(merged.withColumnRenamed("key", "feature"), sigmas).withColumnRenamed("feature", "key")


def late_rows(query) -> int:
    """How many rows a running query has dropped as later than its watermark, over the progress that it remembers; ``LateRows`` counts all."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


class LateRows(StreamingQueryListener):
    """Rows that queries have dropped as later than their watermarks, added up over their whole lives, however many batches.

    ``spark.streams.addListener`` it before a query starts; ``of(query)`` is exact where late rows meet a stateful operator one by
    one, as in ``window_counts``, which drops repeats first.
    """

    def __init__(self):
        super().__init__()
        self.dropped: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        own = str(event.progress.id)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[own] = self.dropped.get(own, 0) + late
        self.batches[own] = self.batches.get(own, 0) + 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def of(self, query) -> int:
        return self.dropped.get(str(query.id), 0)
