"""What an address asked before, as state of a stream: scans, escalation and probes over its last queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import sqltext as S

#: Queries before the one at hand that count.
LAST = 10
IDLE_MS = 3_600_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTEXT = "ip string, row_id long, ts timestamp, query string, scan boolean, escalates boolean, probing boolean, counter double, context_score double"
_KEPT = "query string, value long, complexity double, probes long"


def scanning(values: list[int]) -> bool:
    """``sqltext.is_scan`` of a list."""
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    return len(values) >= 3 and (min(steps) >= 0 or max(steps) <= 0)


def escalating(values: list[float]) -> bool:
    """``sqltext.escalates`` of a list."""
    steady = all(values[i] >= 0.8 * values[i - 1] for i in range(1, len(values) - 1))
    return len(values) >= 3 and steady and values[-1] > 1.5 * values[0]


class AddressHistory(StatefulProcessor):
    """Of each address its last ``LAST`` queries, its pace and the time of its last one; all go ``IDLE_MS`` after the last batch that had it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getListState("texts", _KEPT)
        self.pace = handle.getValueState("pace", "counter double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = list(self.texts.get()) if self.texts.exists() else []
        counter, last = self.pace.get() if self.pace.exists() else (0.0, None)
        batch = pd.concat(list(rows)).sort_values(["micros", "row_id"])
        out = []
        for r in batch.itertuples(index=False):
            gap = None if last is None else r.micros - last
            counter += 0.0 if gap is None or gap >= 1_000_000 else 1.0 if gap < 500_000 else 0.5
            value = None if pd.isna(r.value) else int(r.value)
            own = [*past, (r.query, value, None if pd.isna(r.complexity) else float(r.complexity), int(r.probes))]
            values, complexities = [x[1] for x in own if x[1] is not None], [x[2] for x in own if x[2] is not None]
            scan, up, probing = scanning(values), escalating(complexities), sum(x[3] for x in own) >= 2
            rate = 0.0 if gap is None or gap >= 1_000_000 else 0.05 if gap < 500_000 else 0.02
            crowd = min(0.3, 0.05 * counter) if counter > 5 else 0.0
            score = min(0.6, rate + crowd + 0.15 * scan + 0.2 * up + 0.25 * probing)
            out.append((key[0], r.row_id, r.ts, r.query, scan, up, probing, counter, score))
            past, last = own[-LAST:], int(r.micros)
        self.texts.put(past)
        self.pace.update((counter, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + IDLE_MS)
        yield pd.DataFrame(out, columns=["ip", "row_id", "ts", "query", "scan", "escalates", "probing", "counter", "context_score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.texts.clear()
        self.pace.clear()
        return iter(())

    def close(self) -> None:
        pass


def address_context(stream: DataFrame) -> DataFrame:
    """Queries (row_id, ts, ip, query) with what ``sqltext.context_score`` gives them, each batch in order of time after those before it.

    What a row needs of its own text is computed in expressions; state holds eleven rows an address at most. Rows without an
    address have no history and score 0. The session's state store has to be RocksDB (``use_rocksdb``).
    """
    text = F.col("query")
    probes = F.coalesce(S.hits(text, S.RECON), F.lit(0)).cast("long")
    rows = stream.select("ip", "row_id", F.col("ts").cast("timestamp").alias("ts"), "query", S.scanned_value(text).alias("value"), S.complexity(text).cast("double").alias("complexity"), probes.alias("probes"))
    rows = rows.withColumn("micros", F.unix_micros("ts"))
    known = rows.where("ip is not null").groupBy("ip").transformWithStateInPandas(AddressHistory(), CONTEXT, "append", "ProcessingTime")
    false, zero = F.lit(False), F.lit(0.0)
    return known.unionByName(rows.where("ip is null").select("ip", "row_id", "ts", "query", false.alias("scan"), false.alias("escalates"), false.alias("probing"), zero.alias("counter"), zero.alias("context_score")))


def use_rocksdb(spark) -> None:
    """State of this kind needs a store that holds several columns of it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
