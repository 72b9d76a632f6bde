"""Seeds for repeats: winnowed anchors, the runs of windows they stand for, and classes of equal runs.

A repeat of at least L units (words or bytes) is a window of L units that occurs twice.
Every window is represented by one anchor: the k-gram with the least hash inside it
(the rightmost of equals), so that equal windows meet at equal anchors. Neighbouring
windows with one anchor form a run. Runs are equal (a class) where the 128-bit BLAKE2b
digests of their bytes are; these match in all their windows. What is left are anchors with more than one
class: there, parts of the runs may match, and the callers extend from the anchor
to both sides, comparing the texts themselves.

Rows: h hash of the anchor, r and s the run's digest, k, t and u the document's key,
[a, b] the starts of the run's windows, p the anchor's start, n how many equal runs the
row stands for. Equal runs within an Arrow batch are put
together before anything is shuffled, so an anchor that a third of all documents share
with equal surroundings leaves a task as a single row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import KEY, partitions_for

#: kind: SETTLED rows are repeats whatever else is found, SEED rows take part in the search, OPEN rows are for the caller.
SETTLED, SEED, OPEN = 0, 1, 2
ROWS = "kind int, h long, r long, s long, k long, t long, u long, a int, b int, p int, n int"
NAMES = ["kind", "h", "r", "s", *KEY, "a", "b", "p", "n"]
_TYPES = [pa.int32(), *[pa.int64()] * 6, *[pa.int32()] * 4]
Rows = dict[str, np.ndarray]


def to_batch(rows: Rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c].astype(t.to_pandas_dtype(), copy=False), t) for c, t in zip(NAMES, _TYPES, strict=True)], NAMES)


def from_batch(batch: pa.RecordBatch) -> Rows:
    return {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(NAMES)}


def take(rows: Rows, which: np.ndarray, **changed: int) -> Rows:
    out = {c: v[which] for c, v in rows.items()}
    for c, v in changed.items():
        out[c] = np.full(len(out["h"]), v, rows[c].dtype)
    return out


def join(parts: list[Rows]) -> Rows:
    return {c: np.concatenate([p[c] for p in parts]) for c in NAMES}


def digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digest of each buf[s:e]."""
    view, blake = memoryview(np.ascontiguousarray(buf)), hashlib.blake2b
    both = b"".join([blake(view[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    halves = np.frombuffer(both, "<i8").reshape(len(starts), 2)
    return halves[:, 0], halves[:, 1]


def poly_prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of value * BASE^i, and BASE^-i: any span's hash is two look-ups and a product away."""
    up, down = B._tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, down


def poly_span(prefix: tuple[np.ndarray, np.ndarray], s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total, down = prefix
    return B.mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * B.STEP)


def runs(grams: np.ndarray, valid: np.ndarray, doc: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of each run. grams: hash of the k-gram at each unit; valid: whether a window starts there."""
    anchor = B.sliding_min_positions(grams, w)[: len(valid)]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, at
    anchor = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(at) - 1]
    return at[first], at[last], anchor[first]


def put_together(rows: Rows, *, later: bool) -> Rows:
    """Equal runs of a batch as one seed; the others are settled. later: the first of a class is no repeat by itself."""
    done = take(rows, rows["kind"] == SETTLED)  # settled before
    done["h"] = _spread(done)
    rows = take(rows, rows["kind"] != SETTLED)
    if not len(rows["h"]):
        return done
    rows = take(rows, np.lexsort(tuple(rows[c] for c in ("a", "u", "t", "k", "s", "r", "h"))))
    new, same = _classes(rows)
    first = np.flatnonzero(new)
    weight = np.add.reduceat(np.where(same, 0, rows["n"]), first)
    seeds = take(rows, new)
    seeds["n"] = weight.astype(rows["n"].dtype)
    gone = ~new & ~same if later else (np.repeat(weight, np.diff(np.r_[first, len(new)])) > 1) & ~new
    settled = take(rows, gone, kind=SETTLED)
    # They need no meeting, so they spread by document; the anchor's hash can be had back.
    settled["h"] = settled["h"] ^ _spread(settled)
    return join([seeds, settled, done])


def _spread(rows: Rows) -> np.ndarray:
    return B.mix(rows["k"].view(np.uint64) ^ rows["t"].view(np.uint64)).view(np.int64)


def _classes(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: where a class begins, and rows that repeat the row before (one document that is listed twice)."""
    n = len(rows["h"])
    new = np.ones(n, bool)
    new[1:] = False
    for c in ("h", "r", "s"):
        new[1:] |= rows[c][1:] != rows[c][:-1]
    same = np.zeros(n, bool)
    same[1:] = ~new[1:]
    for c in ("k", "t", "u", "a"):
        same[1:] &= rows[c][1:] == rows[c][:-1]
    return new, same


def _settle(later: bool, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream rows sorted by h, r, s and document. Memory: a batch and the first row of the class at hand."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows | None = None  # the first row of the last class; its n: rows of the class so far
        many = opened = removed = False  # its h has other classes too; it was returned as OPEN; as SETTLED
        for batch in batches:
            rows = from_batch(batch)
            done = rows["kind"] == SETTLED
            out = []
            if done.any():
                own = take(rows, done)
                own["h"] = own["h"] ^ _spread(own)
                out.append(own)
            rows = take(rows, ~done)
            if held is not None:
                rows = join([held, rows])
            if len(rows["h"]):
                new, same = _classes(rows)
                first = np.flatnonzero(new)
                size = np.diff(np.r_[first, len(new)])
                weight = np.add.reduceat(np.where(same, 0, rows["n"]), first)
                if later:
                    gone = ~new & ~same
                else:
                    gone = np.repeat(weight, size) > 1
                    gone &= ~same
                    gone[0] &= not removed
                out.append(take(rows, gone, kind=SETTLED))
                heads = take(rows, new)
                of = np.ones(len(first), bool)
                of[1:] = heads["h"][1:] != heads["h"][:-1]
                group = np.flatnonzero(of)
                classes = np.diff(np.r_[group, len(of)])
                classes[0] += many
                # a hot anchor's classes are dealt over tasks, none of which knows whether there are others
                classes = np.where(np.isin(heads["h"][group], hot), 2, classes)
                wide = np.repeat(classes > 1, np.diff(np.r_[group, len(of)]))
                show = wide.copy()
                show[0] &= not opened
                out.append(take(heads, show, kind=OPEN))
                only = len(first) == 1
                many = bool(classes[-1] > 1)
                opened = bool(wide[-1]) or (only and opened)
                removed = bool(weight[-1] > 1) or (only and removed)
                held = take(heads, np.array([len(first) - 1]))
                held["n"] = weight[-1:].astype(held["n"].dtype)
            if out:
                yield to_batch(join(out))

    return each


def hot_anchors(base: DataFrame, seeds: Callable) -> list[int]:
    """Anchors that hold a large share of all runs, at most ``MOST_HOT``: estimated from one document in ``SAMPLE``.

    They are dealt over tasks by what surrounds them. An estimate that is off costs balance and nothing else: results are the same whatever is hot.
    """
    drawn = base.where(F.pmod(F.xxhash64(F.lit(11), *KEY), F.lit(SAMPLE)) == 0).mapInArrow(seeds, ROWS)
    runs = F.sum("n").alias("n")
    most = drawn.where(F.col("kind") == SEED).groupBy("h").agg(runs).where(F.col("n") >= LEAST_HOT).orderBy(F.desc("n"), "h").limit(MOST_HOT).collect()
    return [r.h for r in most]


#: One document in so many is drawn to find hot anchors; runs of one anchor among these that make it hot; hot anchors; tasks that each is dealt over.
SAMPLE, LEAST_HOT, MOST_HOT, DEALT = 64, 50, 1000, 64


def settle(seeds: DataFrame, *, later: bool, growth: float, like: DataFrame | None = None, hot: list[int] = ()) -> DataFrame:
    """SETTLED rows (repeats in all their windows) and OPEN rows (one of each class of an anchor that has several).

    ``later``: a class's first run isn't settled by the others. ``like``: the frame whose size times ``growth`` the seeds have. ``hot``: anchors whose
    classes are dealt over tasks, all of them OPEN.
    """
    n = partitions_for(seeds if like is None else like, growth)
    deal = F.when(F.col("h").isin(list(hot)), F.pmod("r", F.lit(DEALT))).otherwise(F.lit(0)) if hot else F.lit(0)
    ready = seeds.repartition(n, "h", deal).sortWithinPartitions("h", "r", "s", *KEY, "a")
    return ready.mapInArrow(_settle(later, np.array(sorted(hot), np.int64)), ROWS)


def dealt(opened: DataFrame, hot: list[int], runs: int) -> DataFrame:
    """OPEN rows with ``parts``: the tasks that read them. A hot anchor of over ``runs`` rows is dealt over several, and its first row is in each."""
    if not hot:
        return opened.withColumn("parts", F.array(F.lit(0)))
    own = F.struct(*KEY, "p")
    sizes = opened.where(F.col("h").isin(list(hot))).groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min(own).alias("first"))
    sizes = sizes.where(F.col("rows") > runs).select("h", F.ceil(F.col("rows") / runs).cast("int").alias("tasks"), "first")
    spread = F.when(F.col("tasks").isNull(), F.array(F.lit(0))).when(own == F.col("first"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64(*KEY, "p"), "tasks").cast("int")))
    return opened.join(F.broadcast(sizes), "h", "left").withColumn("parts", spread).drop("tasks", "first")  # MOST_HOT rows at most


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias("found"))
