"""Suffix-array dedup over bytes: an enhanced suffix array, sharded by anchor, and its common-prefix interval tree.

Every string of ``MIN_BYTES`` bytes is represented by one winnowed anchor in it (see
``anchors``), so the suffixes that begin at anchors are enough: a repeat is a common
prefix of two such suffixes together with a common extension to the left. A suffix is taken
as far to both sides as the windows of its anchor's run go. All suffixes of an anchor
are a shard: they are sorted, neighbours' common prefixes are taken, and a stack scan
walks the tree of common-prefix intervals from the leaves. Where children of an interval
meet, their left contexts are compared (left-extension diversity): contexts sorted from the
anchor leftwards have intervals of their own, and each that members of several children
share is a maximal repeat, with all the interval's members that have it as its occurrences.

Suffixes with the same surroundings (by the 128-bit digest of their bytes) are one leaf with several occurrences;
trees compare the bytes themselves.

Hot anchors: a shard of over ``SHARD`` different surroundings is split by longer prefixes. Repeats with low to
low + step - 1 bytes to the left of the anchor all hold the string of low bytes to its left and
``MIN_BYTES`` - low - step + 1 from it to the right, so suffixes meet by that string instead, once for each range.
Step falls until shards fit; when it is 1 the string is all of the ``MIN_BYTES`` bytes. Suffixes that share
such a string are streamed in the order of their right contexts and not held: a repeat is a range of ranks.

``groups`` gives the repeats with every occurrence. ``dedup`` removes what the groups cover: in a large shard only groups
are listed that cover more than those within deeper intervals do, and a task adds up its groups' occurrences by suffix
before anything is shuffled. A repeat goes as far as
the windows of one anchor do: one that spans several anchors comes as one group for each of them, all
holding their part of it.

Defined results: a null or empty text has no bytes; rows equal in doc_id and text are one
document listed twice and are no repeats of each other; an empty table gives no rows;
other columns, whatever their names, are ignored. A very long text is one row: it is hashed in segments,
and its suffixes are cut to what their windows hold.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import bytetext as B
from .common import KEY, Workspace, compact, keyed, partitions_for, release
from .substrings import united

MIN_BYTES = 400
SEED_BYTES = 32
SHARD = 20_000
SEGMENT = 1 << 18
SUFFIXES = "h long, low int, k long, t long, u long, p int, left binary, right binary"
SUFFIX_NAMES = ["h", "low", *KEY, "p", "left", "right"]
_SUFFIX_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.binary(), pa.binary()]
#: Of a streamed shard (h, low) also the rank of each suffix, and for each repeat its length to either side (start, end) and first and last rank.
FOUND = "repeat binary, k long, t long, u long, p int, start int, end int, h long, low int, rank long, last long"
FOUND_NAMES = ["repeat", *KEY, "p", "start", "end", "h", "low", "rank", "last"]
_FOUND_TYPES = [pa.binary(), *[pa.int64()] * 3, *[pa.int32()] * 3, pa.int64(), pa.int32(), pa.int64(), pa.int64()]
RESULT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _seeds(min_bytes: int, seed_bytes: int):
    w = min_bytes - seed_bytes + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [batch.column(i).to_numpy() for i in range(3)], []
            for piece in B.slices(batch.column(4), SEGMENT):
                for lo in range(0, max(1, len(piece.buf) - min_bytes + 1), SEGMENT):  # a longer text: windows that start in each segment
                    buf = piece.buf[lo : lo + SEGMENT + min_bytes - 1]
                    n = len(buf) - min_bytes + 1
                    if n <= 0:
                        continue
                    doc = np.searchsorted(piece.offsets, np.arange(lo, lo + len(buf)), side="right").astype(np.int32) - 1
                    valid = doc[:n] == doc[min_bytes - 1 :]
                    prefix = A.poly_prefix(buf.astype(np.uint64) + np.uint64(1))
                    i = np.arange(len(buf) - seed_bytes + 1)
                    grams = A.poly_span(prefix, i, i + seed_bytes)
                    a, b, p = A.runs(grams, valid, doc, w)
                    r, s = A.digests(buf, a, b + min_bytes)
                    row, at = doc[a], piece.offsets[doc[a]] - lo
                    one = np.ones(len(a), np.int32)
                    found.append(dict(zip(A.NAMES, (one * A.SEED, grams[p].view(np.int64), r, s, *(x[piece.lo + row] for x in keys), a - at, b - at, p - at, one), strict=True)))
            if found:
                yield A.to_batch(A.put_together(A.join(found), later=False))

    return each


def _suffixes(min_bytes: int):
    """The bytes to the left (reversed) and to the right of each open anchor, as far as its run's windows go."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened, rows = batch.column(5), []
            for piece in B.slices(batch.column(4)):
                for i in range(piece.lo, piece.hi):
                    text = piece.buf[piece.offsets[i - piece.lo] : piece.offsets[i - piece.lo + 1]].tobytes()
                    key = [batch.column(c)[i].as_py() for c in range(3)]
                    rows += [(x["h"], 0, *key, x["p"], text[x["a"] : x["p"]][::-1], text[x["p"] : x["b"] + min_bytes]) for x in opened[i].as_py()]
                if len(rows) > 4000:
                    yield _batch(rows, SUFFIX_NAMES, _SUFFIX_TYPES)
                    rows = []
            if rows:
                yield _batch(rows, SUFFIX_NAMES, _SUFFIX_TYPES)

    return each


def prefix_string(left: bytes, right: bytes, low: int, step: int, least: int, seed: int) -> bytes | None:
    """What all repeats with ``low`` to low + step - 1 bytes to the left hold; None where the suffix is too short for any."""
    d = max(seed, least + 1 - low - step)
    return left[:low][::-1] + right[:d] if len(left) >= low and len(right) >= d else None


def _split(old: int, new: int, least: int, seed: int):
    """Suffixes of shards with ``old`` left lengths under the longer strings of ``new`` left lengths each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, first, *key, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(first, first + old, new):
                    if (own := prefix_string(left, right, low, new, least, seed)) is not None:
                        rows.append((int.from_bytes(A.digest(own)[:8], "little", signed=True), low, *key, left, right))
                if len(rows) > 4000:
                    yield _batch(rows, SUFFIX_NAMES, _SUFFIX_TYPES)
                    rows = []
            if rows:
                yield _batch(rows, SUFFIX_NAMES, _SUFFIX_TYPES)

    return each


def common_prefix(u: bytes, v: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(u), len(v))
    if u[:hi] == v[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if u[lo:mid] == v[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(texts: list[bytes], order: list[int]) -> Iterator[tuple[int, list[list[int]]]]:
    """Common-prefix intervals of the texts, which ``order`` sorts, leaves first: depth, and the members of each child.

    A stack scan: an open interval closes where a neighbour's common prefix is shorter. A child is a text or an interval within.
    """
    stack: list[tuple[int, list[list[int]]]] = []
    last = [order[0]]
    for a, b in zip(order, order[1:], strict=False):
        depth = common_prefix(texts[a], texts[b])
        while stack and stack[-1][0] > depth:
            d, children = stack.pop()
            yield d, (own := [*children, last])
            last = [x for child in own for x in child]
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(last)
        else:
            stack.append((depth, [last]))
        last = [b]
    while stack:
        d, children = stack.pop()
        yield d, (own := [*children, last])
        last = [x for child in own for x in child]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int, low: int = 0, high: int = 1 << 30) -> Iterator[tuple[int, int, list[int]]]:
    """Bytes to the left and to the right of the anchor, and all occurrences, of each maximal repeat of ``least`` bytes or more.

    ``low`` and ``high``: only repeats with so many bytes to the left. A right interval's members are walked by the intervals of
    their left contexts; where members of several children of the right interval share one, neither side can be extended.
    """
    n = len(rights)
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    for depth, children in intervals(rights, sorted(range(n), key=rights.__getitem__)):
        of = {i: c for c, child in enumerate(children) for i in child}
        for left, groups in intervals(lefts, sorted(of, key=rank.__getitem__)):
            if left + depth >= least and low <= left <= high:
                members = [i for g in groups for i in g]
                if any(of[i] != of[members[0]] for i in members):
                    yield left, depth, members


class _Order:
    """Left contexts in sorted order: how far any two, or all of a range, agree from the anchor leftwards."""

    def __init__(self, lefts: list[bytes]):
        self.by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
        self.rank = np.empty(len(lefts), np.int64)
        self.rank[self.by_left] = np.arange(len(lefts))
        beside = [common_prefix(lefts[a], lefts[b]) for a, b in zip(self.by_left, self.by_left[1:], strict=False)]
        # levels[i][r]: the least of beside[r : r + 2^i]
        self.levels = [np.array(beside, np.int64)]
        while 2 << len(self.levels) - 1 <= len(beside):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def common(self, x: int, y: int) -> int:
        """What the contexts of ranks x < y have in common."""
        i = (y - x).bit_length() - 1
        return int(min(self.levels[i][x], self.levels[i][y - (1 << i)]))

    def interval(self, x: int, depth: int) -> tuple[int, int]:
        """The ranks around x whose contexts agree with its own in ``depth`` bytes."""
        lo = hi = x
        for i in range(len(self.levels) - 1, -1, -1):
            step, level = 1 << i, self.levels[i]
            while lo >= step and level[lo - step] >= depth:
                lo -= step
            while hi + step <= len(self.rank) - 1 and level[hi] >= depth:
                hi += step
        return lo, hi


#: Shards of no more suffixes list all their repeats; larger ones those that cover something new, each with all its occurrences.
LISTED = 24


def covering_repeats(lefts: list[bytes], rights: list[bytes], least: int, low: int = 0, high: int = 1 << 30) -> Iterator[tuple[int, int, list[int]]]:
    """Of the maximal repeats those that cover what deeper ones don't, each with all its occurrences.

    The same walk: where children of a right interval meet, each member of all but the largest asks for the smallest interval
    of left contexts that holds a member of another child. Left-extension diversity holds there, since contexts
    agree in no more bytes than that, and every larger interval of left contexts adds shorter repeats of the same members only.
    """
    n = len(rights)
    if n <= LISTED:
        yield from maximal_repeats(lefts, rights, least, low, high)
        return
    order = _Order(lefts)
    held: dict[int, np.ndarray] = {}  # of closed intervals, by their first member: members' ranks in order
    for depth, children in intervals(rights, sorted(range(n), key=rights.__getitem__)):
        parts = sorted((held.pop(c[0]) if c[0] in held else np.sort(order.rank[c]) for c in children), key=len)
        large, asked = parts.pop(), set()
        while parts:
            small = parts.pop()
            for x, at in zip(small.tolist(), np.searchsorted(large, small).tolist(), strict=True):
                left = max(order.common(int(large[at - 1]), x) if at else -1, order.common(x, int(large[at])) if at < len(large) else -1)
                if left + depth >= least and low <= left <= high:
                    asked.add((left, *order.interval(x, left)))
            large = np.sort(np.concatenate([large, small]), kind="stable")
        for left, lo, hi in asked:
            yield left, depth, [order.by_left[r] for r in large[np.searchsorted(large, lo) : np.searchsorted(large, hi, side="right")].tolist()]
        held[children[0][0]] = large


def cover(lefts: list[bytes], rights: list[bytes], least: int, low: int = 0, high: int = 1 << 30) -> list[tuple[int, int] | None]:
    """How far the repeats of each suffix go to either side: all hold the anchor, so that is what they cover."""
    left, right = np.full(len(rights), -1, np.int64), np.full(len(rights), -1, np.int64)
    for to_left, to_right, members in covering_repeats(lefts, rights, least, low, high):
        own = np.array(members)
        left[own], right[own] = np.maximum(left[own], to_left), np.maximum(right[own], to_right)
    return [(a, b) if b >= 0 else None for a, b in zip(left.tolist(), right.tolist(), strict=True)]


def _shard(rows: list[tuple], least: int, step: int, spans: bool) -> Iterator[tuple]:
    """The repeats of a shard's suffixes, as rows of FOUND; ``spans``: what they cover, one row a suffix, without a name."""
    if len(rows) < 2:
        return
    lefts, rights, low = [r[6] for r in rows], [r[7] for r in rows], rows[0][1]
    high = low + step - 1
    if spans:
        for r, span in zip(rows, cover(lefts, rights, least, low, high), strict=True):
            if span:
                yield None, *r[2:6], r[5] - span[0], r[5] + span[1]
        return
    for left, depth, members in maximal_repeats(lefts, rights, least, low, high):
        name = A.digest(lefts[members[0]][:left][::-1] + rights[members[0]][:depth])
        yield from ((name, *rows[i][2:6], rows[i][5] - left, rows[i][5] + depth) for i in members)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= 10_000:
            yield _batch(out, FOUND_NAMES, _FOUND_TYPES)
            out = []
    if out:
        yield _batch(out, FOUND_NAMES, _FOUND_TYPES)


def _walk(least: int, step: int, spans: bool):
    """Suffixes sorted by shard (h, low), one shard held at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = groupby(_rows(batches), key=itemgetter(0, 1))
        yield from _batches((*x, None, None, None, None) for _, rows in shards for x in _shard(list(rows), least, step, spans))

    return each


def _stream(least: int, spans: bool):
    """Suffixes sorted by shard and right context, which share all of a string of ``least`` bytes: the stack scan without holding any.

    All suffixes agree in the ``low`` bytes to the left, so one more byte tells whether they go on (left-extension diversity: a set of
    two is enough). A row for each suffix with its rank, and one for each maximal repeat with the ranks it spans; ``spans``: the
    string of each suffix that isn't alone.
    """

    def shard(rows: Iterator[tuple]) -> Iterator[tuple]:
        h, low, *key, p, left, right = first = next(rows)
        at = lambda r: (None, *r[2:6], r[5] - low, r[5] + least - low, None, None, None, None)
        if spans:
            for i, row in enumerate(rows):
                if not i:
                    yield at(first)
                yield at(row)
            return
        stack: list[list] = []  # depth, first rank and left bytes of the open intervals
        yield None, *key, p, 0, 0, h, low, 0, None
        rank, beside = 0, {left[low : low + 1] or -1}

        def close(depth: int, own: set, lo: int) -> Iterator[tuple]:
            nonlocal beside
            while stack and stack[-1][0] > depth:
                d, lo, lefts = stack.pop()
                own = set(list(lefts | own)[:2])
                if len(own) > 1:
                    yield A.digest(last[6][:low][::-1] + last[7][:d]), *key, 0, low, d, h, low, lo, rank
            beside, starts[0] = own, lo

        starts, last = [0], first
        for row in rows:
            depth = common_prefix(last[7], row[7])
            yield from close(depth, beside, rank)
            if stack and stack[-1][0] == depth:
                stack[-1][2] = set(list(stack[-1][2] | beside)[:2])
            else:
                stack.append([depth, starts[0], beside])
            rank, last = rank + 1, row
            beside = {row[6][low : low + 1] or -1 - rank}
            yield None, *row[2:6], 0, 0, h, low, rank, None
        yield from close(-1, beside, rank)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(x for _, rows in groupby(_rows(batches), key=itemgetter(0, 1)) for x in shard(rows))

    return each


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the spans [a, b) from each text's bytes."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        ids, found = batch.column(3), batch.column(5)
        for piece in B.slices(batch.column(4)):
            n_removed, spans, kept = [], [], []
            for i in range(piece.lo, piece.hi):
                text = piece.buf[piece.offsets[i - piece.lo] : piece.offsets[i - piece.lo + 1]].tobytes()
                gone = united((x["a"], x["b"]) for x in found[i].as_py() or ())
                n_removed.append(sum(e - s for s, e in gone))
                spans.append([{"start": s, "end": e} for s, e in gone])
                cuts = [0, *(x for run in gone for x in run), len(text)]
                kept.append(b"".join(text[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(piece.lo, piece.hi - piece.lo), pa.array(np.diff(piece.offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
            )


class Repeats:
    """The repeats of keyed documents: runs with the same surroundings, and what the interval trees find among the others."""

    def __init__(self, base: DataFrame, min_bytes: int, seed_bytes: int, shard: int):
        self.base, self.min_bytes, self.seed_bytes, self.shard = base, min_bytes, seed_bytes, shard
        self.ws, self.reach = Workspace(base.sparkSession), min_bytes - seed_bytes
        seeds = _seeds(min_bytes, seed_bytes)
        hot = A.hot_anchors(base, seeds)
        self.runs = self.ws.keep(A.settle(base.mapInArrow(seeds, A.ROWS), later=False, growth=1.5, hot=hot), "suffix_runs")
        release(base.sparkSession)

    def equal_runs(self) -> DataFrame:
        """Runs that another run equals: their class (r, s, the digest of their bytes), document and windows."""
        return self.runs.where(F.col("kind") == A.SETTLED).select("h", "r", "s", *KEY, "p", "a", (F.col("b") + self.min_bytes).alias("b"))

    def _walked(self, suffixes: DataFrame, step: int, spans: bool) -> DataFrame:
        ready = suffixes.repartition(partitions_for(self.base, 2), "h", "low")
        if step > 1:
            return ready.sortWithinPartitions("h", "low").mapInArrow(_walk(self.min_bytes, step, spans), FOUND).select(*FOUND_NAMES[:7])
        found = ready.sortWithinPartitions("h", "low", "right").mapInArrow(_stream(self.min_bytes, spans), FOUND)
        if spans:
            return found.select(*FOUND_NAMES[:7])
        found = self.ws.keep(found, "suffix_ranks")
        spans = found.where("last is not null").select("repeat", "h", "low", F.col("start").alias("left"), F.col("end").alias("right"), F.explode(F.sequence("rank", "last")).alias("rank"))
        members = found.where("last is null").select("h", "low", "rank", *KEY, "p")
        return spans.join(members, ["h", "low", "rank"]).select("repeat", *KEY, "p", (F.col("p") - F.col("left")).alias("start"), (F.col("p") + F.col("right")).alias("end"))

    def trees(self, *, spans: bool) -> DataFrame:
        """Rows of FOUND, of the first suffix of each class; ``spans``: what they cover, without names."""
        suffixes = lambda opened: self.base.join(A.by_document(opened, "h", "a", "b", "p"), KEY).mapInArrow(_suffixes(self.min_bytes), SUFFIXES)
        opened = self.runs.where(F.col("kind") == A.OPEN).select("h", *KEY, "a", "b", "p")
        crowded = self.ws.keep(opened.groupBy("h").count().where(F.col("count") > self.shard).select("h"), "suffix_crowded")
        step = 8 ** math.ceil(math.log(self.reach + 1, 8))  # all left lengths; an eighth at each further level
        found = self._walked(suffixes(opened.join(crowded, "h", "left_anti")), step, spans)
        if crowded.isEmpty():
            return found
        rows = suffixes(opened.join(crowded, "h", "left_semi"))
        while True:
            old, step = step, step // 8
            rows = self.ws.keep(rows.mapInArrow(_split(old, step, self.min_bytes, self.seed_bytes), SUFFIXES), f"suffix_split_{step}")
            if step == 1:
                return found.unionByName(self._walked(rows, step, spans))
            crowded = self.ws.keep(rows.groupBy("h", "low").count().where(F.col("count") > self.shard).select("h", "low"), f"suffix_crowded_{step}")
            found = found.unionByName(self._walked(rows.join(crowded, ["h", "low"], "left_anti").select(*rows.columns), step, spans))
            if crowded.isEmpty():
                return found
            rows = rows.join(crowded, ["h", "low"], "left_semi").select(*rows.columns)


def _little_endian(column: str) -> Column:
    """The eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(column), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def groups(docs: DataFrame, min_bytes: int = MIN_BYTES, seed_bytes: int = SEED_BYTES, shard: int = SHARD) -> DataFrame:
    """Maximal repeats with all their occurrences, a row each: repeat (hash of its bytes), length, n_occurrences, doc_id, start, end.

    A document listed twice is there once. Suffixes that were one leaf of a tree are each an occurrence of what the leaf is part of.
    """
    base = compact(keyed(docs))
    own = Repeats(base, min_bytes, seed_bytes, shard)
    places, leaf = [*KEY, "p"], ["h", "r", "s"]
    equal = own.equal_runs()
    found = own.ws.keep(own.trees(spans=False), "suffix_found")
    # A tree holds the first suffix of each class: the others of its class are occurrences of the same repeats.
    heads = own.runs.where(F.col("kind") == A.OPEN).select(*leaf, *places)
    members = heads.withColumnsRenamed({c: f"x{c}" for c in places}).join(equal.select(*leaf, *places), leaf)
    rest = found.withColumnsRenamed({c: f"x{c}" for c in places}).join(members, [f"x{c}" for c in places])
    rest = rest.select("repeat", *KEY, (F.col("start") - F.col("xp") + F.col("p")).alias("start"), (F.col("end") - F.col("xp") + F.col("p")).alias("end"))
    name = F.concat(_little_endian("r"), _little_endian("s"))
    leaves = equal.select(name.alias("repeat"), *KEY, F.col("a").alias("start"), F.col("b").alias("end"))
    rows = found.select("repeat", *KEY, "start", "end").unionByName(rest).unionByName(leaves).distinct()
    ids = base.select(*KEY, "doc_id").distinct()
    many = rows.groupBy("repeat").agg(F.count(F.lit(1)).alias("n_occurrences"))
    return rows.join(many, "repeat").join(ids, KEY).select("repeat", (F.col("end") - F.col("start")).alias("length"), "n_occurrences", "doc_id", "start", "end")


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, seed_bytes: int = SEED_BYTES, shard: int = SHARD) -> DataFrame:
    """Per document row: its bytes, the byte runs that occur elsewhere too, and what is left without them."""
    base = compact(keyed(docs))
    own = Repeats(base, min_bytes, seed_bytes, shard)
    spans = own.equal_runs().select(*KEY, "a", "b").unionByName(own.trees(spans=True).select(*KEY, F.col("start").alias("a"), F.col("end").alias("b")))
    return base.join(A.by_document(spans, "a", "b"), KEY, "left").mapInArrow(_apply, RESULT)
