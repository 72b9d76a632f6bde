"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Signatures. Each shingle of five words weighs its bytes (words joined by one space), so long words
count for more than short ones, and sends a Poisson process of its weight's rate:
arrivals at exponential gaps, each to a random register; a register keeps its earliest
arrival. A shingle stops as soon as its next arrival comes later than all registers'
(early termination). The share of equal registers estimates the probability Jaccard
similarity of two documents: the sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). A
weight is the shingle's own, the same in every text and however often a text repeats it, so this is the weight of the common
shingles over the weight of all, which is what links are verified by, exactly; equal sets have 1.

Classes. Exact copies are collapsed first (summed per task before the shuffle). Of the
remaining texts, those that agree in a band of registers meet in a bucket. No bucket is
expanded into pairs: in each round one member of a bucket is its star, and every text is
verified against one of its buckets' stars, their shingle sets compared exactly; verified
links (probability Jaccard of ``SIMILARITY`` or more) join components. After ``ROUNDS`` rounds only members of one
bucket that are still in different components are left. In small buckets their pairs are
verified; in large ones they meet in blocks of bounded size, the largest component's members
with the others only, where the shared shingles of every pair are counted on the spot and
only links that join components leave the task.

Defined results: a text without words has no shingle and is a class of its own; one of
fewer than five words is one shingle; equal texts are in one class; a class is named by
its least doc_id (null ids come first and name the class null); equal rows get equal
classes, of which ``keep_one`` keeps one row; an empty table gives no rows; other columns, whatever
their names, are ignored by ``classes`` and returned untouched by ``keep_one``. A very long text
is one row: its shingles are hashed in slices, and one text's set is held at a time beside a star's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import KEY, NULL_KEY, Workspace, document_key, keyed, numbered, partitions_for

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS_A_BAND = 42, 6
REGISTERS = BANDS * ROWS_A_BAND
ROUNDS = 3
#: Open buckets of more members are compared in blocks; those of fewer list their pairs. Both verify every pair exactly.
SMALL_BUCKET = 12
#: Shingles of other texts that are compared with one text at once.
STRETCH = 1 << 20
BLOCK_ROWS, BLOCK_BYTES = 2000, 4 << 20
#: Texts verified against one star in one task; a star with more is dealt over several.
STAR_ROWS = 2000
_U = np.uint64


def shingle_sets(piece: B.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each row (sorted 64-bit hashes) and their weights."""
    starts, ends, before = piece.words(B.not_space_table())
    words = B.span_hashes(piece.buf, starts, ends)
    grams = B.window_hashes(words, SHINGLE)
    # the bytes of a row of words: a sum of their lengths, and a space between each two
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=total[1:])
    for lo, hi in zip(before.tolist(), before[1:].tolist(), strict=False):
        n = min(SHINGLE, hi - lo)
        if not n:
            yield grams[:0], total[:0]
            continue
        own = B.window_hashes(words[lo:hi], n) if n < SHINGLE else grams[lo : hi - SHINGLE + 1]
        weights = total[lo + n : hi + 1] - total[lo : hi + 1 - n] - 1
        own, first = np.unique(own, return_index=True)
        yield own, weights[first]


def signatures(sets: list[np.ndarray], weights: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of m 16-bit fingerprints for each set; all sets are worked on together."""
    if not 0 < m <= 2048:
        raise ValueError("registers are told apart by 11 bits")
    n = len(sets)
    elem = np.concatenate(sets) if sets else np.zeros(0, _U)
    rate = np.concatenate(weights) if sets else np.zeros(0)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    least, who = np.full(n * m, np.inf), np.zeros(n * m, _U)
    live, clock, step = np.arange(len(elem)), np.zeros(len(elem)), 0
    while len(live):
        k = max(1, min(128, 40_000 // len(live)))  # arrivals at once: many when few elements are left
        at = B.mix(np.arange(step + 1, step + k + 1, dtype=_U) * B.BASE)
        bits = B.mix(elem[live][:, None] ^ at[None, :])
        gaps = -np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live][:, None]
        times = clock[live][:, None] + np.cumsum(gaps, axis=1)
        register = (((bits & _U(0x7FF)) * _U(m)) >> _U(11)).astype(np.int64) + doc[live][:, None] * m
        times_f, register_f = times.ravel(), register.ravel()
        earlier = np.flatnonzero(times_f < least[register_f])
        earlier = earlier[np.argsort(-times_f[earlier], kind="stable")]  # of several, the earliest is written last
        least[register_f[earlier]] = times_f[earlier]
        who[register_f[earlier]] = elem[live][earlier // k]
        clock[live] = times[:, -1]
        step += k
        last = least.reshape(n, m).max(axis=1)
        live = live[clock[live] < last[doc[live]]]
    return (B.mix(who) >> _U(48)).astype("<u2").reshape(n, m)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in B.slices(batch.column(4), 1 << 20):
            found = list(shingle_sets(piece))
            full = [i for i, (s, _) in enumerate(found) if len(s)]
            signed = signatures([found[i][0] for i in full], [found[i][1].astype(np.float64) for i in full])
            which = np.array(full, np.int64) + piece.lo
            columns = [batch.column(i).take(pa.array(which)) for i in range(4)]
            sizes = (piece.offsets[1:] - piece.offsets[:-1])[full]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in signed], pa.binary()), pa.array(sizes, pa.int64())], [*KEY, "h", "signature", "bytes"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, BANDS, ROWS_A_BAND)
        keys = np.zeros((n, BANDS), _U) + np.arange(1, BANDS + 1, dtype=_U)
        for i in range(ROWS_A_BAND):
            keys = B.mix(keys * B.STEP + signed[:, :, i].astype(_U))
        band = np.tile(np.arange(BANDS, dtype=np.int32), n)
        id_, size = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(band), pa.array(keys.ravel().view(np.int64)), pa.array(size)], ["id", "band", "bucket", "bytes"])


Weighted = tuple[np.ndarray, np.ndarray]


def similar(one: Weighted, two: Weighted) -> bool:
    """Whether two sorted sets' probability Jaccard similarity reaches the threshold."""
    (a, x), (b, y) = one, two
    own, other = int(x.sum()), int(y.sum())
    if min(own, other) < SIMILARITY * max(own, other) or not own:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(y[a[at] == b].sum())
    return both >= SIMILARITY * (own + other - both) - 1e-9


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by star, the star's own text first; streams the others against it."""
    star, own = None, (np.zeros(0, _U), np.zeros(0, np.int64))
    for batch in batches:
        stars, salts, ids = (batch.column(i).to_pylist() for i in range(3))
        pairs = []
        for piece in B.slices(batch.column(3)):
            for i, have in enumerate(shingle_sets(piece), piece.lo):
                if ids[i] == stars[i]:
                    star, own = (stars[i], salts[i]), have
                    continue
                assert star == (stars[i], salts[i]), "a star's text comes first"
                if similar(own, have):
                    pairs.append((stars[i], ids[i]))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose shingle sets are similar enough. ``texts``: id, text."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts"))
    salted = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("id"))
    stars = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"))
    rows = salted.unionByName(stars).join(texts, "id").select("a", "salt", "id", "text")
    ready = rows.repartition(partitions_for(texts), "a", "salt").sortWithinPartitions("a", "salt", (F.col("id") != F.col("a")).cast("int"), "id")
    return ready.mapInArrow(_verify, "a long, b long")


def join_components(ws: Workspace, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels (id, label) after the links (a, b) have joined their components; the least label wins."""
    step = 0
    while True:
        a, b = labels.withColumnsRenamed({"id": "a", "label": "x"}), labels.withColumnsRenamed({"id": "b", "label": "y"})
        edges = links.join(a, "a").join(b, "b").where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        # To each label its least neighbour if that is less; then along the chain, as far as three steps see.
        up = ws.keep(edges.groupBy("x").agg(F.min("y").alias("y")), f"{name}_up_{step}")
        if up.isEmpty():
            return labels
        for _ in range(2):
            far = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
            up = up.join(far, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        moved = labels.join(up, labels["label"] == up["x"], "left").select("id", F.coalesce("y", "label").alias("label"))
        labels, step = ws.keep(moved, f"{name}_labels_{step}"), step + 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that agree in their first four columns, which they are sorted by."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:4] != row[:4]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _candidates(rows: list[tuple], labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block pair's rows, each row and those of other components that share this band first. The caller may join ``labels`` meanwhile."""
    _, band, left, right = rows[0][:4]
    blocks, ids = (np.array([r[i] for r in rows], np.int64) for i in (4, 5))
    signed = np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(len(rows), REGISTERS)[:, : band * ROWS_A_BAND]
    first, second = np.flatnonzero(blocks == left), np.flatnonzero(blocks == right)
    for i in first.tolist():
        other = second[(labels[second] != labels[i]) & ((ids[second] > ids[i]) if left == right else True)]
        if len(other) and band:
            other = other[~(signed[other] == signed[i]).reshape(len(other), band, ROWS_A_BAND).all(axis=2).any(axis=1)]
        if len(other):
            yield i, other


def _labels(rows: list[tuple]) -> np.ndarray:
    return np.array([r[6] for r in rows], np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of the few open members of a small bucket."""
    for rows in _groups(batches):
        pairs = [tuple(sorted((rows[i][5], rows[j][5]))) for i, others in _candidates(rows, _labels(rows)) for j in others.tolist()]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the components of a large bucket's members: as many as it takes, never all pairs that are similar.

    Every pair of different components is decided by the exact weight of its shared shingles; only whole weights that rule a pair out skip it.
    """
    for rows in _groups(batches):
        sets = [(s, w.astype(np.int32)) for piece in B.slices(pa.array([r[8] for r in rows], pa.large_string())) for s, w in shingle_sets(piece)]
        sizes, whole = np.array([len(s) for s, _ in sets], np.int64), np.array([w.sum(dtype=np.int64) for _, w in sets], np.int64)
        known, first, codes = np.unique(np.concatenate([s for s, _ in sets]), return_index=True, return_inverse=True)
        weight = np.concatenate([w for _, w in sets])[first]  # a shingle weighs the same in every set
        own = np.split(codes.astype(np.int32), np.cumsum(sizes)[:-1])
        del sets, first, codes
        mark, labels, links = np.zeros(len(known), np.int32), _labels(rows), []
        for i, others in _candidates(rows, labels):
            near = others[np.minimum(whole[others], whole[i]) >= SIMILARITY * np.maximum(whole[others], whole[i])]
            mark[own[i]] = weight[own[i]]
            for lo, hi in _stretches(sizes[near]):
                part = near[lo:hi]
                both = np.add.reduceat(mark[np.concatenate([own[j] for j in part.tolist()])], np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                for j in part[both >= SIMILARITY * (whole[i] + whole[part] - both) - 1e-9].tolist():
                    if labels[i] != labels[j]:
                        labels[labels == max(labels[i], labels[j])] = min(labels[i], labels[j])
                        links.append((rows[i][5], rows[j][5]))
            mark[own[i]] = 0
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


def _stretches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Sets in order, in stretches of ``STRETCH`` shingles or one set each."""
    lo, ends = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRETCH, side="right")))
        yield lo, hi
        lo = hi


def _dealt(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of a pair of blocks together; ``like``: a written table about as large."""
    return rows.repartition(partitions_for(like), "bucket", "left", "right").sortWithinPartitions("bucket", "band", "left", "right", "id")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt over blocks of the bucket: a row for each pair of blocks that has to meet.

    A bucket's largest component needs no comparison within itself, so its members meet the others only:
    with n members, r of which are not in that component, r / ``BLOCK_ROWS`` times n / ``BLOCK_ROWS`` pairs of blocks, or as
    many as ``BLOCK_BYTES`` of text a block make.
    """
    seen = members.join(labels, "id")
    sizes = seen.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("n").alias("size"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    most, rest = blocks(F.col("most.n"), F.col("most.bytes")), blocks(F.col("size") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    open_ = open_.select("bucket", "size", F.col("most.label").alias("main"), most.alias("mains"), rest.alias("rests"))
    rows = seen.join(open_, "bucket")
    is_main, spread = F.col("label") == F.col("main"), F.xxhash64("id")
    block = F.when(is_main, F.col("rests") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "rests")).cast("int")
    last = F.when(is_main, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("bucket", "band", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id", "label", "size")


def components(ws: Workspace, texts_of: DataFrame, reps: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, label) of the representatives that share a bucket with another one. reps: id, k, t, u, signature, bytes; texts_of: k, t, u, text."""
    banded = reps.select("id", "signature", "bytes").mapInArrow(_bands, "id long, band int, bucket long, bytes long")
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = ws.keep(banded.join(sizes, "bucket"), "buckets")
    labels = ws.keep(members.select("id").distinct().withColumn("label", F.col("id")), "labels")
    wanted = labels.join(reps.select("id", *KEY), "id").select("id", *KEY)
    texts = ws.keep(texts_of.join(wanted, KEY).dropDuplicates(KEY).select("id", "text"), "texts")
    for i in range(rounds):
        # One pair for each text: of the stars of its buckets that are in another component, the one that comes first in this round's order.
        stars = members.groupBy("bucket").agg(F.min_by("id", F.xxhash64(F.lit(i), "id")).alias("star"))
        a, b = labels.withColumnsRenamed({"id": "star", "label": "x"}), labels.withColumnRenamed("label", "y")
        pairs = members.join(stars, "bucket").where("id <> star").select("id", "star").distinct().join(a, "star").join(b, "id").where("x <> y")
        pairs = pairs.groupBy("id").agg(F.min_by("star", F.xxhash64(F.lit(i), "star")).alias("a")).select("a", F.col("id").alias("b"))
        links = ws.keep(verified(pairs, texts), f"links_{i}")
        if links.isEmpty():
            break
        labels = join_components(ws, labels, links, f"round_{i}")
    # What is left: members of one bucket in several components.
    rows = _open_members(members, labels).join(reps.select("id", "signature"), "id")
    names = ["bucket", "band", "left", "right", "block", "id", "label", "signature"]
    few = _dealt(rows.where(F.col("size") <= SMALL_BUCKET).select(*names), members).mapInArrow(_pairs, "a long, b long").distinct()
    many = _dealt(rows.where(F.col("size") > SMALL_BUCKET).join(texts, "id").select(*names, "text"), texts).mapInArrow(_links, "a long, b long")
    return join_components(ws, labels, ws.keep(verified(few, texts).unionByName(many), "links_last"), "last")


def _classed(docs: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(k, t, u, doc_id, text, h) of each row; and of each text with shingles its hash h and its class's least document (ck, ct, cu)."""
    ws, base = Workspace(docs.sparkSession), keyed(docs)
    hashed = base.withColumn("h", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    signed = hashed.select(*KEY, "h", "text").mapInArrow(_signed, "k long, t long, u long, h binary, signature binary, bytes long")
    firsts = signed.groupBy("h").agg(F.min("k").alias("k"), F.first("t").alias("t"), F.first("u").alias("u"), F.first("signature").alias("signature"), F.first("bytes").alias("bytes"))
    reps = ws.keep(firsts.withColumn("id", F.monotonically_increasing_id()), "reps")
    labels = components(ws, base.select(*KEY, "text"), reps, rounds)
    named = reps.select("id", "h", *KEY).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = named.groupBy("label").agg(F.min(F.struct(*KEY)).alias("c"))
    return hashed, ws.keep(named.join(least, "label").select("h", *[F.col(f"c.{c}").alias(f"c{c}") for c in KEY]), "classes")


def classes(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class), one row per row of ``docs``."""
    hashed, named = _classed(docs, rounds)
    rows = hashed.select("doc_id", "k", "h").join(named, "h", "left")
    least = F.coalesce("ck", "k")
    return rows.select("doc_id", F.when(least != NULL_KEY, least).alias("class_id"))


def keep_one(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with their own columns, of each class the row with the least doc_id; rows without shingles stay."""
    hashed, named = _classed(docs, rounds)
    firsts = named.select(*[F.col(f"c{c}").alias(c) for c in KEY]).distinct()
    own, names = numbered(docs)
    rows, text = own.select("*", *document_key(names["doc_id"], names["text"])), F.col(names["text"])
    blank = text.isNull() | (F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "")
    kept = rows.where(~blank).join(firsts, KEY, "left_semi").dropDuplicates(KEY)
    return kept.unionByName(rows.where(blank)).drop(*KEY).toDF(*docs.columns)
