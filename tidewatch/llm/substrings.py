"""Substring dedup by seed and extend, over words.

Seeds: winnowed anchors of ``SEED_WORDS`` words; every repeat of ``MIN_WORDS`` words or
more holds one. Anchors meet by a shuffle on their hash. Runs whose bytes have the same
128-bit digest are a class and are settled at once; the first run of each class goes on, with
its words.

Extension: an anchor's runs are streamed in order, and each is laid beside the first (least document, then least
position) and compared with it word by word, to both sides of the seed as far as they agree; stretches of
``MIN_WORDS`` words or more are repeats. So a hot anchor costs as many comparisons as it has runs, not their
square, and these are dealt over tasks, ``RUNS`` each. Windows of a run that differ from the first run's may still repeat a third one. They are the
seeds of a second round, each by the digest of its own words. A window that equals the first run's
is settled there, and no other is, so no pair among the rest is missed.

Overlapping repeats are united, so what is removed are maximal repeats. A hash of an anchor that two
different passages share removes nothing: words, or digests of all words, decide.

Defined results: a null or empty text has no words; rows equal in doc_id and text are
one document (each gets the same result); rows that share only the id are ordered by
128 bits of their text's hashes; a null doc_id comes before all others; an empty table gives no
rows; other columns, whatever their names, are ignored. A very long text is one row: it is hashed in slices
and extended run by run.
"""

from __future__ import annotations

import operator
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import bytetext as B
from .common import KEY, Workspace, compact, keyed, partitions_for, release

MIN_WORDS = 20
SEED_WORDS = 6
CONTEXTS = "h long, part int, k long, t long, u long, a int, p int, words binary"
#: Runs of one anchor that one task lays beside the first; an anchor with more is dealt over several tasks, each with the first run.
RUNS = 500
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def _seeds(min_words: int, seed_words: int):
    w = min_words - seed_words + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys = [], [batch.column(i).to_numpy() for i in range(3)]
            for piece in B.slices(batch.column(4)):
                starts, ends, before = piece.words(B.not_space_table())
                words = B.span_hashes(piece.buf, starts, ends)
                row = np.repeat(np.arange(len(before) - 1), np.diff(before))
                n = len(words) - min_words + 1
                if n <= 0:
                    continue
                grams = B.window_hashes(words, seed_words)
                a, b, p = A.runs(grams, row[:n] == row[min_words - 1 :], row, w)
                r, s = A.digests(piece.buf, starts[a], ends[b + min_words - 1])
                doc, lo = row[a], before[row[a]]
                one = np.ones(len(a), np.int32)
                found.append(dict(zip(A.NAMES, (one * A.SEED, grams[p].view(np.int64), r, s, *(x[piece.lo + doc] for x in keys), a - lo, b - lo, p - lo, one), strict=True)))
            if found:
                yield A.to_batch(A.put_together(A.join(found), later=True))

    return each


def _contexts(min_words: int):
    """The words that each open run's windows hold, one space between them: a row for each task that reads them."""
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int32(), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece in B.slices(batch.column(4)):
                for i in range(piece.lo, piece.hi):
                    words = piece.buf[piece.offsets[i - piece.lo] : piece.offsets[i - piece.lo + 1]].tobytes().split()
                    key = [batch.column(c)[i].as_py() for c in range(3)]
                    rows += [(x["h"], part, *key, x["a"], x["p"], b" ".join(words[x["a"] : x["b"] + min_words])) for x in batch.column(5)[i].as_py() for part in x["parts"]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["h", "part", *KEY, "a", "p", "words"])
                    rows = []

    return each


def extended(own: list[bytes], other: list[bytes], shift: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in ``own``, of all stretches of ``least`` words or more that agree with ``other`` where own[i + shift] lies on other[i]."""
    lo, hi = max(0, shift), min(len(own), len(other) + shift)
    agree = np.zeros(max(0, hi - lo) + 2, np.int8)
    agree[1:-1] = np.fromiter(map(operator.eq, own[lo:hi], other[lo - shift : hi - shift]), np.int8, max(0, hi - lo))
    edge = np.diff(agree)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = e - s >= least
    return s[long] + lo, e[long] + lo


def _extend(min_words: int):
    """Contexts sorted by h, part and document, each beside the first of its h: spans that agree, and the windows that don't as seeds of their own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, seed = None, [], 0
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            rows: list[tuple] = []
            for h, part, k, t, u, a, p, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = text.split(b" ")
                if (h, part) != at:
                    at, first, seed = (h, part), own, p - a
                    continue
                starts, ends = (x.tolist() for x in extended(own, first, p - a - seed, min_words))
                rows += [(A.SETTLED, 0, 0, 0, k, t, u, a + s, a + e - min_words, p, 1) for s, e in zip(starts, ends, strict=True)]
                for s, e in zip([0, *(x - min_words + 1 for x in ends)], [*starts, len(own) - min_words + 1], strict=True):
                    for i in range(s, e):
                        one, two = struct.unpack("<qq", A.digest(b" ".join(own[i : i + min_words])))
                        rows.append((A.SEED, one, two, 0, k, t, u, a + i, a + i, a + i, 1))
            if rows:
                yield A.to_batch(A.put_together({c: np.array(x) for c, x in zip(A.NAMES, zip(*rows, strict=True), strict=True)}, later=True))

    return each


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the spans [a, b) from each text's words."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
        ids, found = batch.column(3), batch.column(5)
        for piece in B.slices(batch.column(4)):
            n_words, n_removed, spans, texts = [], [], [], []
            for i in range(piece.lo, piece.hi):
                words = piece.buf[piece.offsets[i - piece.lo] : piece.offsets[i - piece.lo + 1]].tobytes().split()
                gone = united((x["a"], x["b"]) for x in found[i].as_py() or ())
                cuts = [0, *(x for span in gone for x in span), len(words)]
                kept = [w for s, e in zip(cuts[::2], cuts[1::2], strict=True) for w in words[s:e]]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                spans.append([{"start": s, "end": e} for s, e in gone])
                texts.append(b" ".join(kept).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(piece.lo, piece.hi - piece.lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
            )


def united(spans) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, runs: int = RUNS) -> DataFrame:
    """Per document row: its words, the maximal repeats removed from it (word positions) and the kept text, words joined by a space."""
    base, ws = compact(keyed(docs)), Workspace(docs.sparkSession)
    seeds = _seeds(min_words, seed_words)
    hot = A.hot_anchors(base, seeds)
    first = ws.keep(A.settle(base.mapInArrow(seeds, A.ROWS), later=True, growth=3, hot=hot), "substring_seeds")
    release(docs.sparkSession)
    opened = A.by_document(A.dealt(first.where(F.col("kind") == A.OPEN), hot, runs), "a", "b", "p", "h", "parts")
    contexts = base.join(opened, KEY).mapInArrow(_contexts(min_words), CONTEXTS)
    ready = contexts.repartition(partitions_for(base), "h", "part").sortWithinPartitions("h", "part", *KEY, "p")
    second = ws.keep(A.settle(ready.mapInArrow(_extend(min_words), A.ROWS), later=True, growth=1, like=base), "substring_windows")
    release(docs.sparkSession)
    repeats = first.unionByName(second).where(F.col("kind") == A.SETTLED).select(*KEY, "a", (F.col("b") + min_words).alias("b"))
    return base.join(A.by_document(repeats, "a", "b"), KEY, "left").mapInArrow(_apply, RESULT)
