"""Benchmark decontamination: a broadcast set of benchmark n-grams, a scan of training windows.

The benchmark's normalised windows are hashed and sent to every task; a task hashes
the windows of its documents, looks them up, and compares each hit word for word
with the benchmark's own words before it counts. The benchmark is small by nature,
but that is checked: one of more than ``block_bytes`` is dealt into blocks of items, a long item in stretches of
``STRETCH`` windows, so that no block is larger for a long item. Each block is built, broadcast, scanned for and
destroyed in turn, and the hits of the blocks are then united.

Defined results: a null or empty text has no words and no hits; an item without words
has no window; items that share an id are one item, and a null item id counts as the
id ``null``; equal document rows each give their own row; an empty table of documents
gives no rows, an empty benchmark no hits; other columns, whatever their names, are ignored by
``scan`` and returned untouched by ``remove``. A very long text is one row: its words are
hashed in slices, and its hits are runs, not words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import KEY, Workspace, keyed, numbered, text_or_empty
from .substrings import united

NGRAM = 10
BLOCK_BYTES = 4 << 20
HITS = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_FILTER_BITS = 20
#: Windows of a stretch: neighbouring stretches of an item share all but one word of a window.
STRETCH = 10_000
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Windows:
    """The windows of a block of items: sorted hashes by window length, their words and items."""

    def __init__(self, items: list[tuple[str, str]], ngram: int):
        owners: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        table = B.letter_digit_table()
        for item, text in items:
            for piece in B.slices(pa.array([text.encode().translate(B.LOWER).decode()], pa.large_string())):
                starts, ends, _ = piece.words(table)
                words = [piece.buf[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                k = min(ngram, len(words))
                for i in range(len(words) - k + 1) if k else ():
                    owners[k][b" ".join(words[i : i + k])].add(item)
        self.by_length = {}
        for k, windows in owners.items():
            texts = list(windows)
            hashes = np.array([self._hash(t, k) for t in texts], np.uint64)
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[k] = (hashes[order], [texts[i] for i in order], [sorted(windows[texts[i]]) for i in order], seen)

    @staticmethod
    def _hash(window: bytes, k: int) -> int:
        buf = np.frombuffer(window, np.uint8)
        gaps = np.flatnonzero(buf == 0x20)
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(buf)]
        return int(B.window_hashes(B.span_hashes(buf, starts, ends), k)[0])

    def find(self, text: B.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Word starts, ends and counts before each row, the mask of hit words, and the items of each row."""
        low = np.frombuffer(text.buf.tobytes().translate(B.LOWER), np.uint8)
        starts, ends, before = B.Slice(text.lo, text.hi, low, text.offsets).words(B.letter_digit_table())
        hashes = B.span_hashes(low, starts, ends)
        row = np.repeat(np.arange(len(before) - 1), np.diff(before))
        mask, items = np.zeros(len(starts), bool), defaultdict(set)
        for k, (known, texts, owners, seen) in self.by_length.items():
            h = B.window_hashes(hashes, k)
            if not len(h):
                continue
            maybe = np.flatnonzero(seen[h >> np.uint64(64 - _FILTER_BITS)] & (row[: len(h)] == row[k - 1 :]))
            at = np.searchsorted(known, h[maybe])
            at[at == len(known)] = 0
            same = known[at] == h[maybe]
            found = []
            for i, j in zip(maybe[same].tolist(), at[same].tolist(), strict=True):
                words = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + k], ends[i : i + k], strict=True))
                while j < len(known) and known[j] == h[i]:  # verify: equal hashes aren't proof
                    if texts[j] == words:
                        found.append(i)
                        items[int(row[i])].update(owners[j])
                    j += 1
            mask |= B.covered(np.array(found, np.int64), k, len(starts))
        return starts, ends, before, mask, items


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _stretches(ngram: int, windows: int):
    """Items in stretches of so many windows; one of fewer stays as it is."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            for piece in B.slices(batch.column(1)):
                low = np.frombuffer(piece.buf.tobytes().translate(B.LOWER), np.uint8)
                starts, ends, before = B.Slice(piece.lo, piece.hi, low, piece.offsets).words(B.letter_digit_table())
                rows = []
                for r in range(len(before) - 1):
                    lo, hi = int(before[r]), int(before[r + 1])
                    for i in range(lo, max(lo + 1, hi - ngram + 1) if hi > lo else lo, windows):
                        last = min(i + windows + ngram - 1, hi) - 1
                        rows.append((items[piece.lo + r], low[starts[i] : ends[last]].tobytes().decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["item", "text"])

    return each


def _blocks(benchmark: DataFrame, ngram: int, block_bytes: int) -> tuple[int, Iterator[Windows]]:
    """How many blocks there are, and the windows of each, built one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_or_empty("text").alias("text")).where("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    if n > 1:
        items = items.mapInArrow(_stretches(ngram, STRETCH), "item string, text string")

    def each() -> Iterator[Windows]:
        for i in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
            yield Windows([(r.item, r.text) for r in part.toLocalIterator()], ngram)

    return n, each()


def _scan(shared: Broadcast, only_hits: bool):
    """Key, id, words, hits and items of each document; ``only_hits``: of those that have any."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.slices(batch.column(4)):
                _, _, before, mask, items = shared.value.find(piece)
                hits, found = [], []
                for r in range(len(before) - 1):
                    lo, hi = before[r], before[r + 1]
                    s, e = _runs(mask[lo:hi]) if mask[lo:hi].any() else ((), ())
                    hits.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
                    found.append(sorted(items.get(r, ())))
                head = [batch.column(i).slice(piece.lo, piece.hi - piece.lo) for i in range(4)]
                rest = [pa.array(np.diff(before), pa.int64()), pa.array(hits, _SPANS), pa.array(found, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([*head, *rest], [*KEY, "doc_id", "n_words", "hits", "items"])
                yield out.filter(pa.array([bool(h) for h in hits])) if only_hits else out

    return each


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words counted, and the blocks' hits of each document united."""
    table = B.letter_digit_table()
    for batch in batches:
        for piece in B.slices(batch.column(4)):
            low = np.frombuffer(piece.buf.tobytes().translate(B.LOWER), np.uint8)
            _, _, before = B.Slice(piece.lo, piece.hi, low, piece.offsets).words(table)
            own = batch.slice(piece.lo, piece.hi - piece.lo)
            hits = [[{"start": s, "end": e} for s, e in united((x["start"], x["end"]) for x in found or ())] for found in own.column(5).to_pylist()]
            items = [sorted(set(x or ())) for x in own.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(3), pa.array(np.diff(before), pa.int64()), pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])


def scan(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: its words, the runs of hit words [start, end), and the items with occurring windows."""
    spark, rows = docs.sparkSession, keyed(docs)
    n, blocks = _blocks(benchmark, ngram, block_bytes)
    scanned = f"k long, t long, u long, {HITS}"
    if n == 1:
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(next(blocks)), False), scanned).drop(*KEY)
    # Several blocks: one is broadcast at a time, and only documents with hits are written for each.
    ws, parts = Workspace(spark), []
    for i, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        parts.append(ws.keep(rows.mapInArrow(_scan(shared, True), scanned), f"hits_{i}"))
        shared.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return rows.join(merged, KEY, "left").mapInArrow(_united, HITS)


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with their own columns, without contaminated documents or (mode ``spans``) without hit spans.

    A span goes from the first byte of its first word to the last byte of its last word.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    where, names = docs.columns.index("text"), docs.columns
    docs, _ = numbered(docs)  # names with dots in them can't go to the workers
    n, blocks = _blocks(benchmark, ngram, block_bytes)
    ws = Workspace(docs.sparkSession) if n > 1 else None
    for i, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, kept, texts = batch.column(where), [], []
                for piece in B.slices(column):
                    starts, ends, before, mask, _ = shared.value.find(piece)
                    for r in range(len(before) - 1):
                        lo, hi = before[r], before[r + 1]
                        hit = bool(mask[lo:hi].any())
                        kept.append(not hit)
                        if not hit:
                            texts.append(column[piece.lo + r].as_py() if mode == "spans" else None)
                        elif mode == "spans":
                            s, e = _runs(mask[lo:hi])
                            cuts = [piece.offsets[r], *np.c_[starts[lo + s], ends[lo + e - 1]].ravel().tolist(), piece.offsets[r + 1]]
                            texts.append(b"".join(piece.buf[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode(errors="replace"))
                if mode == "documents":
                    yield batch.filter(pa.array(kept, pa.bool_()))
                else:
                    columns = list(batch.columns)
                    columns[where] = pa.array(texts, column.type)
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        docs = docs.mapInArrow(each, docs.schema)
        if ws:
            docs = ws.keep(docs, f"clean_{i}")
            shared.destroy()
    return docs.toDF(*names)
