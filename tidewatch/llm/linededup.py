"""Line dedup over line hashes, in DataFrame expressions only.

Lines that are long enough leave their document as (hash, document, position). The
hashes are range-partitioned with a salt taken from the document, and each partition
is sorted by hash, salt, document (largest first) and position; a running window then
streams the first occurrence for each hash and salt and counts its documents. A key
held by a third of all documents is so spread over as many ranges as there are partitions; the few rows that
are left for it are summed by hash. What a document gets back is a sparse bitmap: 64
lines a word, only words that drop a line are kept.

Defined results: a null or empty text is one empty line; rows that share an id are
one document for the count of documents and for the last holder (each such row keeps
its lines if it holds the largest id); a null id sorts before all ids; equal rows get
equal bitmaps; an empty table gives no rows; other columns, whatever their names, are ignored by ``bitmaps``
and returned untouched by ``dedup_documents``. A very long text is one row; its lines are rows of
their own, and what comes back to it is a word of bitmap for each 64 lines that lose one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import KEY, WS, Workspace, document_key, numbered, partitions_for, text_or_empty

MIN_CHARS = 40
MIN_DOCS = 5
SALTS = 32


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS)), string.ascii_uppercase, string.ascii_lowercase)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Two hashes of each long line's key (128 bits: none of a large corpus' lines meet by chance), and its place."""
    lines = docs.select(*document_key(), F.posexplode(F.split(text_or_empty("text"), "\n")).alias("pos", "line"))
    lines = lines.select(*KEY, "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return lines.select(*KEY, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def frequent_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys of at least ``min_docs`` documents and the largest document that holds each."""
    n = partitions_for(lines)
    salted = lines.select("h1", "h2", F.pmod(F.xxhash64("k"), F.lit(max(SALTS, n))).alias("salt"), "k", "pos")
    ranged = salted.repartitionByRange(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("k"), "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("k"))
    before = F.lag("k").over(stream)
    firsts = ranged.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("k")))
    per_key = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("k").alias("last"))
    return per_key.where(F.col("n_docs") >= min_docs).drop("n_docs")


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k, t, u, n_dropped, dropped): for each document that loses lines, a sparse bitmap of the lines it loses.

    ``dropped`` maps a word's number to its 64 bits; lines of other words are kept.
    """
    # Hashes and places only, written once: range sampling, the stream and the join read them, and no text is split twice.
    ws = Workspace(docs.sparkSession)
    lines = ws.keep(long_lines(docs, min_chars), "lines")
    doomed = lines.join(ws.keep(frequent_keys(lines, min_docs), "line_keys"), ["h1", "h2"]).where(F.col("k") != F.col("last"))
    words = doomed.groupBy(*KEY, F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))).alias("bits"))
    return words.groupBy(*KEY).agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """``text`` without the lines whose bit is set."""
    gone = lambda i: F.coalesce(F.element_at(dropped, F.shiftright(i, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63))) != 0, F.lit(False))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~gone(i)), "\n"))


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., n_dropped and dropped (null: all lines are kept)."""
    plain = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    own, names = numbered(docs)
    keyed = own.select("*", *document_key(names["doc_id"], names["text"]))
    return keyed.join(bitmaps(plain, min_chars, min_docs), KEY, "left").drop(*KEY)


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with their own columns, ``text`` without the dropped lines; a document that loses none keeps its text as it is."""
    out, where = with_bitmaps(docs, min_chars, min_docs), f"c{docs.columns.index('text')}"
    text = F.when(F.col("dropped").isNull(), F.col(where)).otherwise(kept_text(text_or_empty(where), F.col("dropped")))
    return out.withColumn(where, text).drop("n_dropped", "dropped").toDF(*docs.columns)
