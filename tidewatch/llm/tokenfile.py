"""Token-id files in bit planes: encode, write shards in document order, read them back.

Format of a shard (little-endian): magic and block size; blocks; index; footer. A block
holds ``BLOCK`` ids (the last one fewer), transposed into 32 bit planes, each compressed
with zstandard by itself; planes without a set bit take no bytes. The chunk index gives
each block's place, ids, checksum and plane lengths; the document index gives each
document's id and number of ids. Both are read from the end, so any block is one seek away.

Documents are range-partitioned by id, each task encodes and writes its range as shards of
at most ``SHARD_IDS`` ids, and Spark's commit of the manifest decides which attempts' files
count. The ids before a shard are a running sum over the manifest, a row per shard.

Texts are cut at ASCII white space, which vocabularies that drop white space never join,
and before a full stop or comma that ends a word; a worker sends each different piece to the tokenizers library once while its bounded table
lasts, and documents are put together from the pieces' ids.

Defined results: a null or empty text has the end id only; a null doc_id comes before all
others and is read back as null; rows with equal ids are ordered by their text's hash;
an empty table gives no shards and no rows; other columns, whatever their names, are ignored. A very long text
is encoded whole, and its ids cross as many blocks as they need.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as B
from .common import KEY, keyed, materialise, partitions_for, scratch_dir

MAGIC, VERSION_END = b"BITPLN01", b"BITPLNIX"
BLOCK = 1 << 16
SHARD_IDS = 1 << 26
END_ID = 1
LEVEL = 3
#: Different pieces of text that a worker remembers the ids of; beyond that it starts anew.
PIECES = 1_000_000
ENCODE_BYTES = 4 << 20
_BLOCK = struct.Struct("<QII32I")
_FOOT = struct.Struct("<QQQQ8s")
MANIFEST = "k long, t long, u long, shard string, n_docs long, n_ids long, bytes long"


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of a block, lowest first; empty where no id has the bit."""
    own = np.ascontiguousarray(ids, "<u4")
    used = (int(own.max(initial=0)).bit_length() + 7) // 8  # bytes that any id needs
    planes = []
    for k in range(used):
        byte = np.ascontiguousarray(own.view(np.uint8)[k::4])
        bits = (byte & np.uint8(1 << i) for i in range(8))
        planes += [np.packbits(b, bitorder="little").tobytes() if b.any() else b"" for b in bits]
    return planes + [b""] * (32 - len(planes))


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k in range(4):
        byte = np.zeros(n, np.uint8)
        for i, p in enumerate(planes[8 * k : 8 * k + 8]):
            if p:
                byte |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << np.uint8(i)
        out[:, k] = byte
    return out.view("<u4").ravel()


class ShardWriter:
    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block, self.at = stream, block, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.index: list[bytes] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._put(MAGIC + struct.pack("<Q", block))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, known, counts))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            rest = np.concatenate(self.held)
            full = len(rest) // self.block * self.block
            for lo in range(0, full, self.block):
                self._block(rest[lo : lo + self.block])
            self.held, self.n_held = [rest[full:]], len(rest) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p) if p else b"" for p in to_planes(ids)]
        self.index.append(_BLOCK.pack(self.at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), *map(len, packed)))
        self._put(b"".join(packed))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        at, n_docs = self.at, sum(len(d[0]) for d in self.docs)
        self._put(b"".join(self.index))
        for i, kind in enumerate(("<i8", "u1", "<u8")):
            packed = self.packer.compress(b"".join(d[i].astype(kind).tobytes() for d in self.docs))
            self._put(struct.pack("<Q", len(packed)) + packed)
        self._put(_FOOT.pack(at, len(self.index), n_docs, self.n_ids, VERSION_END))
        self.stream.close()


class ShardReader:
    """Opens a shard by its footer. ``file`` can seek."""

    def __init__(self, file, size: int):
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        file.seek(size - _FOOT.size)
        at, n_blocks, n_docs, self.n_ids, end = _FOOT.unpack(file.read(_FOOT.size))
        file.seek(0)
        head = file.read(16)
        if end != VERSION_END or head[:8] != MAGIC:
            raise ValueError("no bit-plane shard")
        self.block = struct.unpack("<Q", head[8:])[0]
        file.seek(at)
        data = file.read(n_blocks * _BLOCK.size)
        self.index = [_BLOCK.unpack_from(data, i * _BLOCK.size) for i in range(n_blocks)]
        columns = []
        for kind in ("<i8", "u1", "<u8"):
            packed = file.read(struct.unpack("<Q", file.read(8))[0])
            columns.append(np.frombuffer(self.unpacker.decompress(packed), kind))
        self.doc_ids, self.known, self.counts = columns
        if len(self.counts) != n_docs or int(self.counts.sum()) != self.n_ids or sum(b[1] for b in self.index) != self.n_ids:
            raise ValueError("the shard's indexes don't agree")

    def read_block(self, i: int) -> np.ndarray:
        at, n, crc, *lengths = self.index[i]
        self.file.seek(at)
        data, planes, lo = self.file.read(sum(lengths)), [], 0
        for length in lengths:
            planes.append(self.unpacker.decompress(data[lo : lo + length]) if length else b"")
            lo += length
        ids = from_planes(planes, n)
        if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
            raise ValueError(f"block {i}: the checksum differs")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first position in the shard and ids of each document; holds a block and a document."""
        held, i, start = np.zeros(0, np.uint32), 0, 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.counts.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.read_block(i))
                have += len(parts[-1])
                i += 1
            whole = np.concatenate(parts) if len(parts) > 1 else held
            yield (doc_id if known else None), start, whole[:n]
            held, start = whole[n:], start + n


#: A full stop or comma that ends a word before white space: the splitter of word vocabularies parts it from the letter in any case.
_STOP = re.compile(rb"([a-z0-9])([.,])(?=[ \t\n\v\f\r])")
#: A capital that a combining mark may follow: NFC comes before lower case and composes some marks with the small letter only.
_MARKED = re.compile(rb"[A-Z](?=[\x80-\xff])")


def pieces_of(text: bytes) -> list[bytes]:
    """Pieces whose ids in order are the text's. Capitals A-Z before ASCII are lowered here already, unless an added token might then be spelt."""
    if b"<|" in text:
        return text.split()
    low = text.lower()
    # The marks that compose with A-Z (U+0300 to U+0344) begin with one of these two bytes; other marks may stand between.
    if (b"\xcc" in text or b"\xcd" in text) and (kept := [m.start() for m in _MARKED.finditer(text)]):
        own = bytearray(low)
        for i in kept:
            own[i] = text[i]
        low = bytes(own)
    return _STOP.sub(rb"\1 \2", low).split()


class PieceEncoder:
    """Ids of texts by their pieces, for lower-case vocabularies that drop white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        # Letters alone are one word, so their ids can be told apart in one long text; if that doesn't add up, each piece is encoded as a text.
        plain = np.array([t.isalpha() for t in texts], bool)
        counts, parts = np.zeros(len(texts), np.int64), []
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        letters = [t for t, p in zip(texts, plain.tolist(), strict=True) if p]
        if letters:
            ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids])
            if len(ends) == len(letters):
                counts[plain] = np.diff(ends, prepend=-1)
                parts.append(ids)
            else:
                order, letters = np.arange(len(texts)), []
        if rest := texts if not letters else [t for t, p in zip(texts, plain.tolist(), strict=True) if not p]:
            e = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            counts[order[len(letters) :]] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(rest))
            parts.append(np.array(e.ids, np.uint32))
        ids = np.concatenate(parts)
        pieces, counts = [pieces[i] for i in order.tolist()], counts[order]
        n = len(self.place)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(pieces) > len(self.begins):
            self.begins, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.counts))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.begins[n : n + len(pieces)] = self.n_ids + np.cumsum(counts) - counts
        self.counts[n : n + len(pieces)] = counts
        self.n_ids += len(ids)
        self.place.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and how many each text has."""
        split = [pieces_of(t) for t in texts]
        n_pieces = np.array([len(x) for x in split], np.int64)
        every = [p for x in split for p in x]
        at = self._places(every)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [every[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            if len(self.place) + len(new) > PIECES and self.place:
                self._clear()
                self._learn(list(dict.fromkeys(every)))
                at = self._places(every)
            else:
                self._learn(new)
                at[missing] = self._places(unknown)
        n = self.counts[at]
        before = np.zeros(len(every) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(n_pieces, out=bounds[1:])
        counts = before[bounds[1:]] - before[bounds[:-1]] + 1
        ids = self.ids[np.repeat(self.begins[at] - before[:-1], n) + np.arange(before[-1])]
        return np.insert(ids, before[bounds[1:]], np.uint32(end_id)), counts


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _write(folder: str, path: str | None, end_id: int, shard_ids: int, block: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        own = _encoder(path or _vocabulary())
        writer, row, done = None, None, []

        def finish() -> None:
            writer.close()
            done.append((*row, sum(len(d[0]) for d in writer.docs), writer.n_ids, writer.at))

        for batch in batches:
            ks, ts, us = (batch.column(i).to_numpy() for i in range(3))
            known = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            for piece in B.slices(batch.column(4), ENCODE_BYTES):
                if writer is None:
                    name = f"tokens-{uuid.uuid4().hex}.bpl"
                    writer, row = ShardWriter(fs.open_output_stream(f"{base}/{name}"), block), (int(ks[piece.lo]), int(ts[piece.lo]), int(us[piece.lo]), name)
                texts = [piece.buf[a:b].tobytes() for a, b in zip(piece.offsets, piece.offsets[1:], strict=False)]
                ids, counts = own.encode(texts, end_id)
                writer.add(ks[piece.lo : piece.hi], known[piece.lo : piece.hi], counts, ids)
                if writer.n_ids >= shard_ids:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], [*KEY, "shard", "n_docs", "n_ids", "bytes"])

    return each


def write_shards(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, block: int = BLOCK) -> tuple[str, DataFrame]:
    """Write the ids of ``docs`` in ascending doc_id order; returns the folder and the manifest of its shards."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/tokens"
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = keyed(docs)
    ranged = rows.repartitionByRange(partitions_for(rows), *KEY).sortWithinPartitions(*KEY)
    return folder, materialise(ranged.mapInArrow(_write(folder, path, end_id, shard_ids, block), MANIFEST), "token_manifest")


def _read(folder: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for shard, size, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "bytes", "first")), strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{shard}") as file:
                    for doc_id, start, ids in ShardReader(file, size).documents():
                        rows.append((doc_id, first + start, len(ids), ids.astype("<u4").tobytes()))
                        held += ids.nbytes
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return each


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    before = F.sum("n_ids").over(Window.orderBy(*KEY, "shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("first", F.coalesce(before, F.lit(0).cast("long"))).select("shard", "bytes", "first")
    return placed.repartition(partitions_for(placed), "shard").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids binary")
