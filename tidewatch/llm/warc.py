"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing: each task writes archives of at most ``ROLL_BYTES`` into the shared folder
under names of its own; Spark's own commit of the manifest decides which
attempts count, so archives of lost or repeated attempts are never read. Reading: one
task per archive streams it, takes the dictionary from the skippable frame, decodes frame
after frame, and checks each record's version, headers, lengths and digests.

Pages with equal payloads (SHA-256) of at least ``MIN_REVISIT`` bytes are one response,
the page with the largest id, and revisits; groups are summed per task before they are
shuffled, and their join splits hot groups (AQE).

Defined results: a null html is an empty payload; a null url leaves out the target URI,
and line ends in a url are percent-encoded; null page ids are read back as null and
revisit the group's largest id (a group without any id has responses only); rows that
share the largest id are all responses; an empty table gives no archives and no rows;
other columns, whatever their names, are ignored. A very long page is one record and one frame,
which a task holds once; archives roll after it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions_for, scratch_dir

MIN_REVISIT = 1000
ROLL_BYTES = 64 << 20
#: The dictionary is trained on so many pages of at most so many bytes each, whichever come first; it changes sizes, never contents.
SAMPLE_PAGES, SAMPLE_BYTES = 256, 1 << 18
DICT_BYTES = 64 << 10
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
MANIFEST = "archive string, records long, bytes long"
RECORDS = "archive string, offset long, page_id long, record_type string, refers_to long, target_uri string, payload_digest string, payload_bytes long"


class WarcError(ValueError):
    """An archive that doesn't hold what the format asks for."""


def train_dictionary(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, size: int = DICT_BYTES) -> bytes:
    """A dictionary from a bounded sample; empty where there is too little to train on."""
    samples = [r.html.encode() for r in pages.where(F.octet_length("html").between(1, SAMPLE_BYTES)).select("html").limit(sample_pages).collect()]
    if sum(map(len, samples)) < 8 * size or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, object]:
    """The fields of one record; raises WarcError where headers, lengths or digests are wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC version line: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:40]!r}")
        fields[name.lower()] = value.strip()
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]:
        raise WarcError(f"headers are missing: {missing}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, but {len(rest) - 4} bytes of block")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise WarcError("the block's digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not sep or len(sizes) != 1:
        raise WarcError("no HTTP head with one Content-Length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != sizes[0] or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("the payload's length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("a revisit with a payload or without a target")
    page = lambda x: int(y) if (y := x.strip("<>").removeprefix(URN)) else None
    return {"page_id": page(fields["warc-record-id"]), "record_type": kind, "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "target_uri": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": sizes[0], "payload": payload if kind == "response" else None}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame after the dictionary; ``stream.read(n)`` is called for a little at a time."""
    data, at = stream.read(8), 0
    context = zstandard.ZstdDecompressor()
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] in SKIPPABLE:
        magic, size = struct.unpack("<II", data)
        content = stream.read(size)
        if len(content) != size:
            raise WarcError("the skippable frame is cut short")
        if magic == DICT_MAGIC:
            if content[:4] == b"\x28\xb5\x2f\xfd":
                content = zstandard.ZstdDecompressor().decompress(content)
            context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        at, data = 8 + size, b""
    while data or (data := stream.read(1 << 20)):
        frame, parts, used = context.decompressobj(), [], 0
        while True:
            parts.append(frame.decompress(data))
            used += len(data)
            if frame.eof:
                break
            if not (data := stream.read(1 << 20)):
                raise WarcError(f"the frame at {at} is cut short")
        data = frame.unused_data
        yield at, b"".join(parts)
        at += used - len(data)


def _write(folder: str, dictionary: bytes, roll_bytes: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
        out, name, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{base}/{name}")
                    size = out.write(dictionary_frame(dictionary)) or len(dictionary_frame(dictionary))
                    records = 0
                frame = packer.compress(record(page_id, url, html.encode(), digest, refers_to))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= roll_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return each


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Write ``pages`` (page_id, url, html); returns the folder and the manifest of the archives in it."""
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/warc"
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    dictionary = train_dictionary(rows)
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Pages too small for revisits get a key of their own: they meet nobody, and spread over the join's partitions.
    large = F.octet_length("html") >= min_revisit
    rows = rows.withColumn("key", F.when(large, F.sha2(F.col("html").cast("binary"), 256)).otherwise(F.hex(F.xxhash64("page_id", "url", "html"))))
    groups = rows.where(large).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").select("key", "keeper")
    rows = rows.join(groups, "key", "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False)), F.col("keeper"))
    written = rows.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(_write(folder, dictionary, roll_bytes), MANIFEST)
    return folder, materialise(written, "warc_manifest")


def _read(folder: str, payloads: bool):
    names = ["archive", "offset", "page_id", "record_type", "refers_to", "target_uri", "payload_digest", "payload_bytes"] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with fs.open_input_stream(f"{base}/{archive}") as stream:
                    for offset, data in read_frames(stream):
                        fields = parse_record(data)
                        rows.append([archive, offset, *(fields[x] for x in names[2:])])
                        n, held = n + 1, held + len(data) * payloads
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if n != expected:
                    raise WarcError(f"{archive} has {n} records; the manifest has {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return each


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives, one row each; with ``payloads`` also what responses hold."""
    return manifest.select("archive", "records").repartition(partitions_for(manifest), "archive").mapInArrow(_read(folder, payloads), RECORDS + ", payload binary" * payloads)
