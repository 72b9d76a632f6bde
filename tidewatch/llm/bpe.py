"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash of their bytes says so, hence at the same places in
texts that share a passage. A worker encodes each chunk it meets once and keeps the
answer in a bounded table, for all its documents and tasks. The joints between chunks
are then repaired: a stretch around each cut, two words to either side, is encoded anew,
and its outer words must come out just as they did in their chunks. If they don't, the
cut is dropped and the two chunks are encoded as one, until all joints agree. Words of any script
begin at single spaces between visible characters, where the splitter of byte-level vocabularies
begins a word whatever stands around it. Where a stretch has no such spaces (Chinese, say, or packed code), they begin
at places that no token spans: two visible characters, no apostrophe, of which no token of the vocabulary holds the
bytes on both sides, so no merge crosses. A text without either (one letter repeated), or one that spells an added token, is one chunk.

The table is each Python worker's own. One for the whole cluster would need every chunk
and its ids in a shuffle, more than the text itself.

Defined results: a null or empty text has no ids and decodes to an empty text; equal rows
each give their own row; an empty table gives no rows; other columns, whatever their names, are
ignored. A very long text is one row, encoded chunk by chunk.
"""

from __future__ import annotations

import json
import os
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

#: A cut follows a byte where the hash of the last ``WINDOW`` bytes has ``CUT_BITS`` zero bits (chunks of 512 bytes on average, after the least).
WINDOW, CUT_BITS = 24, 9
LEAST_CHUNK, MOST_CHUNK = 128, 4096
#: Bytes of chunks that a worker keeps the ids of.
CACHE_BYTES = 24 << 20
ENCODE_BYTES = 1 << 20
#: The splitter of byte-level vocabularies (fixed by the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GEAR = B.mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def cut_points(buf: np.ndarray) -> list[int]:
    """Where chunks end. Depends on the bytes near a cut and on the cut before it only."""
    n = len(buf)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    mask = np.uint64((1 << CUT_BITS) - 1)
    maybe = []
    for lo in range(0, n, B.SLICE_BYTES):
        part = _GEAR[buf[max(0, lo - WINDOW + 1) : lo + B.SLICE_BYTES]]
        if len(part) >= WINDOW:
            h = np.zeros(len(part) - WINDOW + 1, np.uint64)
            for i in range(WINDOW):
                h = (h << np.uint64(1)) + part[i : i + len(h)]
            maybe.append(np.flatnonzero((h >> np.uint64(40)) & mask == 0) + max(0, lo - WINDOW + 1) + WINDOW)
    cuts, last = [], 0
    # not inside a character: a cut there would leave broken UTF-8 on both sides
    for c in np.concatenate(maybe).tolist() if maybe else ():
        if c - last >= LEAST_CHUNK and c < n and (buf[c] & 0xC0) != 0x80:
            while c - last > MOST_CHUNK:
                last = _step(buf, last)
                cuts.append(last)
            if c - last >= LEAST_CHUNK:
                cuts.append(c)
                last = c
    while n - last > MOST_CHUNK:
        last = _step(buf, last)
        cuts.append(last)
    return [*cuts, n]


def _step(buf: np.ndarray, last: int) -> int:
    c = last + MOST_CHUNK
    while (buf[c] & 0xC0) == 0x80:
        c -= 1
    return c


#: White space beyond ASCII that the splitter knows, by its UTF-8 bytes (fixed by Unicode).
_WIDE_SPACES = ["\u0085", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_WIDE = {n: np.array([int.from_bytes(x.encode(), "big") for x in _WIDE_SPACES if len(x.encode()) == n]) for n in (2, 3)}
_LEADS = np.zeros(256, bool)
_LEADS[[x.encode()[0] for x in _WIDE_SPACES]] = True
_SHOWN = np.ones(256, bool)
_SHOWN[:0x21] = _SHOWN[0x7F] = False
#: A stretch without word starts of so many bytes is searched for places that no token spans.
BARE_BYTES = 256


def visible(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters that aren't white space or controls; of white space beyond ASCII no byte does."""
    out = _SHOWN[buf]
    leads = np.flatnonzero(_LEADS[buf])
    if len(leads):
        wide = np.r_[buf, np.zeros(2, np.uint8)].astype(np.int32)
        pair = wide[leads] << 8 | wide[leads + 1]
        for n, code in ((2, pair), (3, pair << 8 | wide[leads + 2])):
            at = leads[np.isin(code, _WIDE[n])]
            for i in range(n):
                out[at + i] = False
    return out


def word_starts(buf: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Single spaces between visible characters."""
    return np.flatnonzero((buf[1:-1] == 0x20) & seen[:-2] & seen[2:]) + 1


class Spans:
    """Which places tokens of a vocabulary can span."""

    def __init__(self, tokens: list[bytes]):
        self.pairs, self.triples = np.zeros(1 << 16, bool), np.zeros(1 << 21, np.uint8)  # a bit for each triple
        for t in tokens:
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = True
            for i in range(len(t) - 2):
                self.triples[t[i] << 13 | t[i + 1] << 5 | t[i + 2] >> 3] |= 1 << (t[i + 2] & 7)

    def _held(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether a token holds these three bytes side by side."""
        return (self.triples[a << 13 | b << 5 | c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1

    def bare(self, buf: np.ndarray, seen: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Places in (lo, hi), two bytes from the ends of the text at least, that none spans."""
        at = np.arange(max(lo + 1, 2), min(hi, len(buf) - 1))
        left, right = buf[at - 1], buf[at]
        at = at[seen[at - 1] & seen[at] & ((right & 0xC0) != 0x80) & (left != 0x27) & (right != 0x27)]
        a, b, c, d = (buf[at + i].astype(np.int32) for i in (-2, -1, 0, 1))
        return at[~(self.pairs[b << 8 | c] | self._held(a, b, c) | self._held(b, c, d))]

    def starts(self, buf: np.ndarray) -> np.ndarray:
        """Where words surely begin. Memory: a few arrays as long as ``SLICE_BYTES``, besides what is found."""
        found = []
        for lo in range(0, len(buf), B.SLICE_BYTES):
            part = buf[max(0, lo - 4) : lo + B.SLICE_BYTES + 4]
            base = max(0, lo - 4)
            if len(part) < 3:
                continue
            seen = visible(part)
            own = word_starts(part, seen)
            edges = np.r_[0, own, len(part)]
            gaps = np.flatnonzero(np.diff(edges) > BARE_BYTES)
            if len(gaps):
                own = np.sort(np.concatenate([own, *(self.bare(part, seen, int(edges[g]), int(edges[g + 1])) for g in gaps.tolist())]))
            if len(part) == len(buf):
                return own
            own = own + base
            found.append(own[(own >= lo) & (own < lo + B.SLICE_BYTES)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


Joint = tuple[int, int, int, int]


def plan(buf: np.ndarray, safe: np.ndarray) -> tuple[list[int], list[Joint]]:
    """Cuts, and for each cut the joint to encode anew: (start, its first word's end, its last word's start, end).

    ``safe``: where words surely begin. A cut is left out where its joint would not fit between those of its neighbours.
    """
    cuts, joints, last = [], [], 0
    ends = np.array(cut_points(buf)[:-1], np.int64)
    for c, i in zip(ends.tolist(), np.searchsorted(safe, ends).tolist(), strict=True):
        if i >= 2 and i + 1 < len(safe) and safe[i - 2] >= last:
            joint = (int(safe[i - 2]), int(safe[i - 1]), int(safe[i]), int(safe[i + 1]))
            cuts.append(c)
            joints.append(joint)
            last = joint[3]
    return cuts, joints


class Decoder:
    """The bytes of a byte-level vocabulary's tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"]: t["content"] for t in spec.get("added_tokens") or ()}
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        parts = [b""] * (max([*vocab.values(), *added]) + 1)
        for token, i in vocab.items():
            parts[i] = b"" if i in added else bytes(letters[c] for c in token)
        for i, token in added.items():
            parts[i] = token.encode()
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.learn(path, spec, added, parts)

    def learn(self, path: str, spec: dict, added: dict[int, str], parts: list[bytes]) -> None:
        """What else is made of the file."""

    def decode(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        total = int(n.sum())
        at = np.repeat(self.begins[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.bytes[at].tobytes().decode("utf-8", errors="replace")


class Encoder(Decoder):
    """A byte-level tokenizer, the chunks it has met, and the bytes of its tokens.

    Where the vocabulary's ids are in the order of its merges (checked), chunks go through
    tiktoken, which then gives the same ids and is several times as fast; texts that spell
    an added token, and vocabularies of another order, go through tokenizers.
    """

    def learn(self, path: str, spec: dict, added: dict[int, str], parts: list[bytes]) -> None:
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.added = path, [t.encode() for t in added.values()]
        self.spans, self.fast = Spans(parts), None
        if _ordered(spec):
            ranks = {parts[i]: i for i in spec["model"]["vocab"].values() if i not in added}
            self.fast = tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.cache: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.held = 0
        self.encoded_bytes = self.reused_bytes = self.repaired = 0

    @cached_property
    def tokenizer(self):
        """The library's own, loaded where a text needs it."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.no_truncation()
        own.no_padding()
        return own

    def _ids(self, text: bytes) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text.decode()), np.uint32)

    def chunk(self, text: bytes) -> np.ndarray:
        """A chunk's ids, from the table if it has them."""
        ids = self.cache.get(text)
        if ids is not None:
            self.reused_bytes += len(text)
            self.cache.move_to_end(text)
            return ids
        ids = self._ids(text)
        self.encoded_bytes += len(text)
        if len(text) > CACHE_BYTES >> 6:
            return ids  # not worth what the table would lose for it
        self.cache[text] = ids
        self.held += len(text) + ids.nbytes + 300
        while self.held > CACHE_BYTES:
            old, gone = self.cache.popitem(last=False)
            self.held -= len(old) + gone.nbytes + 300
        return ids

    def _between(self, ids: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray | None:
        """The ids of a chunk's bytes a to b, if tokens begin and end just there."""
        i, j = np.searchsorted(ends, (a, b))
        return ids[i:j] if ends[i] == a and ends[j] == b else None

    def encode(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(a in text for a in self.added):
            return self._ids(text)
        buf = np.frombuffer(text, np.uint8)
        cuts, joints = plan(buf, self.spans.starts(buf))
        bounds = [0, *cuts, len(text)]
        # What is settled: (the chunk's begin, its ids, their ends) of each chunk, and between each two the joint and its ids.
        chunks, agreed = [self._chunk(text, bounds[0], bounds[1])], []
        for joint, a, b in zip(joints, bounds[1:], bounds[2:], strict=False):
            chunks.append(self._chunk(text, a, b))
            new = self._agree(text, joint, chunks[-2], chunks[-1])
            while new is None:
                # No agreement at this joint: its two chunks are encoded as one, which the joint before has to agree with in turn.
                self.repaired += 1
                chunks[-2:] = [self._chunk(text, chunks[-2][0], b)]
                if not agreed:
                    break
                joint, _ = agreed.pop()
                new = self._agree(text, joint, chunks[-2], chunks[-1])
            if new is not None:
                agreed.append((joint, new))
        out, begin = [], 0
        for (at, ids, ends), (joint, new) in zip(chunks, agreed, strict=False):
            out += [ids[np.searchsorted(ends, begin - at) : np.searchsorted(ends, joint[0] - at)], new]
            begin = joint[3]
        at, ids, ends = chunks[-1]
        return np.concatenate([*out, ids[np.searchsorted(ends, begin - at) :]])

    def _chunk(self, text: bytes, a: int, b: int) -> tuple[int, np.ndarray, np.ndarray]:
        ids = self.chunk(text[a:b])
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=ends[1:])
        return a, ids, ends

    def _agree(self, text: bytes, joint: Joint, one: tuple, two: tuple) -> np.ndarray | None:
        """The ids of a joint, if the words at both its ends come out as they did in their chunks."""
        (a, ids, ends), (b, next_ids, next_ends), (u, first, last, v) = one, two, joint
        word, next_word = self._between(ids, ends, u - a, first - a), self._between(next_ids, next_ends, last - b, v - b)
        if word is None or next_word is None:
            return None
        new = self.chunk(text[u:v])
        return new if np.array_equal(new[: len(word)], word) and np.array_equal(new[len(new) - len(next_word) :], next_word) else None


def _ordered(spec: dict) -> bool:
    """Whether a vocabulary's splitter is the usual byte-level one and its merged tokens' ids follow the order of the merges."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE"
    if not plain or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(a < b for a, b in zip(ids, ids[1:], strict=False)) and (not ids or ids[0] >= 256)


def _byte_letters() -> dict[str, int]:
    """Which letter stands for which byte in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decoder(path: str) -> Decoder:
    """This worker's decoder: its encoder, if it has one."""
    if path not in _DECODERS:
        _DECODERS[path] = _ENCODERS.get(path) or Decoder(path)
    return _DECODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row's text. ``path``: a byte-level vocabulary file.

    ``decoded``: also the text that the ids decode to, as ``decode`` gives it, in the same pass and by the same workers.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or vocabulary_path())
        for batch in batches:
            for piece in B.slices(batch.column(1), ENCODE_BYTES):
                texts = [piece.buf[a:b].tobytes() for a, b in zip(piece.offsets, piece.offsets[1:], strict=False)]
                ids = [own.encode(t) for t in texts]
                columns = [batch.column(0).slice(piece.lo, len(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` and the text of its ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path or vocabulary_path())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(each, "doc_id long, n_tokens long, ids binary, decoded string")
