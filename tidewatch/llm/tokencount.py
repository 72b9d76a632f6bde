"""Token counts by whole-token shortcut: pre-tokens that are one token by proof are counted, only the rest is merged.

A sentencepiece BPE vocabulary has no splitter of its own, but merges can't cross a place that no piece spans.
``prove`` reads the vocabulary and finds, once and before any text is seen, (1) that no piece holds a
space after another character, or a line feed together with anything else, so texts fall apart into
pre-tokens before spaces and around line feeds; and (2) with the library itself, which pieces come out as one token when they
stand alone, for a piece may be out of its own merges' reach. Each worker keeps the counts of a bounded
number of other pre-tokens that it has met. The strings proven, at most the vocabulary, go to the workers once.

Defined results: a null or empty text has no tokens and 0 bytes; equal rows each give their own row, a null id stays null; an empty table
gives no rows; other columns, whatever their names, are ignored. A very long text is counted in slices of about a million
code points, a very long pre-token at the places that no piece spans; only a run without any such place (one letter
repeated, say) is merged in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

#: What stands for a space in the vocabulary (fixed by the format).
SPACE = "▁"
PRE_TOKEN = re.compile(r" *[^ \n]+|\n| +")
SLICE_CHARS = 1 << 20
#: Other pre-tokens whose counts a worker keeps, and the length up to which it does.
MEMO, MEMO_CHARS = 200_000, 64
#: A longer pre-token is cut where no piece spans two characters.
LONG = 1 << 14


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _model(path: str):
    """The library's own encoder for a vocabulary file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class VocabularyError(ValueError):
    """Not a vocabulary whose texts can be cut into pre-tokens."""


@dataclass
class Proof:
    """Pre-tokens that are one token, and the pairs of characters that stand side by side in some piece."""

    single: frozenset[str]
    pairs: frozenset[str]


def alone(model, pre_tokens: list[str]) -> list[int]:
    """How many tokens the library makes of each pre-token: behind a line feed, from which it is cut off."""
    return [len(ids) - 2 for ids in model.encode(["\n" + t for t in pre_tokens], num_threads=1)] if pre_tokens else []


def prove(path: str | None = None) -> Proof:
    from sentencepiece import sentencepiece_model_pb2

    path = path or vocabulary_path()
    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    rules = spec.normalizer_spec
    plain = spec.trainer_spec.model_type == 2 and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix
    if not plain or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise VocabularyError(f"{path}: not a byte-fallback BPE vocabulary that leaves texts as they are")
    # 1: normal pieces; 4: pieces that users define, which the library finds before it merges
    pieces = [p.piece for p in spec.pieces if p.type == 1]
    if any(p.type == 4 for p in spec.pieces) or any("\n" in p and len(p) > 1 or SPACE in p.lstrip(SPACE) for p in pieces):
        raise VocabularyError(f"{path}: pieces span the places where texts are cut")
    model = _model(path)
    if len(model.encode("\n")) != 2:
        raise VocabularyError(f"{path}: a line feed is more than one token")
    surfaces = [p.replace(SPACE, " ") for p in pieces]
    whole = [s for s in surfaces if PRE_TOKEN.fullmatch(s)]
    single = frozenset(s for s, n in zip(whole, alone(model, whole), strict=True) if n == 1)
    return Proof(single, frozenset(a + b for s in surfaces for a, b in zip(s, s[1:], strict=False)))


class Counter:
    """A worker's counts of pre-tokens: 1 for those proven, the library's for others."""

    def __init__(self, path: str, proof: Proof):
        self.model, self.proof = _model(path), proof
        self.memo: dict[str, int] = {}
        self.shortcuts = self.merged = 0

    def _parts(self, pre_token: str) -> list[str]:
        """A long pre-token, cut where no piece spans two characters, in parts of some length."""
        parts, last, pairs = [], 0, self.proof.pairs
        for i in range(1, len(pre_token)):
            if i - last >= LONG >> 2 and pre_token[i - 1 : i + 1] not in pairs:
                parts.append(pre_token[last:i])
                last = i
        return [*parts, pre_token[last:]]

    def count(self, text: str) -> int:
        """The tokens that the library makes of ``text``."""
        if not text:
            return 0
        text, total, at = " " + text.replace(SPACE, " "), 0, 0
        single, memo = self.proof.single, self.memo
        while at < len(text):
            # a slice ends before a space that follows another character, or at the end
            end = at + SLICE_CHARS
            while 0 <= end < len(text) and not (text[end] == " " and text[end - 1] != " "):
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else min(end, len(text))
            found = PRE_TOKEN.findall(text, at, end)
            rest = [t for t in found if t not in single]
            total += len(found) - len(rest)
            self.shortcuts += len(found) - len(rest)
            new = {t for t in rest if t not in memo}
            short = [t for t in new if len(t) <= MEMO_CHARS]
            if len(memo) + len(short) > MEMO:
                memo.clear()
                new = set(rest)
                short = [t for t in new if len(t) <= MEMO_CHARS]
            for lo in range(0, len(short), 4096):
                part = short[lo : lo + 4096]
                memo.update(zip(part, alone(self.model, part), strict=True))
            self.merged += len(new)
            for t in rest:
                total += memo[t] if len(t) <= MEMO_CHARS else sum(alone(self.model, self._parts(t) if len(t) > LONG else [t]))
            at = end
        return total


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str | None = None, proof: Proof | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row's text. ``path``: a vocabulary file that driver and workers have; ``proof``: what ``prove`` made of it."""
    proof = proof or prove(path)
    sent = docs.sparkSession.sparkContext.broadcast(proof)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = path or vocabulary_path()
        if own not in _COUNTERS:
            _COUNTERS[own] = Counter(own, sent.value)
        counter = _COUNTERS[own]
        for batch in batches:
            for piece in B.slices(batch.column(1)):
                counts = [counter.count(piece.buf[a:b].tobytes().decode()) for a, b in zip(piece.offsets, piece.offsets[1:], strict=False)]
                ids = batch.column(0).slice(piece.lo, len(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece.offsets[1:] - piece.offsets[:-1], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long")
