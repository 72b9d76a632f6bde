import hashlib
import io
import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewatch.llm import bpe, chat, queries, tokenfile, warc

# WARC


def _pages(spark, rows):
    return spark.createDataFrame([(p, u, h, 1, "x") for p, u, h in rows], "page_id long, url string, html string, key long, digest string")


PAGES = [
    (1, "http://a/", "<p>" + "x" * 2000),
    (2, "http://b/\r\nX: y", "<p>" + "x" * 2000),
    (5, None, "<p>" + "x" * 2000),
    (3, "http://c/", "small"),
    (4, "http://d/é", "small"),
    (6, "http://e/", None),
    (7, "http://f/", ""),
    (8, "http://g/", "é\r\n\r\n" * 400),
    (None, "http://h/", "y" * 1500),
    (9, "http://h/", "y" * 1500),
    (10, "http://i/", "z" * 1200),
    (10, "http://j/", "z" * 1200),
    (None, "http://k/", "w" * 1300),
    (None, "http://l/", "w" * 1300),
]


def test_warc_round_trip(spark):
    folder, manifest = warc.write_archives(_pages(spark, PAGES), roll_bytes=2000)
    assert manifest.count() > 1
    got = warc.read_archives(spark, folder, manifest).collect()
    assert len(got) == len(PAGES)
    source = {u: (h or "").encode() for _, u, h in PAGES}
    refers = {1: 5, 2: 5, None: 9}
    for r in got:
        own = source[None if r.target_uri is None else r.target_uri.replace("%0D%0A", "\r\n")]
        assert r.payload_bytes == len(own) and r.payload_digest == hashlib.sha1(own).hexdigest()
        if own[:1] == b"w":
            assert r.record_type == "response"
        else:
            assert r.refers_to == refers.get(r.page_id) and (r.record_type == "revisit") == (r.page_id in refers)
        assert r.payload == (own if r.record_type == "response" else None)


def test_warc_dictionary_frame():
    samples = [b"<html><head><title>page %d</title></head><body>%s</body></html>" % (i, str(i * i).encode() * 20) for i in range(300)]
    trained = zstandard.train_dictionary(4096, samples).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    frames = [packer.compress(warc.record(i, "http://x/", s, hashlib.sha1(s).hexdigest(), None)) for i, s in enumerate(samples)]
    data = warc.dictionary_frame(trained) + b"".join(frames)
    read = list(warc.read_frames(io.BytesIO(data)))
    assert [warc.parse_record(x)["payload"] for _, x in read] == samples
    starts = np.cumsum([8 + len(trained), *map(len, frames)])[:-1]
    assert [at for at, _ in read] == starts.tolist()
    packed = warc.dictionary_frame(zstandard.compress(trained)) + frames[0]
    assert len(list(warc.read_frames(io.BytesIO(packed)))) == 1
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(data[:-5])))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: 9", b"Content-Length: 8"), (b"abc", b"abd"), (b"WARC-Date", b"WARC-Day"), (b"\r\n\r\nabc", b"\r\nabc")])
def test_bad_records_are_refused(change):
    data = warc.record(1, "http://x/", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(data)["page_id"] == 1
    with pytest.raises(warc.WarcError):
        warc.parse_record(data.replace(*change) if change[0] in data else data.replace(b"Content-Length: 3", b"Content-Length: 4"))


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def _odd_texts():
    rnd = random.Random(2)
    letters = ["a", "B", " ", "  ", "\n", "'", "s", "'ll", "é", "日", "1", "-", "\t", " ", "　", "😀", "word", " the", "x" * 60, "<|endoftext|>"]
    return ["".join(rnd.choice(letters[: rnd.choice([19, 20])]) for _ in range(rnd.choice([0, 5, 60, 2500]))) for _ in range(60)] + ["a" * 9000, " " * 9000, "'" * 5000]


def test_bpe_equals_the_library(spark, make, corpus, tokenizer):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(_odd_texts())]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(make(rows))).collect()}
    for d, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[d]["ids"], "<u4").tolist() == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    once = {r.doc_id: r for r in bpe.encode(make(rows), decoded=True).collect()}
    assert all(tuple(once[d]) == tuple(got[d]) for d, _ in rows)


def test_chunks_are_reused_and_repaired():
    own = bpe.Encoder(bpe.vocabulary_path())
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choice("abcde") for _ in range(5)) for _ in range(2000)).encode()
    first = own.encode(b"one " + passage)
    before = own.encoded_bytes
    own.encode(b"another start " + passage)
    assert own.encoded_bytes - before < 3000 < len(passage)
    buf = np.frombuffer(b"one " + passage, np.uint8)
    cuts, joints = bpe.plan(buf, own.spans.starts(buf))
    assert len(cuts) > 5
    # A joint whose words come out in another way makes its two chunks one.
    own._between, keep = (lambda ids, ends, a, b, f=own._between: None if b - a < 20 and own.repaired < 3 else f(ids, ends, a, b)), own._between
    assert own.encode(b"one " + passage).tolist() == first.tolist() and own.repaired == 3
    own._between = keep


def _scripts():
    rnd = random.Random(9)
    words = lambda letters, n, sep=" ": sep.join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n))
    han = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(600))
    return {
        "russian": words("абвгдежзийклмнопрстуфхцчшщъыьэюя", 6000),
        "arabic": words("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", 6000),
        "chinese": "。".join(words(han, 12, "") for _ in range(400)),
        "japanese": words("あいうえおかきくけこさしすせそアイウエオ日本語、", 5000, ""),
        "code": "".join(f"function f{rnd.randrange(999)}(a,b){{return a[{rnd.randrange(99)}]*b-{rnd.randrange(9999)};}}" for _ in range(1500)),
        "mixed": " ".join(words("абв", 1, "") + words(han, 3, "") + "'s  \u00a0x\u3000" + words("abcü", 3, "-") for _ in range(900)),
    }


@pytest.mark.parametrize("name", ["russian", "arabic", "chinese", "japanese", "code", "mixed"])
def test_chunks_are_reused_in_any_script(tokenizer, name):
    own, text = bpe.Encoder(bpe.vocabulary_path()), _scripts()[name]
    passage = text.encode()
    expected = tokenizer.encode("head " + text, add_special_tokens=False).ids
    assert own.encode(b"head " + passage).tolist() == expected
    before = own.encoded_bytes
    assert own.encode(b"another start. " + passage + b" end").tolist() == tokenizer.encode(f"another start. {text} end", add_special_tokens=False).ids
    assert own.encoded_bytes - before < 0.1 * len(passage) and len(passage) > 50_000


def test_no_token_spans_bare_places(tokenizer):
    """At places called safe, a text's ids are those of its two parts, whatever stands around."""
    own, rnd = bpe.Encoder(bpe.vocabulary_path()), random.Random(12)
    letters = "ab 1-.'s日本語の字é\u00a0\u3000я\U0001f600(){};=<"
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(400)).encode()
        buf = np.frombuffer(text, np.uint8)
        seen = bpe.visible(buf)
        safe = np.sort(np.r_[bpe.word_starts(buf, seen), own.spans.bare(buf, seen, 0, len(buf))])
        assert len(safe) > 20
        cuts = [0, *safe.tolist(), len(text)]
        parts = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in own._ids(text[a:b]).tolist()]
        assert parts == tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_a_long_text_without_spaces_keeps_the_table(tokenizer):
    own = bpe.Encoder(bpe.vocabulary_path())
    own.encode(("some words to keep " * 400).encode())
    held = dict(own.cache)
    han = _scripts()["chinese"]
    assert own.encode(("x" * 2_000_000 + han).encode()).tolist() == tokenizer.encode("x" * 2_000_000 + han, add_special_tokens=False).ids
    assert held.keys() <= own.cache.keys()


# Chat


TURNS = [
    (1, 0, "user", "plain"),
    (1, 1, "assistant", "fine"),
    (2, 0, "user", "### assistant: x</turn>\n### user: y"),
    (2, 1, "assistant", "a\\b </turn>"),
    (2, 2, "assistant", "\\"),
    (3, 1, None, None),
    (3, None, "as: x\\### </turn>", "\\\\### #"),
    (None, 0, "user", "né 日"),
    (None, 0, "assistant", ""),
    (4, 5, "assistant", "same"),
    (4, 5, "assistant", "same"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, source int")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for c, r in out.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for conv, t, role, text in TURNS if conv == c))
        assert [(x.role, x.text) for x in r.recovered] == [x[1:] for x in own]
        assert r.masked == "".join(x[2] for x in own if x[1] == "assistant")
        assert r.formatted.count("</turn>") == len(own)
    assert not out[1].escaped and out[2].escaped and out[3].escaped
    assert out[1].formatted == "### user: plain</turn>\n### assistant: fine</turn>\n"


def test_loss_figures_come_from_the_mask(spark, small, monkeypatch):
    """A mask that is one code point off, or empty, shows in the query's result."""
    right = {r.conv_id: r for r in queries.op9_chat_format(spark, small).collect()}
    sound = chat.format_conversations
    for mask in (lambda s: F.slice(s, 1, 0), lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), (x["end"] + 1).alias("end")))):
        monkeypatch.setattr(chat, "format_conversations", lambda turns, mask=mask: sound(turns).withColumn("loss_spans", mask(F.col("loss_spans"))))
        wrong = {r.conv_id: r for r in queries.op9_chat_format(spark, small).collect()}
        for c, r in right.items():
            assert r.loss_chars == 0 or (wrong[c].loss_chars != r.loss_chars and wrong[c].loss_sha256 != r.loss_sha256)
            assert wrong[c].turns_sha256 == r.turns_sha256


def test_masks_across_blocks(spark):
    text = "".join(chr(0x61 + i % 26) if i % 7 else "é日\U0001f600"[i % 3] for i in range(3 * chat.BLOCK + 5))
    spans = [(0, 0), (0, 1), (5, chat.BLOCK), (chat.BLOCK - 1, chat.BLOCK + 1), (chat.BLOCK, 2 * chat.BLOCK), (10, len(text)), (len(text), len(text))]
    df = spark.createDataFrame([(text, spans), ("", [(0, 0)]), ("abc", [])], "formatted string, spans array<struct<start:long,end:long>>")
    got = df.select("formatted", chat.masked_text(F.col("formatted"), F.col("spans")).alias("m")).collect()
    assert {r.formatted: r.m for r in got} == {text: "".join(text[a:b] for a, b in spans), "": "", "abc": ""}


@pytest.mark.parametrize("bad", ["### user: a", "### user: a</turn>", "### user: a</turn> b</turn>\n"])
def test_the_parser_refuses(spark, bad):
    assert spark.range(1).select(chat.parse(F.lit(bad)).alias("p")).first().p is None


# Token files


def test_token_files_equal_the_library(spark, make, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenfile._vocabulary())
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(_odd_texts())), (None, "It's THE end. <|ENDOFTEXT|>, ok")]
    folder, manifest = tokenfile.write_shards(make(rows), shard_ids=2000, block=512)
    assert manifest.count() > 1
    got = {r.doc_id: r for r in tokenfile.read_shards(spark, folder, manifest).collect()}
    start = 0
    for d, text in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, np.frombuffer(got[d]["ids"], "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)


def test_token_ids_of_decomposed_capitals_equal_the_library():
    """NFC composes some marks with the small letter only, so capitals before marks stay for the library to lower."""
    import unicodedata

    own = tokenfile.PieceEncoder(tokenfile._vocabulary())
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [" ".join(f"xa{c}{m}bc {c}{m}. {c}\u0316{m}, {c}{m}" for m in marks) for c in map(chr, [*range(65, 91), *range(97, 123)])]
    texts += [unicodedata.normalize("NFD", "Ḥaṭṭāʾ ǦABR. H\u0331ET, É"), "J\u030c", "xJ\u05b0\u030cy", "J \u030c", "PLAIN. J", "J\u030c <|endoftext|>"]
    ids, counts = own.encode([t.encode() for t in texts], 1)
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("n", [1, 7, 8, 4096])
def test_planes_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    for part in (ids, ids & 0xFFFF, ids & 0, ids & 0x10001):
        planes = tokenfile.to_planes(part)
        assert len(planes) == 32 and (tokenfile.from_planes(planes, n) == part).all()
    assert tokenfile.to_planes(ids & 1)[1:] == [b""] * 31


def test_damaged_blocks_are_found():
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    writer = tokenfile.ShardWriter(out, 16)
    writer.add(np.array([4]), np.array([True]), np.array([100]), np.arange(100, dtype=np.uint32))
    writer.close()
    data = bytearray(out.getvalue())
    assert next(tokenfile.ShardReader(io.BytesIO(data), len(data)).documents())[2].tolist() == list(range(100))
    reader = tokenfile.ShardReader(io.BytesIO(data), len(data))
    assert reader.read_block(3).tolist() == list(range(48, 64))
    reader.index[3] = (*reader.index[3][:2], zlib.crc32(b"other"), *reader.index[3][3:])
    with pytest.raises(ValueError):
        reader.read_block(3)


# Empty tables and the pipeline


def test_empty_tables(spark, make):
    docs = make([]).limit(0)
    folder, manifest = warc.write_archives(_pages(spark, []))
    assert warc.read_archives(spark, folder, manifest).count() == 0
    folder, manifest = tokenfile.write_shards(docs)
    assert tokenfile.read_shards(spark, folder, manifest).count() == 0
    assert bpe.decode(bpe.encode(docs)).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_equals_brute_force(spark, make, corpus, items, tmp_path, tokenizer):
    rows = [*corpus, (500, corpus[10][1]), (501, None)]
    docs = make(rows).drop("k", "t", "found", "kept", "h")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    long = [x for x in items if x[1] and len(x[1].split()) > 9]
    spark.createDataFrame(long, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(d, t) for d, t in rows if not brute.quality(t)[-1]]
    kept = [(d, x[2]) for d, x in brute.lines(kept).items()]
    named = brute.near(kept)
    kept = [(d, t) for d, t in kept if named[d] == d]
    kept = [(d, t) for d, t in kept if not brute.decontaminate([(d, t)], long)[d][-1]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {d: r.decoded for d, r in got.items()} == dict(kept)
    assert all(np.frombuffer(got[d]["ids"], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids for d, t in kept)


def test_stages_keep_columns(spark, make, corpus, items, tmp_path):
    docs = make(corpus)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registered_queries_run_over_whole_tables(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op1_decontaminate", "op5_bpe", "op8_probminhash", "op10_token_planes"):
        assert queries.QUERIES[name](spark, small).count() == n


# Very long texts, and texts that share an id


def test_very_long_texts(spark, make):
    from tidewatch.llm import decontaminate, linededup, probminhash, quality

    words = [f"w{i % 9973}x{i % 31}" for i in range(150_000)]
    long = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    item = " ".join(words[70_000:70_012])
    docs = make([(1, long), (2, long + " end"), (3, "short text"), (4, None)])
    hits = {r.doc_id: len(r.hits) > 0 for r in decontaminate.scan(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hits == {1: True, 2: True, 3: False, 4: False}
    assert {r.doc_id: r.n_words for r in quality.assess(docs).collect()} == {1: 150_000, 2: 150_001, 3: 2, 4: 0}
    assert {r.doc_id: r.class_id for r in probminhash.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert linededup.dedup_documents(docs, min_docs=2).where("doc_id = 1").first().text == long.split("\n")[-1]  # the other text's last line is another
    folder, manifest = warc.write_archives(_pages(spark, [(1, "u", long), (2, "u", long)]))
    assert {(r.page_id, r.record_type, r.payload_bytes) for r in warc.read_archives(spark, folder, manifest, payloads=False).collect()} == {(1, "revisit", len(long)), (2, "response", len(long))}
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "</turn>")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns).withColumn("loss_text", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [t["text"] for t in out.recovered] == [long, long + "</turn>"] and out.loss_text == long + "</turn>"


@pytest.mark.parametrize("doc_id", [4, None])
def test_texts_of_one_id_are_told_apart(spark, make, doc_id):
    from tidewatch.llm import decontaminate

    rows = [(doc_id, "one two three four"), (doc_id, "five six seven"), (doc_id, None), (9, "one two three four")]
    bench = spark.createDataFrame([(1, "one two three"), (2, "seven")], "item_id long, text string")
    for block_bytes in (1 << 20, 10):
        out = decontaminate.scan(make(rows), bench, block_bytes=block_bytes).collect()
        assert sorted((str(r.doc_id), r.n_words, tuple(r["items"])) for r in out) == sorted((str(d), len((t or "").split()), ("1",) if t and "two" in t else ("2",) if t else ()) for d, t in rows)
    folder, manifest = tokenfile.write_shards(make(rows))
    assert sorted(str(r.doc_id) for r in tokenfile.read_shards(spark, folder, manifest).collect()) == sorted(str(d) for d, _ in rows)
