import brute
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, linededup, probminhash, quality, substrings, suffixes


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


# Decontamination


def _op1(docs, bench, **kw):
    hits = decontaminate.scan(docs, bench, **kw)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return rows_of(hits.select("doc_id", "n_words", n_hit, F.size("items"), F.sha2(F.array_join("items", ","), 256), F.size("hits") > 0))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, make, corpus, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _op1(make(corpus), bench, block_bytes=block_bytes) == brute.decontaminate(corpus, items)


@pytest.mark.parametrize("stretch", [1, 3, 50])
def test_long_items_go_in_stretches(spark, make, corpus, items, monkeypatch, stretch):
    """A benchmark in blocks whose items are cut into stretches has the windows, items and hits that it has as a whole."""
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    long = [*items, (20, " ".join(w for _, t in corpus[20:24] for w in t.split()[:40]))]
    bench = spark.createDataFrame(long, "item_id long, text string")
    _, blocks = decontaminate._blocks(bench, 10, 200)
    sizes = [sum(len(texts) for _, texts, _, _ in w.by_length.values()) for w in blocks]
    assert len(sizes) > 4 and (stretch > 3 or max(sizes) < sum(sizes) / 2)
    assert _op1(make(corpus), bench, block_bytes=200) == brute.decontaminate(corpus, long)


def test_decontamination_removes(spark, make, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.decontaminate(corpus, items)
    kept = decontaminate.remove(make(corpus), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, e in expected.items() if not e[-1]}
    assert kept.schema == make(corpus).schema
    spans = decontaminate.remove(make(corpus), bench, mode="spans")
    again = _op1(spans, bench)
    assert all(again[d][0] <= expected[d][0] - expected[d][1] for d in expected if expected[d][-1] and d != 9)
    assert spans.count() == len(corpus)


def test_decontamination_of_equal_rows_and_nulls(spark, make, items):
    bench = spark.createDataFrame([*items, (None, "only here now"), (3, items[0][1])], "item_id long, text string")
    docs = make([(None, "only here now"), (4, items[0][1]), (4, items[0][1]), (5, None)])
    for block_bytes in (1 << 20, 60):
        out = sorted(decontaminate.scan(docs, bench, block_bytes=block_bytes).select("doc_id", "items").collect(), key=str)
        assert sorted((str(r.doc_id), tuple(r["items"])) for r in out) == [("4", ("12", "3")), ("4", ("12", "3")), ("5", ()), ("None", ("null",))]


# Substring and suffix-array dedup


def _op3(docs, **kw):
    return rows_of(substrings.dedup(docs, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))


def test_substrings_equal_brute_force(make, corpus):
    assert _op3(make(corpus)) == brute.substrings(corpus)


@pytest.fixture
def all_hot(monkeypatch):
    from tidewatch.llm import anchors

    monkeypatch.setattr(anchors, "SAMPLE", 1)
    monkeypatch.setattr(anchors, "LEAST_HOT", 2)


@pytest.mark.parametrize("runs", [1, 3, 500])
def test_hot_anchors_change_nothing(make, corpus, all_hot, runs):
    """Anchors dealt over tasks, and their runs, however few: the same result."""
    assert _op3(make(corpus), runs=runs) == brute.substrings(corpus)
    if runs == 3:
        assert _op4(make(corpus)) == brute.suffixes(corpus)


def test_a_hot_anchor_is_dealt_over_tasks(spark, make, monkeypatch):
    """A third of all documents share a passage and differ around it: the runs of its anchors are dealt over tasks, a few and the first in each."""
    import random

    from tidewatch.llm import anchors
    from tidewatch.llm.common import compact, keyed

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    seed = [f"zz{i}" for i in range(30)]
    rows = [(i, " ".join([word() for _ in range(30)] + ((seed[:12] + [word() for _ in range(8)]) if i % 3 == 0 else []) + [word() for _ in range(20)])) for i in range(240)]
    monkeypatch.setattr(anchors, "SAMPLE", 4)
    monkeypatch.setattr(anchors, "LEAST_HOT", 8)
    base, seeds = compact(keyed(make(rows))), substrings._seeds(20, 6)
    hot = anchors.hot_anchors(base, seeds)
    assert 0 < len(hot) < 8
    first = anchors.settle(base.mapInArrow(seeds, anchors.ROWS), later=True, growth=3, hot=hot)
    parts = anchors.dealt(first.where(F.col("kind") == anchors.OPEN), hot, 5).where(F.col("h").isin(hot)).select("h", F.explode("parts").alias("part"))
    sizes = parts.groupBy("h", "part").count()
    total = {r.h: r.n for r in sizes.groupBy("h").agg(F.sum("count").alias("n")).collect()}
    most = {r.h: r.n for r in sizes.groupBy("h").agg(F.max("count").alias("n")).collect()}
    assert max(total.values()) >= 40 and all(most[h] <= max(0.1 * n, 14) for h, n in total.items())
    assert _op3(make(rows), runs=5) == brute.substrings(rows)


def test_substrings_of_repeats_in_one_text(make):
    rows = [(1, "a b " * 40), (2, "c " * 25), (3, " ".join(map(str, range(60))) + " " + " ".join(map(str, range(60))))]
    assert _op3(make(rows)) == brute.substrings(rows)


def test_substrings_of_equal_rows(make, corpus):
    """A row listed twice is one document; its copies under other ids are repeats."""
    text = corpus[8][1]
    out = substrings.dedup(make([(1, text), (1, text), (2, text), (None, None)]), min_words=20).collect()
    assert sorted((str(r.doc_id), r.n_removed == r.n_words) for r in out) == [("1", False), ("1", False), ("2", True), ("None", True)]


def _op4(docs, **kw):
    out = suffixes.dedup(docs, **kw)
    return rows_of(out.select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)))


@pytest.mark.parametrize("shard", [20_000, 5, 0])
def test_suffixes_equal_brute_force(make, corpus, shard):
    """Whatever a shard may hold: small limits split hot anchors by longer prefixes, and stream what still is too large."""
    assert _op4(make(corpus), shard=shard) == brute.suffixes(corpus)


def test_suffixes_of_equal_rows(make, corpus):
    text = next(t for _, t in corpus if t and len(t) > 900)
    out = suffixes.dedup(make([(1, text), (1, text), (5, None)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 0), (1, 0), (5, 0)]
    out = suffixes.dedup(make([(1, text), (2, text)])).collect()
    assert all(r.n_removed == r.n_bytes for r in out)


def test_long_texts_cross_segments(make, monkeypatch):
    import random

    rnd = random.Random(3)
    long = "".join(rnd.choice("abcd ") for _ in range(600_000))
    rows = [(1, long), (2, long[250_000:280_000] + "zz" + long[5:700])]
    assert _op4(make(rows)) == brute.suffixes(rows)


def test_repeats_of_a_shard_have_all_their_occurrences():
    texts = ["abcdeXfghij", "zbcdeXfghiq", "zbcdeXfgyyy"]
    lefts, rights = [t[:5][::-1].encode() for t in texts], [t[5:].encode() for t in texts]
    found = {(left, right): sorted(m) for left, right, m in suffixes.maximal_repeats(lefts, rights, 6)}
    assert found == {(4, 5): [0, 1], (5, 3): [1, 2], (4, 3): [0, 1, 2]}
    assert suffixes.cover(lefts, rights, 6) == [(4, 5), (5, 5), (5, 3)]
    assert [x[:2] for x in suffixes.maximal_repeats(lefts, rights, 6, low=5)] == [(5, 3)]


def _contexts(rnd, n):
    pick = lambda k: bytes(rnd.choice(b"ab") for _ in range(k))
    return [pick(rnd.randint(0, 6)) for _ in range(n)], [b"#" + pick(rnd.randint(0, 7)) for _ in range(n)]


def test_repeats_of_a_shard_equal_brute_force():
    """Every pair's common stretch is a repeat; its occurrences are all suffixes that have it."""
    import random

    rnd = random.Random(11)
    for _ in range(60):
        lefts, rights = _contexts(rnd, rnd.randint(2, 14))
        n, expected, cover = len(lefts), {}, [None] * len(lefts)
        for i in range(n):
            for j in range(i):
                left, right = suffixes.common_prefix(lefts[i], lefts[j]), suffixes.common_prefix(rights[i], rights[j])
                if left + right >= 4:
                    for m in (i, j):
                        cover[m] = (max(left, cover[m][0]), max(right, cover[m][1])) if cover[m] else (left, right)
        for i in range(n):
            for left in range(len(lefts[i]) + 1):
                for right in range(1, len(rights[i]) + 1):
                    own = [m for m in range(n) if lefts[m][:left] == lefts[i][:left] and rights[m][:right] == rights[i][:right] and len(lefts[m]) >= left and len(rights[m]) >= right]
                    if left + right >= 4 and len(own) > 1:
                        ends = lambda texts, at: [texts[m][at : at + 1] for m in own]
                        diverse = lambda e: len(set(e)) > 1 or e[0] == b""
                        if diverse(ends(lefts, left)) and diverse(ends(rights, right)):
                            expected[(lefts[i][:left], rights[i][:right])] = own
        got = {(lefts[m[0]][:left], rights[m[0]][:right]): sorted(m) for left, right, m in suffixes.maximal_repeats(lefts, rights, 4)}
        assert got == expected
        assert suffixes.cover(lefts, rights, 4) == cover


@pytest.mark.parametrize("most", [3, 30])
def test_repeats_that_cover_are_repeats_and_cover_all(monkeypatch, most):
    """What large shards list: some of all maximal repeats, each with every occurrence, that together cover what all do."""
    import random

    rnd = random.Random(most)
    for _ in range(80):
        lefts, rights = _contexts(rnd, rnd.randint(2, 40))
        lefts, rights = [x[:most] for x in lefts], [x[: most + 1] for x in rights]
        low = rnd.randint(0, 2)
        high = low + rnd.choice((0, 1, 30))
        monkeypatch.setattr(suffixes, "LISTED", 1000)
        every, whole = {(a, b, *sorted(m)) for a, b, m in suffixes.maximal_repeats(lefts, rights, 4, low, high)}, suffixes.cover(lefts, rights, 4, low, high)
        monkeypatch.setattr(suffixes, "LISTED", 1)
        some = [(a, b, *sorted(m)) for a, b, m in suffixes.covering_repeats(lefts, rights, 4, low, high)]
        assert len(some) == len(set(some)) and set(some) <= every
        if high - low > 20 and not low:
            assert suffixes.cover(lefts, rights, 4, low, high) == whole


@pytest.mark.parametrize("shard", [20_000, 2, 0])
def test_groups_hold_every_occurrence(make, shard):
    """Each group: all places of its bytes in the corpus. All strings that occur twice lie in groups, at each of their places."""
    import random
    from collections import defaultdict

    rnd = random.Random(4)
    prose = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = [prose(n) for n in (30, 45, 90)]
    rows = [(i, "".join(x for _ in range(rnd.randint(1, 4)) for x in (prose(rnd.randint(5, 60)), rnd.choice(shared)[rnd.randint(0, 6) :]))) for i in range(25)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (41, rows[3][1]), (42, None), (43, "")]
    least, texts, found = 24, dict(rows), defaultdict(set)
    for r in suffixes.groups(make(rows), least, 8, shard).collect():
        found[texts[r.doc_id][r.start : r.end]].add((r.doc_id, r.start))
        assert r.length == r.end - r.start >= least
    places = lambda w: {(d, p) for d, t in texts.items() for p in range(len(t or "") - len(w) + 1) if t[p : p + len(w)] == w}
    assert found and all(places(w) == at and len(at) > 1 for w, at in found.items())
    inside = {(d, p) for w, at in found.items() for d, s in at for p in range(s, s + len(w) - least + 1)}
    windows = {t[p : p + least] for t in texts.values() for p in range(len(t or "") - least + 1)}
    assert inside == set().union(*(at for w in windows if len(at := places(w)) > 1))


# Words and bytes decide, not hashes


def test_equal_hashes_of_other_texts_remove_nothing():
    """Two runs whose anchors' hashes met, with one word that differs: only what agrees on both sides of it is a repeat."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(50)]
    other = [*words[:24], "else", *words[25:]]
    for own, expected in ((words, [(0, 30)]), (other, [(0, 4), (25, 30)]), ([f"x{i}" for i in range(50)], [])):
        rows = [(7, 0, 1, 0, 0, 0, 8, " ".join(words).encode()), (7, 0, 2, 0, 0, 0, 8, " ".join(own).encode())]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["h", "part", "k", "t", "u", "a", "p", "words"])
        found = [r for out in substrings._extend(20)(iter([batch])) for r in out.to_pylist()]
        assert sorted((r["a"], r["b"]) for r in found if r["kind"] == 0) == expected
        covered = {i for s, e in expected for i in range(s, e + 1)}
        assert sorted(r["a"] for r in found if r["kind"] == 1) == sorted(set(range(31)) - covered)  # these may still repeat a third text


def test_substrings_of_many_shapes(make):
    """Short windows over few words: every kind of overlap, periods, texts longer than a block, third texts."""
    import random

    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(i, " ".join(rnd.choice("abcd") + rnd.choice("xyz") for _ in range(rnd.choice((3, 12, 60, 700))))) for i in range(30)]
        rows += [(50 + i, " ".join(rows[i][1].split()[5:] + ["tail"] * 9)) for i in range(10)] + [(70, "p q r " * 200), (71, "q r p " * 120)]
        rnd.shuffle(rows)
        assert _op3(make(rows), min_words=7, seed_words=3) == brute.substrings(rows, 7)


# Line dedup


def _op6(docs):
    out = linededup.with_bitmaps(docs.select("doc_id", "text"))
    return rows_of(out.select("c0", F.coalesce("n_dropped", F.lit(0)), linededup.kept_text(F.coalesce("c1", F.lit("")), F.col("dropped"))))


def test_lines_equal_brute_force(make, corpus):
    expected = {d: x[1:] for d, x in brute.lines(corpus).items()}
    assert any(x[0] for x in expected.values())
    assert _op6(make(corpus)) == expected


def test_lines_keep_columns_and_drop_many(make):
    line = "this very long line is found in each of the documents"
    rows = [(d, "\n".join([f"own {d}"] + [line] * 150 + ["end"])) for d in range(7)] + [(None, line), (8, None)]
    out = linededup.dedup_documents(make(rows))
    assert out.columns == make(rows).columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {**{d: f"own {d}\nend" for d in range(6)}, 6: rows[6][1], None: "", 8: None}


def test_line_keys_are_counted_by_document(make):
    line = "0123456789" * 4
    assert _op6(make([(1, line + "\n" + line), (2, line), (3, line), (4, line + "\n" + line)])) == {1: (0, f"{line}\n{line}"), 2: (0, line), 3: (0, line), 4: (0, f"{line}\n{line}")}


@pytest.mark.parametrize("doc_id", [3, None])
def test_texts_of_one_id_with_equal_checksums(make, doc_id):
    """Two texts of one id whose CRC-32 agree are two documents: neither takes the other's repeats, neither is lost."""
    import zlib

    passage = " ".join(f"passage{i}" for i in range(60))
    by_crc = {zlib.crc32(f"{passage}\nown words of one are {i}".encode()): i for i in range(150_000)}
    j = next(j for j in range(1_000_000) if zlib.crc32(f"other text with number {j} in it".encode()) in by_crc)
    other = f"other text with number {j} in it"
    one = f"{passage}\nown words of one are {by_crc[zlib.crc32(other.encode())]}"
    docs = make([(doc_id, one), (doc_id, other), *((d, f"{passage}\nand then {d}") for d in (-2, 1, 2, 4, 5, 6))])
    got = {r.text for r in linededup.dedup_documents(docs).where(F.col("doc_id").eqNullSafe(doc_id)).collect()}
    assert got == {one.split("\n")[1], other}
    removed = lambda df: sorted(r.n_removed > 0 for r in df.where(F.col("doc_id").eqNullSafe(doc_id)).collect())
    assert removed(suffixes.dedup(docs)) == [False, True]
    assert removed(substrings.dedup(docs)) == [False, doc_id is not None]  # a null id comes first and keeps the passage
    kept = probminhash.keep_one(docs).where(F.col("doc_id").eqNullSafe(doc_id)).collect()
    assert {other} <= {r.text for r in kept} and len(kept) == (2 if doc_id is None else 1)


# Quality rules


def test_quality_equals_brute_force(make, corpus):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = rows_of(quality.assess(make(corpus)).select("doc_id", *names))
    assert got == {d: brute.quality(t) for d, t in corpus}


def test_hosts_that_fail_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(60)] + [(100 + i, "bad" if i else good, "spam") for i in range(60)] + [(300, good, None), (301, good, "new"), (302, "x", "new2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.filter_documents(docs).collect()}
    assert kept == {*range(60), 300, 301}
    assert {r.doc_id for r in quality.assess(docs).collect() if r.kept} == kept


def test_host_verdicts_equal_sql(spark):
    """Hosts of many sizes and rates: the SQL of op7 over the same rows, where verdicts differ from the base rules."""
    import random

    import duckdb

    from tidewatch.llm.oracle import ORACLE

    rnd = random.Random(9)
    good = " ".join(f"w{i}" for i in range(60))
    rows = []
    for host in range(40):
        rate = rnd.choice((0.02, 0.1, 0.2, 0.6, 0.95))
        rows += [(len(rows) + i, "bad" if rnd.random() < rate else good, f"host{host}" if host else None) for i in range(rnd.choice((1, 2, 7, 300)))]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(quality.assess(documents).drop("host_failed"))
    db = duckdb.connect()
    db.register("documents", documents.toPandas())
    assert got == {r[0]: tuple(r[1:]) for r in db.execute(ORACLE["op7_quality_rules"]).fetchall()}
    lost = {d for d, x in got.items() if not x[-2] and not x[-1]}
    assert lost and len(lost) < 0.2 * len(rows)


def test_quality_of_equal_rows_and_columns(make):
    good = " ".join(f"w{i}" for i in range(60))
    docs = make([(1, good), (1, good), (None, good), (2, None)])
    out = quality.filter_documents(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]


# Near duplicates


def test_near_duplicates_equal_brute_force(make, corpus):
    got = {r.doc_id: r.class_id for r in probminhash.classes(make(corpus)).collect()}
    assert got == brute.near(corpus)


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_duplicates_by_the_last_phase(make, monkeypatch, rounds):
    """A chain of edits: neighbours are similar, the ends are not; few rounds leave work to the block comparison."""
    import random

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[rnd.randrange(400)] = f"e{i}{rnd.random()}"
    got = {r.doc_id: r.class_id for r in probminhash.classes(make(rows), rounds=rounds).collect()}
    assert got == brute.near(rows)


def test_large_buckets_verify_what_signatures_rate_low():
    """Pairs at the threshold whose signatures agree in one band only, in a bucket of over SMALL_BUCKET members."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(f"m{i}w{j}" for j in range(104)) for i in range(probminhash.SMALL_BUCKET)]
    words = [f"w{j:02}" for j in range(94)]  # 90 shingles, of which the next text has 80 and 10 of its own; all of one length, so all weigh alike
    texts += [" ".join(words), " ".join(words[:84] + [f"x{j:02}" for j in range(10)]), " ".join(words[:83] + [f"y{j:02}" for j in range(11)])]
    signed = rng.integers(0, 1 << 16, (len(texts), probminhash.REGISTERS)).astype("<u2")
    signed[:, : probminhash.ROWS_A_BAND] = 7
    rows = [(5, 0, 0, 0, 0, i, i, s.tobytes(), t) for i, (s, t) in enumerate(zip(signed, texts, strict=True))]
    names = ["bucket", "band", "left", "right", "block", "id", "label", "signature", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    n = probminhash.SMALL_BUCKET
    # 80 of 100 shingles are shared: just similar. With one word less, 79 of 101 are: not similar.
    assert [r for out in probminhash._links(iter([batch])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)] == [(n, n + 1)]


def test_shingles_weigh_their_bytes(make):
    """Long words that are common or not decide where the number of shingles alone would not."""
    long, short = [f"{'long' * 9}{i}" for i in range(60)], [f"s{i}" for i in range(60)]
    rows = [(1, " ".join(long + short)), (2, " ".join(long + [f"{x}z" for x in short[:30]])), (3, " ".join(short + long[:44])), (4, " ".join(short + [x[::-1] for x in long[:16]]))]
    plain = [brute.shingles(t) for _, t in rows]
    assert len(plain[0] & plain[1]) < 0.8 * len(plain[0] | plain[1]) and len(plain[2] & plain[3]) > 0.7 * len(plain[3])
    expected = brute.near(rows)
    assert expected == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.class_id for r in probminhash.classes(make(rows)).collect()} == expected


def test_near_duplicates_with_unequal_repeat_counts(make):
    """Pairs of equal shingle sets, of which one text repeats a tenth 10,000 times: nothing but the sets counts."""
    rows = []
    for i in range(12):
        cycle, rest = [f"c{i}x{j}" for j in range(10)], [f"r{i}x{j}" for j in range(90)]
        rows += [(2 * i + n, " ".join(cycle * times + rest)) for n, times in enumerate((2, 10_000))]
    assert brute.near(rows) == {d: d // 2 * 2 for d, _ in rows}
    assert {r.doc_id: r.class_id for r in probminhash.classes(make(rows)).collect()} == brute.near(rows)


def test_keep_one(make):
    text = " ".join(f"w{i}" for i in range(80))
    docs = make([(4, text), (2, text), (2, text), (3, text + " more"), (9, None), (8, ""), (8, ""), (None, "other words here")])
    out = probminhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "8", "8", "9", "None"]


def test_estimates_follow_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    x, y = pool[:300], pool[100:]
    wx, wy = rng.uniform(0.5, 2, 300), rng.uniform(0.5, 2, 300)
    signed = probminhash.signatures([x, y], [wx, wy], 2048)
    a, b = dict(zip(x.tolist(), wx.tolist(), strict=True)), dict(zip(y.tolist(), wy.tolist(), strict=True))
    every = set(a) | set(b)
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in set(a) & set(b))
    assert abs((signed[0] == signed[1]).mean() - exact) < 0.04


# Empty tables


def test_empty_tables(spark, make):
    docs = make([]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        decontaminate.scan(docs, bench),
        decontaminate.remove(docs, bench, mode="spans"),
        substrings.dedup(docs),
        suffixes.dedup(docs),
        linededup.dedup_documents(docs),
        quality.assess(docs),
        quality.filter_documents(docs),
        probminhash.classes(docs),
        probminhash.keep_one(docs),
    ):
        assert out.count() == 0
    assert decontaminate.scan(make([(1, "a b")]), bench).collect()[0]["items"] == []


CLASHING = [*(f"{p}{c}" for p in ("", "__line_", "__line_own_", "__near_", "__near_own_", "__quality_", "c", "x") for c in ("k", "t", "u", "h", "n", "row", "dropped", "n_dropped", "host", "words", "base_failed")), "a.b", "a b", "signature", "id", "label", "pos", "word", "bits", "last", "source.x", "found"]


def test_columns_of_any_name_come_through(make, corpus, items, spark):
    plain = make(corpus).select("doc_id", "text", "source")
    docs = plain.withColumns({c: F.concat(F.lit(c), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for stage in (linededup.dedup_documents, probminhash.keep_one, quality.filter_documents, lambda d: decontaminate.remove(d, bench)):
        got, without = stage(docs), stage(plain)
        assert got.columns == docs.columns
        rows = got.collect()
        assert sorted(((r["doc_id"], r["text"] or "") for r in rows)) == sorted((r["doc_id"], r["text"] or "") for r in without.collect())
        assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHING)
