"""Whitening, token counts and spelling variants."""

import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import queries, spelling, tokencount, whiten

# Whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, deviation string, whitened int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "d", 3) for i, v in rows], VECTORS)


def _plain(vectors):
    """x, sums, variances and components of float vectors by numpy alone."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, x.sum(axis=0), values[::-1], axes.T[::-1]


def _rows(count=700, d=12, seed=3):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(count, d)) @ (rnd.normal(size=(d, d)) * np.linspace(3, 0.1, d))).astype(np.float32).tolist()


def test_whitening_equals_numpy(spark, tmp_path):
    vectors = _rows()
    bad = [None, [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11]
    rows = [*enumerate(vectors), *((1000 + i, v) for i, v in enumerate(bad)), (None, vectors[0]), (5, vectors[5])]
    _table(spark, rows).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitening(spark, str(tmp_path)).collect()
    x, sums, values, axes = _plain([*vectors, vectors[0], vectors[5]])
    assert len(got) == 8 * len(x) and {r.n for r in got} == {len(x)}
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    assert len(by_id[5, 1]) == 2 and len(by_id[None, 8]) == 1
    made = np.array([[by_id[i, c][0].whitened for c in range(1, 9)] for i in range(len(vectors))])
    expected = (x[: len(vectors)] - sums / len(x)) @ axes[:8].T / np.sqrt(values[:8])
    sign = np.sign((made * expected).sum(axis=0))
    assert np.allclose(made, expected * sign, atol=1e-9)
    for i in range(len(vectors)):
        row = by_id[i, 3][0]
        assert row.deviation == sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert abs(row.explained - values[2] / values.sum()) < 1e-12
    whole = np.array([r.whitened for r in sorted(got, key=lambda r: r.component)]).reshape(8, -1)
    gap = np.abs(np.cov(whole, bias=True) - np.eye(8)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9 and gap < 1e-9


def test_states_merge_in_any_order():
    x = np.random.default_rng(1).integers(-(10**6), 10**6, (500, 5)) + 10**9
    whole = whiten.block_moments(x)
    cuts = [0, 1, 2, 90, 91, 400, 500]
    parts = [whiten.block_moments(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    random.Random(2).shuffle(parts)
    while len(parts) > 1:
        parts.append(parts.pop(0).merge(parts.pop(0)))
    assert parts[0].n == 500 and parts[0].sums == whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].mean, x.mean(axis=0), rtol=1e-15) and np.allclose(parts[0].scatter, whole.scatter, rtol=1e-12)


def test_whitening_of_odd_tables(spark):
    empty = whiten.whiten(_table(spark, []))
    assert empty.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert whiten.whiten(_table(spark, [(1, None), (2, [None])])).count() == 0
    one = whiten.whiten(_table(spark, [(1, [1.0, 2.0])]), components=8).collect()
    assert [(r.n, r.whitened, r.explained, r.identity_error) for r in one] == [(1, [None, None], [None, None], None)]
    # lengths apart, one dimension without variance, an empty vector
    mixed = whiten.whiten(_table(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [7.0]), (4, [8.0]), (5, [])])).collect()
    got = {r.vec_id: (r.n, [w if w is None else round(w, 9) for w in r.whitened]) for r in mixed}
    assert got == {1: (2, [-1.0, None]), 2: (2, [1.0, None]), 3: (2, [-1.0]), 4: (2, [1.0]), 5: (1, [])}


def test_deviation_beyond_a_long_is_null(spark):
    rows = _table(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])]).select("vec_id", whiten.grid("embedding", 1024, 100_000).alias("x"))
    got = {r.vec_id: r for r in whiten.whiten(rows, "x").collect()}
    assert got[1].deviation is None and got[1].identity_error < 1e-4
    big = [(i, [float(i * 4000)]) for i in range(2000)]
    rows = _table(spark, big).select("vec_id", whiten.grid("embedding", 1024, 0).alias("x"))
    total = sum(4096000 * i for i in range(2000))
    for r in whiten.whiten(rows, "x").collect():
        exact = (2000 * 4096000 * r.vec_id - total) ** 2
        assert r.deviation == (exact if exact < 1 << 63 else None)


# Token counts


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencount.vocabulary_path())


@pytest.fixture(scope="module")
def counter():
    path = tokencount.vocabulary_path()
    return tokencount.Counter(path, tokencount.prove(path))


ODD = ["", " ", "\n", "▁", " \n ", "a  \n\n  b", "▁▁x ▁", "<s> a</s><unk><0x0A>", "a\0b", "\r\n\t x", "ﬁ Ⅳ é é", "日本語 テキスト。", "привет, мир", "مرحبا بالعالم", "👩‍👩‍👧 ok", "x" * 5000, "ab" * 9000 + "é" * 20000, "  " * 3000 + "end", "def f(x):\n    return x\n", "﻿​ 　 z"]


def test_counts_equal_the_library(counter, library, corpus):
    for text in [*ODD, *(t or "" for _, t in corpus)]:
        assert counter.count(text) == len(library.encode(text)), text[:60]
    assert counter.shortcuts > counter.merged


def test_counts_of_random_texts(counter, library):
    rnd = random.Random(5)
    letters = "abehlost \n▁'.,-0123é日я\t \U0001f600" + " " * 8
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(4000)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_every_code_point(counter, library):
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}\n{chr(c)}c" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_slices_and_long_pre_tokens(monkeypatch, library):
    path = tokencount.vocabulary_path()
    monkeypatch.setattr(tokencount, "SLICE_CHARS", 50)
    monkeypatch.setattr(tokencount, "LONG", 40)
    monkeypatch.setattr(tokencount, "MEMO", 20)
    own = tokencount.Counter(path, tokencount.prove(path))
    rnd = random.Random(6)
    for text in [*ODD, *("".join(rnd.choice("thes ing日本é\n") for _ in range(900)) for _ in range(60))]:
        assert own.count(text) == len(library.encode(text)), text[:60]


def test_proven_strings_are_one_token(library):
    proof = tokencount.prove()
    assert 25_000 < len(proof.single) <= library.vocab_size()
    for s in random.Random(8).sample(sorted(proof.single), 500):
        assert len(library.encode("\n" + s)) == 3
    assert " hello" not in proof.single and " the" in proof.single


def test_token_counts_of_a_table(spark, make, corpus, library, tmp_path):
    rows = [*corpus, (None, "one two"), (3, "again"), (3, "again"), (900, "long words here " * 5000)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_token_counts(spark, str(tmp_path)).fillna(-1, "doc_id").collect())
    counts = [len(library.encode(t or "")) for _, t in rows]
    assert got == sorted((-1 if d is None else d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(rows, counts, strict=True))
    assert tokencount.count_tokens(make([])).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(tokencount.vocabulary_path(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.pieces[5000].piece = "a▁b"
    (tmp_path / "x.model").write_bytes(spec.SerializeToString())
    with pytest.raises(tokencount.VocabularyError):
        tokencount.prove(str(tmp_path / "x.model"))


# Spelling variants


def _words(rnd, letters, count, most):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, most))) for _ in range(count)})


@pytest.mark.parametrize(("letters", "count", "most"), [("ab", 60, 6), ("abc", 150, 6), ("abcdefgh", 200, 4), ("a", 9, 9), ("aé", 40, 7)])
def test_trie_pairs(letters, count, most):
    for seed in range(6):
        words = _words(random.Random(seed), letters, count, most)
        got = [(words[i], words[j]) for i, j in spelling.trie_pairs(words, 0)]
        assert len(got) == len(set(got)) and set(got) == brute.near_words(words)
    assert list(spelling.trie_pairs([], 0)) == [] and list(spelling.trie_pairs(["x"], 0)) == []


def test_long_words_in_a_trie():
    words = sorted(["x" * 3000, "x" * 2999, "x" * 2998 + "y", "x" * 1500 + "y" + "x" * 1499, "y" + "x" * 2999])
    got = {(words[i], words[j]) for i, j in spelling.trie_pairs(words, 0)}
    assert got == brute.near_words(words)


@pytest.mark.parametrize(("shard", "least"), [(2000, 4), (1, 4), (3, 4), (3, 2), (5, 3)])
def test_near_words_whatever_the_shard(spark, shard, least):
    rnd = random.Random(shard + least)
    words = [w for w in _words(rnd, "abc", 260, 8) + _words(rnd, "é", 30, 30) + ["aaaa" + w for w in _words(rnd, "ab", 40, 5)] if len(w) >= least]
    words = sorted(set(words))
    table = spark.createDataFrame([(w, i + 1, "k", 1, 2) for i, w in enumerate(words)], "word string, n long, key string, side int, skip int").select("word", "n")
    got = [tuple(r) for r in spelling.near_words(table, least, shard).collect()]
    n = {w: i + 1 for i, w in enumerate(words)}
    assert len(got) == len(set(got)) and set(got) == {(a, n[a], b, n[b]) for a, b in brute.near_words(words)}


def _misspelt(seed=4):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéß÷") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    texts = []
    for i in range(900):
        words = []
        for _ in range(30):
            w = base[min(int(rnd.expovariate(0.12)), 59)]
            if rnd.random() < 0.3:
                at, c = rnd.randrange(len(w)), rnd.choice("ab")
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.capitalize() if rnd.random() < 0.1 else w)
        texts.append((i, rnd.choice([" ", "-", "1", "\n"]).join(words)))
    return texts


@pytest.mark.parametrize("shard", [2000, 4])
def test_variants_equal_brute_force(spark, make, shard):
    rows = [*_misspelt(), (None, "ABCDEF abcdef " * 3), (None, None), (7, ""), (7, "abcdef abcdeg"), (8, "ÀÀÀÀÀÀÀ " * 6), (9, "x" * 3000 + " " + "Longer " * 50_000)]
    rows += [(20_000, "coloured " * 1000 + "colored " * 150 + "colore " * 20)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(make(rows), misspell=199, shard=shard).collect()}
    expected = brute.spelling(brute.vocabulary(rows))
    assert got == expected
    assert expected["colore"][:2] == ("colored", "coloured")


def test_slices_end_between_runs(monkeypatch, spark, make):
    monkeypatch.setattr(spelling, "SLICE_CHARS", 7)
    assert [("abcdefghij kl mn"[a:b]) for a, b in spelling._slices("abcdefghij kl mn")] == ["abcdefghij", " kl mn"]


def test_no_words(spark, make):
    assert spelling.variants(make([])).count() == 0
    assert spelling.variants(make([(1, None), (2, "short rare words")])).count() == 0
    assert spelling.variants(make([(1, "lonely " * 9)])).collect()[0].asDict() == {"word": "lonely", "form": None, "root": "lonely", "n": 9, "n_near": 0, "form_n": None}


def test_words_of_one_letter_are_refused(spark):
    with pytest.raises(ValueError, match="two code points"):
        spelling.near_words(spark.createDataFrame([], "word string, n long"), 1)


def test_variants_equal_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    from tidewatch.llm.oracle import ORACLE

    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = queries.op13_spelling_variants(spark, small).orderBy("word").toPandas()
    expected = duckdb.execute(ORACLE["op13_spelling_variants"]).df().sort_values("word")
    plain = lambda f: [tuple(None if pd.isna(x) else x for x in r) for r in f[sorted(f.columns)].itertuples(index=False)]
    assert len(got) and plain(got) == plain(expected)
    assert got["n"].sum() == spelling.vocabulary(spark.read.parquet(f"{small}/documents.parquet"), misspell=199).agg(F.sum("n")).first()[0]
