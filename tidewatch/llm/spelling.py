r"""Spelling variants: words at edit distance one, by a self-join of the vocabulary's trie with active-node sets.

The trie is dealt over tasks by prefix. A word has at least 2h code points, so two words at distance one share their
first h or their last h: each word goes to the trie of its beginning and, reversed, to that of its end, and
the second one leaves out pairs that the first one has. In a task's trie the set of active nodes of a node, those
at distance one from it, follows from its parent's: active nodes move on by the same letter, and the parent, the
siblings and the children become active. A terminal node with terminal active nodes gives pairs.
Where a single word is left below a node, its active nodes move on by the word's whole rest.

A prefix with over ``SHARD`` words is hot, and its trie isn't one task's: deeper prefixes are, and pairs that part at the
hot node itself meet by that node and the rest that they share behind the letter inserted or replaced, in groups no
larger than the alphabet. So no group grows with the table, and no pair is lost.

Counting goes first: runs of letters are counted in each task, in a table of bounded size, before they are shuffled.

Defined results: null and empty texts have no words; a null id is the empty string in what is hashed; repeated rows count as often
as they come; of near words with equal counts the first in code-point order is a word's form; an empty table, or one whose words
are all rarer or shorter, gives no rows; other columns, whatever their names, are ignored. Very long texts are read in
slices of about a million code points that end between runs; a run of letters is read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .common import Workspace, partitions_for

RUN, GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
SLICE_CHARS = 1 << 20
#: Different words that a task counts before it passes them on.
TABLE_WORDS = 200_000
#: Words in one task's trie.
SHARD = 2000
EMIT = 20_000


def _slices(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE_CHARS)
        end = gap.start() if gap else len(text)
        yield at, end
        at = end


def runs(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """word and n: the runs of letters, A-Z lower-cased, counted within tasks (a word comes from several).

    ``misspell``: where it divides the crc32 of ``<doc_id>:<run>``, the run's code point at that crc32 modulo the length is deleted.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in B.slices(batch.column(1)):
                for i, (a, b) in enumerate(zip(piece.offsets, piece.offsets[1:], strict=False)):
                    text = piece.buf[a:b].tobytes().translate(B.LOWER).decode()
                    seed = zlib.crc32(f"{'' if ids[piece.lo + i] is None else ids[piece.lo + i]}:".encode())
                    for lo, hi in _slices(text):
                        found = Counter(RUN.findall(text, lo, hi))
                        if misspell:
                            for word in [w for w in found if zlib.crc32(w.encode(), seed) % misspell == 0]:
                                at = zlib.crc32(word.encode(), seed) % len(word)
                                counts[word[:at] + word[at + 1 :]] += found.pop(word)
                        counts.update(found)
                    if len(counts) > TABLE_WORDS:
                        yield flush()
        if counts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "word string, n long")


def vocabulary(docs: DataFrame, *, least_chars: int = 6, least_n: int = 5, misspell: int | None = None) -> DataFrame:
    """word and n: words of at least so many code points that occur so often."""
    counted = runs(docs, misspell).where(F.length("word") >= least_chars)
    # a task passes on a word once in a table's worth of different words, so rows are about the text's at most
    dealt = counted.repartition(partitions_for(docs), "word")
    return dealt.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def trie_pairs(words: list[str], skip: int) -> Iterator[tuple[int, int]]:
    """Both orders of each pair of places in ``words`` (sorted, different, the same first ``skip`` code points) at distance one.

    A node is (lo, hi, depth): the words from lo to hi, which share their first ``depth`` code points.
    """
    below: dict[tuple[int, int, int], dict[str, tuple[int, int, int]]] = {}

    def children(node: tuple[int, int, int]) -> dict[str, tuple[int, int, int]]:
        if (found := below.get(node)) is None:
            lo, hi, d = node
            i, found = lo + (len(words[lo]) == d), {}
            while i < hi:
                c = words[i][d]
                # the words that go on with this letter: up to the first that is not
                j = i + 1 if i + 1 == hi or words[i + 1][d] != c else bisect_right(words, c, i + 1, hi, key=lambda w: w[d])
                found[c] = (i, j, d + 1)
                i = j
            below[node] = found
        return found

    if not words:
        return
    root = (0, len(words), skip)
    stack: list[tuple[tuple[int, int, int], set[tuple[int, int, int]]]] = [(root, set(children(root).values()) if len(words) > 1 else set())]
    while stack:
        node, active = stack.pop()
        lo, hi, d = node
        if hi - lo == 1:
            rest = words[lo][d:]
            for a, b, depth in active:
                if b - a == 1:
                    if len(words[a]) - depth == len(rest) and words[a].endswith(rest):
                        yield lo, a
                else:
                    other = words[a][:depth] + rest
                    at = bisect_left(words, other, a, b)
                    if at < b and words[at] == other:
                        yield lo, at
            continue
        if len(words[lo]) == d:
            for a, _, depth in active:
                if len(words[a]) == depth:
                    yield lo, a
        own = children(node)
        for c, child in own.items():
            reached = {node, *(m for x, m in own.items() if x != c)}
            if child[1] - child[0] > 1:  # else the child's only word is what it would reach
                reached.update(children(child).values())
            for m in active:
                if (on := children(m).get(c)) is not None:
                    reached.add(on)
            stack.append((child, reached))


def _group_pairs(kind: int, members: list[tuple[str, int]], skip: int) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """kind 0: a trie's words; 1: words that part at one node (the code point at ``skip``) and go on alike."""
    members.sort()
    if kind == 0:
        for i, j in trie_pairs([w for w, _ in members], skip):
            yield members[i], members[j]
        return
    for x, other in enumerate(members):
        for y, own in enumerate(members):
            # equal lengths: a letter replaced; else one inserted here, and not rather further on
            if x != y and (len(own[0]) == len(other[0]) or own[0][skip : skip + 1] != other[0][skip : skip + 1]):
                yield own, other


def near_words(words: DataFrame, least_chars: int = 6, shard: int = SHARD) -> DataFrame:
    """word, n, near and near_n: both orders of each pair at distance one. ``words``: word and n, each of at least ``least_chars`` code points, each once."""
    half = max(1, least_chars // 2)
    if least_chars < 2:
        raise ValueError("words need two code points, one for each end")
    sides = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("x"), "n").select("x.*", "n")
    head = lambda d: F.substring("s", 1, d)
    hot = sides.groupBy("side", head(half).alias("p")).agg(F.count("*").alias("c")).where(F.col("c") > shard).select("side", "p")
    hot = Workspace(words.sparkSession).keep(hot, "hot")
    if hot.isEmpty():
        units = sides.select("side", F.lit(0).alias("kind"), F.lit(half).alias("skip"), head(half).alias("key"), "s", "n")
    else:
        marked = sides.withColumn("p", head(half)).join(hot.withColumn("h", F.lit(True)), ["side", "p"], "left").drop("p")
        calm = marked.where("h is null").select("side", F.lit(0).alias("kind"), F.lit(half).alias("skip"), head(half).alias("key"), "s", "n")
        below = marked.where("h").drop("h")
        # Deeper prefixes of words with a hot one, by hash: the first that isn't hot, one code point past the last that is.
        depth = below.select("side", "s", F.explode(F.sequence(F.lit(half), F.length("s"))).alias("d"))
        depth = depth.select("side", "d", F.xxhash64(F.substring("s", F.lit(1), F.col("d"))).alias("g"), "s")
        crowded = depth.groupBy("side", "d", "g").agg(F.count("*").alias("c")).where(F.col("c") > shard).select("side", "d", "g", F.lit(True).alias("h"))
        first = depth.join(crowded, ["side", "d", "g"], "left").groupBy("side", "s").agg(F.min(F.when(F.col("h").isNull(), F.col("d"))).alias("calm"))
        # A word that is itself a hot prefix has no calm one: it is alone in its trie, under an end mark.
        deep = below.join(first, ["side", "s"]).withColumn("at", F.coalesce("calm", F.length("s") + 1))
        tries = deep.select("side", F.lit(0).alias("kind"), F.col("at").alias("skip"), F.when(F.col("calm").isNull(), F.concat("s", F.lit("\0"))).otherwise(F.substring("s", F.lit(1), F.col("at"))).alias("key"), "s", "n")
        nodes = deep.select("side", "s", "n", F.explode(F.sequence(F.lit(half), F.col("at") - 1)).alias("skip"))
        rest = lambda skipped: F.substring("s", F.col("skip") + 1 + skipped, F.length("s"))
        forms = F.array(rest(0), F.when(F.length("s") > F.col("skip"), rest(1)))
        parted = nodes.select("side", F.lit(1).alias("kind"), "skip", F.explode(forms).alias("rest"), "s", "n").where("rest is not null")
        parted = parted.select("side", "kind", "skip", F.concat(F.substring("s", F.lit(1), F.col("skip")), F.lit("\0"), "rest").alias("key"), "s", "n")
        units = calm.unionByName(tries).unionByName(parted)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []
        last, members = None, []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "n", "near", "near_n"])

        def close() -> Iterator[pa.RecordBatch]:
            side, kind, skip, _ = last
            for (own, n), (near, near_n) in _group_pairs(kind, members, skip):
                if side:
                    own, near = own[::-1], near[::-1]
                    if own[:half] == near[:half]:
                        continue
                out.append((own, n, near, near_n))
                if len(out) >= EMIT:
                    yield flush()

        for batch in batches:
            for side, kind, skip, key, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (side, kind, skip, key) != last:
                    if members:
                        yield from close()
                    last, members = (side, kind, skip, key), []
                members.append((s, n))
        if members:
            yield from close()
        if out:
            yield flush()

    order = ["side", "kind", "skip", "key"]
    dealt = units.repartition(partitions_for(words), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(each, "word string, n long, near string, near_n long")


def variants(docs: DataFrame, *, least_chars: int = 6, least_n: int = 5, ratio: int = 5, misspell: int | None = None, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n for the words of ``docs``.

    A word's form is its commonest near word, if that occurs ``ratio`` (2 or more) times as often as the word; its root is reached from form to form.
    """
    if ratio < 2:
        raise ValueError("forms must be commoner than their words, or they have no root")
    space = Workspace(docs.sparkSession)
    words = space.keep(vocabulary(docs, least_chars=least_chars, least_n=least_n, misspell=misspell), "words")
    best = near_words(words, least_chars, shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.near")).alias("form"), (-F.col("best.m")).alias("m"))
    found = space.keep(found.select("word", "form", "n", "n_near", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n")), "forms")
    # Counts grow by the ratio from form to form, so the longest way is known; each round doubles the steps taken.
    most = found.where("form is not null").agg(F.max("form_n")).first()[0]
    steps = math.floor(math.log(most / least_n, ratio) + 1e-9) if most else 0
    root = found.where("form is not null").select("word", F.col("form").alias("root"))
    for i in range(max(0, math.ceil(math.log2(max(1, steps))))):
        on = root.select(F.col("word").alias("at"), F.col("root").alias("next"))
        root = space.keep(root.join(on, root["root"] == on["at"], "left").select("word", F.coalesce("next", "root").alias("root")), f"roots_{i}")
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
