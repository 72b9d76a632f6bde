"""Quality rules with host verdicts, in DataFrame expressions only.

Each document is measured by itself. Its base failure is then counted per host
(column ``source``), and a host's failure rate is shrunk towards the corpus with a
beta prior fitted to the hosts by the method of moments. The limit follows the prior: a host whose
shrunken rate lies more than ``HOST_EXCESS`` of the way from the corpus rate to 1
rejects all its documents.

Counts are summed per host and task before they are shuffled, so a hot host costs
no more than another; verdicts go back by a join with the rejected hosts alone,
whose table is written first so that Spark knows its size and broadcasts it only if small.

Defined results: a null or empty text has no words and fails; a null host is no
host: its documents count for none and get no host verdict; equal rows count and are
returned each by itself; an empty table gives no rows and no prior; other columns, whatever their
names, are ignored by ``assess`` and returned untouched by ``filter_documents``. A very long
text is measured in its row, in arrays as long as its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, Workspace, numbered, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_EXCESS = 0.5
P = "__quality_"


def window_keys(words: Column) -> Column:
    """A hash of each 3-word window; they repeat where the windows do."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``docs``' columns ``keep`` and the measures, named with the prefix ``__quality_``.

    Windows that repeat are counted first (a hash set); only texts that have any sort
    (hash, position) pairs, in which equal neighbours are the repeats.
    """
    words = F.filter(F.split(text_or_empty(text), f"{WS_CLASS}+"), lambda w: w != "")
    a = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias(f"{P}text"), words.alias(f"{P}words"))
    w = F.col(f"{P}words")
    symbols = F.length(F.regexp_replace(f"{P}text", "[^#*$%&|<>]+", ""))
    lines = F.filter(F.split(f"{P}text", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    b = a.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size(w).cast("long").alias(f"{P}n_words"),
        F.length(F.array_join(w, "")).cast("long").alias(f"{P}word_chars"),
        symbols.cast("long").alias(f"{P}n_symbols"),
        lines.alias(f"{P}lines"),
        window_keys(w).alias(f"{P}windows"),
    )
    win, ln = F.col(f"{P}windows"), F.col(f"{P}lines")
    c = b.select(
        *[F.col(f"`{x}`") for x in keep],
        *[F.col(f"{P}{x}") for x in ("n_words", "word_chars", "n_symbols")],
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias(f"{P}n_dup_lines"),
        F.when(
            F.size(F.array_distinct(win)) < F.size(win),
            F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias(f"{P}sorted"),
    )
    s = F.col(f"{P}sorted")
    equal = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    inside = F.size(F.array_distinct(F.flatten(F.transform(equal, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    d = c.select(
        *[F.col(f"`{x}`") for x in keep],
        *[F.col(f"{P}{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        F.when(s.isNull(), F.lit(0)).otherwise(inside).cast("long").alias(f"{P}n_repeat_words"),
    )
    failed = (F.col(f"{P}n_words") < MIN_WORDS) | (100 * F.col(f"{P}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{P}n_words"))
    return d.withColumn(f"{P}base_failed", failed)


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host its documents, failures, shrunken failure rate and the rate above which it is rejected.

    The prior is a beta distribution with the corpus rate m as its mean. Its strength k comes from the
    hosts' spread beyond what sampling alone would give (moments of the beta-binomial):
    rho = (S - m (1 - m) (H - 1)) / (m (1 - m) (N - Q / N - (H - 1))), k = 1 / rho - 1, with H hosts, N documents,
    Q the sum of squared sizes and S the sum of size * (raw rate - m)^2; rho is bounded to [1e-6, 0.5].
    The shrunken rate is (failures + k m) / (documents + k), the limit m + ``HOST_EXCESS`` (1 - m).
    """
    hosts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    f, n = F.col("failures").cast("double"), F.col("n").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("total"), F.sum(n * n).alias("squares"), F.sum(f).alias("failed"), F.sum(f * f / n).alias("raw"))
    m, spare = F.col("m"), F.col("hosts") - 1
    within = m * (1 - m)
    freedom = within * (F.col("total") - F.col("squares") / F.col("total") - spare)
    rho = F.when(freedom > 0, (F.col("raw") - F.col("total") * m * m - within * spare) / freedom).otherwise(F.lit(0.0))
    prior = sums.withColumn("m", F.col("failed") / F.col("total")).select("m", F.least(F.lit(0.5), F.greatest(F.lit(1e-6), rho)).alias("rho")).select("m", (1 / F.col("rho") - 1).alias("k"))
    shrunken = (F.col("failures") + F.col("k") * m) / (F.col("n") + F.col("k"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failures", shrunken.alias("rate"), m.alias("corpus_rate"))


def rejected_hosts(rows: DataFrame, host_excess: float, source: str = "source") -> DataFrame:
    m = F.col("corpus_rate")
    return host_rates(rows, source, f"{P}base_failed").where(F.col("rate") > m + host_excess * (1 - m)).select("host")


def assess(docs: DataFrame, host_excess: float = HOST_EXCESS) -> DataFrame:
    """doc_id, the measures, base_failed, the host's verdict and ``kept``, one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    ws = Workspace(docs.sparkSession)
    rows = ws.keep(measures(rows, ["doc_id", "source"]), "measures")
    bad = ws.keep(rejected_hosts(rows, host_excess), "hosts").withColumn("host_failed", F.lit(True))
    out = rows.join(bad, rows["source"] == bad["host"], "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *[F.col(f"{P}{x}").alias(x) for x in names], "host_failed", (~F.col(f"{P}base_failed") & ~F.col("host_failed")).alias("kept"))


def filter_documents(docs: DataFrame, host_excess: float = HOST_EXCESS) -> DataFrame:
    """``docs`` with their own columns, without the documents that the base rules or their host reject."""
    ws = Workspace(docs.sparkSession)
    own, names = numbered(docs)
    rows = ws.keep(measures(own, own.columns, names["text"]), "measures")
    bad = ws.keep(rejected_hosts(rows, host_excess, names["source"]), "hosts")
    kept = rows.where(~F.col(f"{P}base_failed"))
    return kept.join(bad, kept[names["source"]] == bad["host"], "left_anti").select(*own.columns).toDF(*docs.columns)
