"""SQL-injection rules over query texts. Rules are column expressions; only decoding needs Python, in Arrow batches."""

from __future__ import annotations

import base64
import re
import urllib.parse
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import ordered
from . import sqltokens as K
from .sqltokens import KEYWORDS

# Patterns, matched without regard to case.
CRITICAL = [
    r"OR 1=1", r"OR '1'='1'", r"--", r"#", r"UNION SELECT", r"; DROP", r"xp_cmdshell", r"WAITFOR DELAY",
    r"OR \d+=\d+", r"OR ['\"].*?['\"]=['\"].*?['\"]", r"UNION ALL SELECT", r"@@version", r"sys\.databases", r"information_schema\.",
    r"CAST\s*\(", r"EXEC\s*\(", r"sp_executesql", r"BULK INSERT", r"INTO OUTFILE", r"INTO DUMPFILE", r"LOAD_FILE", r"BENCHMARK\s*\(",
    r"SLEEP\s*\(", r"PG_SLEEP\s*\(", r"DBMS_PIPE\.RECEIVE_MESSAGE", r"OR true", r"OR 1", r"';\s*--", r"\)\s*when\s*\d+\s*then",
    r"admin'\s*--", r"'\s*or\s*'x'='x", r"'\s*or\s*0=0\s*--", r"'\s*or\s*0=0\s*#", r"'\s*GROUP BY\s*[a-z0-9]+\s*HAVING\s*\d+=\d+",
    r"ORDER BY\s+\d+", r"HAVING\s+\d+=\d+",
]
SECONDARY = [
    r"OR 1>", r"LIKE '%", r"; ALTER", r"ORDER BY \d+", r"GROUP BY .* HAVING", r"SELECT\s+@@", r"SUBSTRING\s*\(", r"CONCAT\s*\(",
    r"CONVERT\s*\(", r"AND\s+\d+", r"CASE\s+WHEN", r"IF\s*\(", r"CHAR\s*\(", r"ASCII\s*\(", r"UPDATE.+SET", r"DELETE.+FROM",
    r"INSERT.+INTO", r"REPLACE.+INTO", r"LIMIT\s+\d+\s*,\s*\d+", r"PROCEDURE\s+ANALYSE", r"IS\s+NULL", r"IS\s+NOT\s+NULL",
    r"ISNULL\s*\(", r"COALESCE\s*\(", r"OR\s+\d+", r"SELECT\s+\*", r"TABLE_NAME", r"COLUMN_NAME", r"DATABASE\s*\(\)", r"USER\s*\(\)",
    r"VERSION\s*\(\)", r"\|\|", r"AND\s+\('.*?'\s*=\s*'.*?'\)", r"XOR", r"RLIKE", r"REGEXP", r"&&",
]
RECON = [
    r"information_schema\.", r"sys\.", r"pg_catalog\.", r"sqlite_master", r"@@version", r"version\(\)", r"sqlite_version\(\)",
    r"sys\.configurations", r"'--", r'"--', r"' OR '1'='1",
]
# Kind of attack, and texts of which one is in the decoded query (the first kind that fits); weights of complexity.
ATTACKS = [
    ("boolean_based", ["or 1=1", "or '1'='1'", "or true"]),
    ("union_based", ["union select", "union all select"]),
    ("time_based", ["waitfor delay", "sleep(", "benchmark(", "pg_sleep("]),
    ("destructive", ["drop table", "drop database", "truncate"]),
    ("command_exec", ["xp_cmdshell", "exec master.dbo"]),
]
LATE_ATTACKS = [("out_of_band", ["into outfile", "into dumpfile"]), ("error_based", ["convert(", "cast("])]
STACKED = ["select", "insert", "update", "delete"]
COMPLEXITY = [("SELECT", 1), ("FROM", 1), ("WHERE", 2), ("JOIN", 3), ("GROUP BY", 3), ("ORDER BY", 2), ("HAVING", 3), ("CASE", 4)]


_META = set(".^$*+?{}[]\\|()")


def needle(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern holds; none for patterns with groups or alternatives."""
    if re.search(r"(?<!\\)[(|]", pattern):
        return ""
    runs, own, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1] in _META | {"-"}:
            own, i = own + pattern[i + 1], i + 2
        elif c in _META:
            if c in "*?" or c == "{":
                own = own[:-1]
            runs.append(own)
            own, i = "", pattern.index("]", i) + 1 if c == "[" else i + 2 if c == "\\" else i + 1
        else:
            own, i = own + c, i + 1
    return max([*runs, own], key=len).lower()


def matches(low: Column, pattern: str) -> Column:
    """Whether a lower-case text has the pattern. Its plain part is looked for first, so texts without it cost no regular expression."""
    plain = needle(pattern)
    if plain == pattern.lower():
        return low.contains(plain)
    regex = low.rlike(pattern.lower())
    return low.contains(plain) & regex if len(plain) > 1 else regex


def with_lower(text: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of the text in lower case, which is made once a text, not for each of its patterns."""
    return F.get(F.transform(F.array(F.lower(text)), rule), F.lit(0))


def _hits(low: Column, patterns: list[str]) -> Column:
    parts = [matches(low, p).cast("int") for p in patterns]
    return sum(parts[1:], parts[0])


def _any_hit(low: Column, patterns: list[str]) -> Column:
    out = matches(low, patterns[0])
    for p in patterns[1:]:
        out = out | matches(low, p)
    return out


def hits(text: Column, patterns: list[str]) -> Column:
    """How many patterns match."""
    return with_lower(text, lambda low: _hits(low, patterns))


def any_hit(text: Column, patterns: list[str]) -> Column:
    return with_lower(text, lambda low: _any_hit(low, patterns))


def odd_quotes(text: Column) -> Column:
    count = lambda q: F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))
    return (count("'") % 2 != 0) | (count('"') % 2 != 0)


def pattern_score(text: Column, more_critical: list[str] = (), more_secondary: list[str] = ()) -> Column:
    """1 for a critical pattern; else .15 for each secondary one up to .9, at least .6 for unbalanced quotes. Null: 0."""
    def score(low: Column) -> Column:
        soft = F.least(F.lit(0.9), _hits(low, [*SECONDARY, *more_secondary]) * 0.15)
        return F.when(_any_hit(low, [*CRITICAL, *more_critical]), 1.0).when(odd_quotes(low), F.greatest(soft, F.lit(0.6))).otherwise(soft)

    return F.when(text.isNull(), 0.0).otherwise(with_lower(text, score))


def attack_type(text: Column) -> Column:
    low = F.lower(text)
    contains = lambda words: F.lower(text).rlike("|".join(re.escape(w) for w in words))
    chain = None
    for name, words in ATTACKS:
        chain = F.when(contains(words), name) if chain is None else chain.when(contains(words), name)
    chain = chain.when(low.contains(";") & contains(STACKED), "stacked_queries")
    for name, words in LATE_ATTACKS:
        chain = chain.when(contains(words), name)
    return chain.otherwise("generic_injection")


def threat_level(score: Column) -> Column:
    return F.when(score >= 0.9, "Critical").when(score >= 0.75, "High").when(score >= 0.6, "Medium").otherwise("Low")


def complexity(text: Column) -> Column:
    flag = lambda p: text.rlike(f"(?i){p}").cast("int")
    count = lambda p: F.regexp_count(text, F.lit(p))
    total = flag(r"\([^()]*SELECT[^()]*\)") * 5
    for word, weight in COMPLEXITY:
        total = total + flag(rf"\b{word}\b") * weight
    return total + 2 * count(r"(?i)\bAND\b|\bOR\b") + 2 * count(r"\b\w+\s*\(") + F.length(text) / F.lit(50.0)


def adaptive_threshold(df: DataFrame, score: str, partition: list[str], order: list[str], base: float = 0.5, history: int = 100) -> DataFrame:
    """A threshold from the last ``history`` scores before each row, once there are more than ten.

    Sorted scores are parted at gaps over .15: with a gap, the middle between the first group's
    largest and the last group's least score; without, mean + 2 deviations; kept in [.4, .8].
    Without a partition the history is the whole table's, in ranges.
    """
    if not partition:
        return ordered.over_ranges(df, order, history, 0, lambda rows, own: adaptive_threshold(rows, score, own, order, base, history))
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-history, -1)
    h = F.col("__h")
    gaps = F.filter(F.sequence(F.lit(1), F.greatest(F.size(h) - 1, F.lit(1))), lambda i: F.get(h, i) - F.get(h, i - 1) > 0.15)
    found_gaps = F.col("__gaps")
    middle = (F.get(h, F.get(found_gaps, F.lit(0)) - 1) + F.get(h, F.get(found_gaps, F.size(found_gaps) - 1))) / 2
    spread = F.col("__mean") + 2 * F.col("__std")
    found = F.when(F.size(found_gaps) > 0, middle).otherwise(spread)
    out = df.withColumns({"__h": F.sort_array(F.collect_list(score).over(frame)), "__mean": F.avg(score).over(frame), "__std": F.stddev_pop(score).over(frame)})
    out = out.withColumn("__gaps", gaps)
    return out.withColumn("threshold", F.when(F.size(h) > 10, F.least(F.lit(0.8), F.greatest(F.lit(0.4), found))).otherwise(base)).drop("__h", "__mean", "__std", "__gaps")


def scanned_value(text: Column) -> Column:
    """The first whole number after WHERE."""
    return F.regexp_extract(text, r"(?is)\bWHERE\b.*?\b(\d+)\b", 1).try_cast("long")


def is_scan(values: Column) -> Column:
    """Three values or more in arithmetic or monotone order."""
    n = F.size(values)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(values, i) - F.get(values, i - 1))
    return (n >= 3) & ((F.array_min(steps) >= 0) | (F.array_max(steps) <= 0))


def escalates(values: Column) -> Column:
    """Of three complexities or more: none before the last falls below .8 of the one before it, and the last is over 1.5 times the first."""
    n = F.size(values)
    steady = F.forall(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (i > n - 2) | (F.get(values, i) >= 0.8 * F.get(values, i - 1)))
    return (n >= 3) & steady & (F.get(values, n - 1) > 1.5 * F.get(values, F.lit(0)))


def context_score(df: DataFrame) -> DataFrame:
    """Up to .6 more for an address that queries fast, scans, escalates or probes: its last ten queries and this one. Rows without an address get 0."""
    by = Window.partitionBy("ip").orderBy("ts", "row_id")
    last = by.rowsBetween(-10, 0)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(by)
    out = df.withColumns({"__value": scanned_value(F.col("query")), "__cx": complexity(F.col("query")), "__probes": hits(F.col("query"), RECON)})
    out = out.withColumn("__gap", gap)
    fast = F.when(F.col("__gap") < 500_000, 1.0).when(F.col("__gap") < 1_000_000, 0.5).otherwise(0.0)
    out = out.withColumns({"__counter": F.sum(fast).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "__recon": F.sum("__probes").over(last), "__values": F.collect_list("__value").over(last), "__cxs": F.collect_list("__cx").over(last)})
    rate = F.when(F.col("__gap") < 500_000, 0.05).when(F.col("__gap") < 1_000_000, 0.02).otherwise(0.0)
    crowd = F.when(F.col("__counter") > 5, F.least(F.lit(0.3), 0.05 * F.col("__counter"))).otherwise(0.0)
    flag = lambda hit, x: F.when(hit, x).otherwise(0.0)
    total = rate + crowd + flag(is_scan(F.col("__values")), 0.15) + flag(escalates(F.col("__cxs")), 0.2) + flag(F.col("__recon") >= 2, 0.25)
    out = out.withColumn("context_score", F.when(F.col("ip").isNull(), 0.0).otherwise(F.least(F.lit(0.6), total)))
    return out.drop("__gap", "__counter", "__recon", "__value", "__values", "__cx", "__cxs", "__probes")


_HEX = re.compile(r"0x((?:[0-9a-fA-F]{2})+)")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_CHAR = re.compile(r"(?i)\bCHAR\((\d{1,3})\)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?(?![A-Za-z0-9+/=])")
_PART = r"(?:'([^']*)'|\"([^\"]*)\")"
#: Joined strings of either quote: with a sign between them, as arguments, or as a method.
_JOINS = [re.compile(p, re.I) for p in (rf"{_PART}\s*(?:\+|\|\|)\s*{_PART}", rf"CONCAT\s*\(\s*{_PART}\s*,\s*{_PART}\s*\)", rf"{_PART}\s*\.\s*concat\s*\(\s*{_PART}\s*\)")]
_KEYWORD = re.compile(r"\b(?:" + "|".join(KEYWORDS) + r")\b", re.I)
_NOTES = re.compile(r"--[^\n]*|#[^\n]*|/\*.*?\*/", re.S)


def _from_base64(match: re.Match) -> str:
    """Only what turns into printable text with a space or sign in it: plain words may look like base64, too."""
    try:
        text = base64.b64decode(match[0], validate=True).decode("ascii")
    except ValueError:
        return match[0]
    return text if text.isprintable() and re.search(r"[^A-Za-z0-9]", text) else match[0]


_LIST = re.compile(rf"\[\s*({_PART}(?:\s*,\s*{_PART})*)\s*\]\s*\.\s*join\s*\(\s*(?:''|\"\")\s*\)", re.I)


def _list_joined(match: re.Match) -> str:
    """A list of quoted parts that is joined by nothing, in single quotes."""
    return "'" + "".join(one or two for one, two in re.findall(_PART, match[1])) + "'"


def _joined(match: re.Match) -> str:
    """Two quoted parts as one, in the first one's quotes."""
    one, other, two, more = match.groups()
    quote = "'" if one is not None else '"'
    return f"{quote}{one if one is not None else other}{two if two is not None else more}{quote}"


def _decoded(text: str) -> str:
    """URL, hex, unicode, base64 and CHAR() codes, comments, white space, joined strings and keywords in any case, until nothing changes.

    As codes are undone until the text stays as it is, codes within codes of another kind are undone too, and so are
    keywords that were broken into quoted letters.
    """
    for _ in range(5):
        before = text
        if "%" in text:
            text = urllib.parse.unquote(text)
        text = _HEX.sub(lambda m: bytes.fromhex(m[1]).decode("latin-1"), text)
        text = _UNICODE.sub(lambda m: chr(int(m[1], 16)), text)
        text = _BASE64.sub(_from_base64, text)
        text = _CHAR.sub(lambda m: f"'{chr(int(m[1]))}'" if int(m[1]) < 128 else m[0], text)
        for _ in range(10):
            joined = _LIST.sub(_list_joined, text)
            for rule in _JOINS:
                joined = rule.sub(_joined, joined)
            if joined == text:
                break
            text = joined
        text = re.sub(r"\s+", " ", _NOTES.sub(" ", text))
        if text == before:
            break
    return _KEYWORD.sub(lambda m: m[0].upper(), text)


@F.pandas_udf(T.StringType())
def decode_udf(texts: pd.Series) -> pd.Series:
    """Texts repeat a lot: each distinct one of a batch is decoded once; nulls stay nulls."""
    known = {t: _decoded(t) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) if isinstance(t, str) else None for t in texts], dtype=object)


def decoded(text: Column) -> Column:
    """The decoded text. Texts without any sign of obfuscation stay as they are: Python gets a null for them and gives it back at once."""
    words = "|".join(KEYWORDS)
    signs = text.rlike(r"%|0x|\\u|(?i:char\()|--|#|/\*|\s\s|['\"]\s*(?:\+|\|\||\.)\s*|(?i:concat)|\]\s*\.\s*(?i:join)|[\t\n]|[A-Za-z0-9+/]{12,}|[A-Za-z0-9+/]{6,}=")
    mixed = (F.upper(text) != text) & text.rlike(rf"\b(?!(?:{words})\b)(?i:{words})\b")
    return F.coalesce(decode_udf(F.when(signs | mixed, text)), text)


def combine(pattern: Column, model: Column, advanced: Column) -> Column:
    """Patterns of .9 and more decide; else an advanced score of .8 and more, mixed with the plain model's; else .6, .2 and .2."""
    return F.when(pattern >= 0.9, pattern).when(advanced >= 0.8, F.greatest(pattern, 0.7 * advanced + 0.3 * model)).otherwise(0.6 * pattern + 0.2 * model + 0.2 * advanced)


def final_threshold(threshold: Column, pattern: Column, text: Column, decoded_text: Column) -> Column:
    """The first rule that fits: .6 at most for patterns of .7 and more, .65 at least below .1, .55 at most for decoded texts, .5 at most for dangerous words."""
    words = F.upper(text).rlike("UNION|DROP|EXEC|WAITFOR")
    return F.when(pattern >= 0.7, F.least(threshold, F.lit(0.6))).when(pattern < 0.1, F.greatest(threshold, F.lit(0.65))).when(text != decoded_text, F.least(threshold, F.lit(0.55))).when(words, F.least(threshold, F.lit(0.5))).otherwise(threshold)


#: Signs of obfuscation in a text, by technique.
TECHNIQUES = {"url": "%[0-9a-fA-F]{2}", "hex": "0x[0-9a-fA-F]{2}", "unicode": r"\\u[0-9a-fA-F]{4}", "base64": "[A-Za-z0-9+/]{6,}=", "comment": r"--|#|/\*", "white space": r"\s\s", "concatenation": r"'\s*(?:\+|\|\|)\s*'|(?i)concat\s*\(", "char codes": r"(?i)char\s*\(", "fragments": r"'\s*\+\s*'[^']+'\s*\+\s*'", "mixed case": r"\b(?!(?:SELECT|UNION|FROM|WHERE)\b)(?i:SELECT|UNION|FROM|WHERE)\b"}


def techniques(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in TECHNIQUES.items()]))


def detect(df: DataFrame, base: float = 0.5, history: list[str] | None = None, tokens: bool = False) -> DataFrame:
    """Scores, threshold, labels, attack type, threat level and techniques for (row_id, ts, ip, query).

    Columns ml_score and advanced_score count where they are there (``models.TextModels.score`` adds them). ``history``: what a
    threshold's history is kept by (["ip"]; [] is one history of all rows). ``tokens``: findings among a text's tokens raise its pattern score to .8.
    """
    rows = df.withColumn("decoded", decoded(F.col("query")))
    score = F.greatest(pattern_score(F.col("query")), pattern_score(F.col("decoded")))
    if tokens:
        rows = rows.withColumn("__tokens", K.tokens(F.col("decoded"))).withColumn("token_findings", K.findings(F.col("__tokens"))).drop("__tokens")
        score = F.when(F.size("token_findings") > 0, F.greatest(score, F.lit(0.8))).otherwise(score)
    rows = context_score(rows.withColumn("pattern_score", score))
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    model, advanced = part("ml_score"), part("advanced_score")
    rows = rows.withColumn("anomaly_score", F.least(F.lit(1.0), combine(F.col("pattern_score"), model, advanced) + F.col("context_score")))
    rows = adaptive_threshold(rows, "anomaly_score", ["ip"] if history is None else history, ["ts", "row_id"], base)
    rows = rows.withColumn("threshold", final_threshold(F.col("threshold"), F.col("pattern_score"), F.col("query"), F.col("decoded")))
    rows = rows.withColumn("predicted_anomaly", F.coalesce((F.col("anomaly_score") >= F.col("threshold")).cast("int"), F.lit(0)))
    hit = F.col("predicted_anomaly") == 1
    changed = hit & (F.col("decoded") != F.col("query"))
    return rows.withColumns(
        {
            "attack_type": F.when(hit, attack_type(F.col("decoded"))),
            "threat_level": F.when(hit, threat_level(F.col("anomaly_score"))),
            "detected_by": F.when(hit, sources(F.col("pattern_score"), model, advanced, F.col("context_score"), F.col("threshold"))),
            "obfuscation_details": F.when(changed, F.struct(techniques(F.col("query")).alias("techniques"), F.col("query").alias("original"), F.col("decoded").alias("deobfuscated"))),
        }
    )


#: What to do about an attack, by kind.
ADVICE = {
    "boolean_based": "Bind parameters; never build conditions out of user input.",
    "union_based": "Validate input strictly and query through a mapper with fixed columns.",
    "time_based": "Give queries a time limit.",
    "error_based": "Keep database errors from users.",
    "destructive": "Take rights to change the schema from the application's account.",
    "command_exec": "Turn shell procedures off in production.",
    "stacked_queries": "Bind parameters and let the driver run one statement at a time.",
    "out_of_band": "Block outgoing connections and file writes of the database server.",
}
DEFAULT_ADVICE = "Bind parameters and validate input."


def recommendation(kind: Column) -> Column:
    return F.when(kind.isNotNull(), F.coalesce(F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])[kind], F.lit(DEFAULT_ADVICE)))


def sources(pattern: Column, model: Column, advanced: Column, context: Column, threshold: Column) -> Column:
    """Which parts of the detector reach the threshold, the context with the best of the others; joined by commas."""
    best = F.greatest(pattern, model, advanced)
    parts = {"pattern": pattern >= threshold, "ml": model >= threshold, "advanced_ml": advanced >= threshold, "context": (context > 0) & (context + best >= threshold)}
    return F.array_join(F.array_compact(F.array(*[F.when(hit, name) for name, hit in parts.items()])), ",")


def similarity(one: Column, two: Column) -> Column:
    """Share of common letter triples of two texts (twice the common ones by the sum of both): 1 for equal texts, linear in their length."""
    triples = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3))))
    a, b = triples(one), triples(two)
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differences(text: Column, decoded_text: Column) -> Column:
    """What was decoded: the techniques found, or, where there is none, how far the texts are apart."""
    found, ratio = techniques(text), similarity(text, decoded_text)
    apart = F.when(ratio < 0.5, "very different").when(ratio < 0.9, "somewhat different").otherwise("almost equal")
    return F.when(text == decoded_text, None).when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(apart)


def detect_and_explain(df: DataFrame, base: float = 0.5) -> DataFrame:
    """``detect`` with explanation and recommendation for flagged rows."""
    rows = detect(df, base)
    hit = F.col("predicted_anomaly") == 1
    matched = F.slice(F.array_compact(F.array(*[F.when(matches(F.lower("decoded"), p), F.lit(p)) for p in CRITICAL + SECONDARY])), 1, 3)
    text = F.concat_ws("\n", F.concat(F.lit("Kind: "), "attack_type"), F.concat(F.lit("Patterns: "), F.array_join(matched, "; ")), F.concat(F.lit("Decoded: "), F.when(F.col("decoded") != F.col("query"), F.col("decoded"))), F.concat(F.lit("Differences: "), F.when(hit, differences(F.col("query"), F.col("decoded")))))
    return rows.withColumns({"explanation": F.when(hit, text), "recommendation": recommendation(F.col("attack_type"))})


#: The condition of a query, as far as what comes after it, and its first comparison with a string or a number.
_CONDITION = r"(?i)\bWHERE\b.*?(?:\bORDER BY\b|\bGROUP BY\b|\bHAVING\b|$)"
_COMPARISON = r"^([\s\S]*?\b\w+\s*=\s*)(?:['\"][\w@.]+['\"]|\d+)([\s\S]*)$"
_SELECTED = r"(?i)\bSELECT\b.*?\bFROM\b"


def synthetic_injections(df: DataFrame, text: str = "query") -> DataFrame:
    """Attacks made of plain queries with a condition: an always-true one in place of the first compared value, and a union over as many columns as are selected."""
    own = F.col(text)
    plain = df.where(own.rlike(_SELECTED) & own.rlike(_CONDITION))
    condition = F.regexp_extract(own, _CONDITION, 0)
    true = F.replace(own, condition, F.regexp_replace(condition, _COMPARISON, "$1' OR 1=1 --$2"))
    selected = F.regexp_extract(own, _SELECTED, 0)
    commas = F.length(selected) - F.length(F.replace(selected, F.lit(","), F.lit("")))
    union = F.concat(own, F.lit(" UNION SELECT "), F.array_join(F.array_repeat(F.lit("1"), commas + 1), ","), F.lit(" --"))
    return plain.withColumn("made", F.explode(F.array(F.struct(F.lit("boolean").alias("kind"), true.alias("attack")), F.struct(F.lit("union").alias("kind"), union.alias("attack")))))


# Attacks that are the same whatever the plain queries are, plain and obfuscated ones.
ATTACK_TEXTS = [
    "' OR 1=1 --", "' UNION SELECT 1,2,3 --", "'; DROP TABLE users --", "' OR '1'='1", "' AND (SELECT COUNT(*) FROM users) > 10 --",
    "' WAITFOR DELAY '0:0:5' --", "' OR SLEEP(5) --", "' OR EXISTS(SELECT 1 FROM users) --", "' OR (SELECT ascii(substring(database(),1,1))) > 90 --",
    "' AND (SELECT 1 FROM information_schema.tables LIMIT 1) --", "' UNION ALL SELECT 1,2,@@version --", "' ORDER BY 10 --",
    "' GROUP BY 1 HAVING 1=1 --", "' INSERT INTO users VALUES ('hacker','hacked') --",
    "' OR/**/ 1=1 --", "' UNION/**/SELECT 1,2,3 --", "' OR '1'/**/='1", "' + 'OR' + '1' + '=' + '1", "' OR 0x31=0x31 --",
    "' OR CHAR(49)=CHAR(49) --", "' || 1=1 --", "' UnIoN SeLeCt 1,2,3 --", "' OR (1)/**/=/**/(1) --",
]


def attack_texts(df: DataFrame, text: str = "query", count: str | None = None) -> DataFrame:
    """All attacks to learn from (column ``text``): the fixed ones and those made of plain queries. ``count``: the column that says how many rows a query stands for."""
    fixed = df.sparkSession.createDataFrame([(x,) for x in ATTACK_TEXTS], f"`{text}` string")
    more = [count] if count else []
    return fixed.withColumns({c: F.lit(1).cast("long") for c in more}).unionByName(synthetic_injections(df, text).select(F.col("made.attack").alias(text), *more))
