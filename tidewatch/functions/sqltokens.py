"""Tokens of query texts and what is suspicious among them, in expressions: one pass of a regular expression, and functions over its array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords, in the order in which tokens are recognised.
KEYWORDS = [
    "SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "UNION", "JOIN", "HAVING", "GROUP", "ORDER",
    "BY", "LIMIT", "PROCEDURE", "EXEC", "EXECUTE", "WAITFOR", "DELAY", "BENCHMARK", "INTO", "VALUES", "TABLE", "DATABASE", "COLUMN",
    "INDEX", "CONSTRAINT", "VIEW", "FUNCTION", "TRIGGER", "SCHEMA", "GRANT", "REVOKE", "COMMIT", "ROLLBACK", "SAVEPOINT",
    "TRANSACTION", "SET", "DECLARE", "CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "EXISTS", "BETWEEN", "LIKE", "IN",
    "IS", "NULL", "TRUE", "FALSE", "PRIMARY", "FOREIGN", "KEY", "REFERENCES", "INNER", "OUTER", "LEFT", "RIGHT", "FULL", "CROSS",
    "NATURAL", "ON", "USING", "COUNT", "SUM", "AVG", "MIN", "MAX", "DISTINCT", "ALL", "EXCEPT", "INTERSECT", "ANY", "SOME", "FOR",
    "OFFSET", "FETCH", "FIRST", "NEXT", "ONLY", "WITH",
]
# Operators, the longer ones first.
OPERATORS = ["<=", ">=", "<>", "!=", "||", "&&", "<<", ">>", "-", "=", "<", ">", "+", "*", "/", "%", "^", "&", "|", "~", "!"]
#: White space, which parts tokens and is none.
SPACE = r" \t\n\x0B\f\r"
TOKEN = "|".join([r"'[^']*'", r'"[^"]*"', "`[^`]*`", r"--[^\n]*", r"#[^\n]*", r"/\*[\s\S]*?\*/", r"[0-9]+(?:\.[0-9]+)?", r"[A-Za-z_@][A-Za-z0-9_@$]*", r"<=|>=|<>|!=|\|\||&&|<<|>>", rf"[^{SPACE}]"])


def kind(token: Column, code: Column, upper: Column) -> Column:
    """string, comment, number, keyword, identifier, operator or other; a quote that nothing closes is other.

    ``code``: of the token's first character; ``upper``: the token in upper case.
    """
    word = code.between(65, 90) | code.between(97, 122) | code.isin(95, 64)
    quoted = code.isin(39, 34, 96) & (F.length(token) > 1)
    comment = (code == 35) | (code.isin(45, 47) & (F.startswith(token, F.lit("--")) | F.startswith(token, F.lit("/*"))))
    return F.when(word, F.when(upper.isin(KEYWORDS), "keyword").otherwise("identifier")).when(quoted, "string").when(comment, "comment").when(code.between(48, 57), "number").when(token.isin(OPERATORS), "operator").otherwise("other")


def tokens(text: Column) -> Column:
    """An array of (type, value), words in upper case; null for a null text. What several rules ask of a token is found once."""
    asked = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("t"), F.ascii(t).alias("c"), F.upper(t).alias("u")))
    typed = F.transform(asked, lambda x: F.struct(kind(x["t"], x["c"], x["u"]).alias("type"), x["t"].alias("t"), x["u"].alias("u")))
    return F.transform(typed, lambda x: F.struct(x["type"].alias("type"), F.when(x["type"].isin("keyword", "identifier"), x["u"]).otherwise(x["t"]).alias("value")))


def findings(own: Column) -> Column:
    """Kinds of suspicious neighbours among the tokens: what begins at any token that two more follow."""
    last = F.size(own) - 3
    at = lambda i, k: F.get(own, i + k)
    word = lambda i, k, *w: at(i, k)["type"].isin("keyword", "identifier") & at(i, k)["value"].isin(*w)
    is_a = lambda i, k, t: at(i, k)["type"] == t
    equal = lambda i: is_a(i, 2, "operator") & (at(i, 2)["value"] == "=")
    rules = {
        "boolean": lambda i: word(i, 0, "OR") & ((is_a(i, 1, "number") & equal(i)) | word(i, 1, "TRUE") | (is_a(i, 1, "string") & equal(i) & F.coalesce(is_a(i, 3, "string"), F.lit(False)))),
        "union": lambda i: word(i, 0, "UNION") & (word(i, 1, "SELECT") | (word(i, 1, "ALL") & word(i, 2, "SELECT"))),
        "time": lambda i: word(i, 0, "SLEEP", "WAITFOR", "BENCHMARK"),
        "destructive": lambda i: word(i, 0, "DROP"),
        "command_exec": lambda i: is_a(i, 0, "identifier") & F.contains(at(i, 0)["value"], F.lit("CMDSHELL")),
    }
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.array_compact(F.array(*[F.when((last >= 0) & F.exists(places, f), name) for name, f in rules.items()]))
