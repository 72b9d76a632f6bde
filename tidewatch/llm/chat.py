r"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A turn is rendered as ``### role: text</turn>`` and a line feed. Conversations are
first rendered as they are and parsed again; where the parser does not give back the
very turns, the conversation is rendered once more with ``\`` before every ``\`` and
inside every control string (``### ``, ``</turn>``, in roles also ``: ``), after
which no control string is left in a text and the parser's answer is the source.

The parser is deterministic: turns begin at each ``### ``, end at their only
``</turn>`` and line feed, and the role ends at the first ``: ``. The loss mask are
the code point ranges of the assistants' texts in the formatted string; ``masked_text`` reads what is under it.

Defined results: rows are ordered by turn (null first), then role and text; a null role
or text is empty; rows with a null conv_id form one conversation; repeated rows are
repeated turns; an empty table gives no rows; other columns, whatever their names, are ignored.
A conversation is formatted in one row, since that is what it comes to: a very long one needs
memory for a few copies of itself in the task that holds it, and no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>"
#: Code points of a block when text under a mask is read.
BLOCK = 4096


def _escape(text: Column, *, role: bool) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit(HEAD), F.lit("#\\## ")), F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(SEP), F.lit(":\\ ")) if role else out


def _unescape(text: Column) -> Column:
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.regexp_replace(text, r"(?s)\\(.)", "$1"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(SEP), t["text"], F.lit(END + "\n"))), "")


def _raw_turns(formatted: Column) -> Column:
    """Role and text of each turn as they stand in the formatted string."""
    pieces = F.filter(F.split(formatted, HEAD), lambda _, i: i > 0)
    role = lambda p: F.substring_index(p, SEP, 1)
    tail = F.lit(-len(END) - 2)
    return F.transform(
        pieces,
        lambda p: F.struct(
            role(p).alias("role"),
            F.substr(p, F.length(role(p)) + 1 + len(SEP), F.length(p) - F.length(role(p)) - len(SEP) - len(END) - 1).alias("text"),
            (F.endswith(p, F.lit(END + "\n")) & (F.instr(p, END) == F.length(p) + tail + 2)).alias("ok"),
        ),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string; null where the grammar is broken."""
    raw = _raw_turns(formatted)
    turns = F.transform(raw, lambda t: F.struct(_unescape(t["role"]).alias("role"), _unescape(t["text"]).alias("text")))
    return F.when(F.forall(raw, lambda t: t["ok"]), turns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, recovered (what the parser reads) and loss_spans (code points [start, end), one for each assistant's turn)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("row"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    first = convs.select("conv_id", source.alias("source")).withColumn("plain", _render(F.col("source")))
    first = first.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    safe = F.transform("source", lambda t: F.struct(_escape(t["role"], role=True).alias("role"), _escape(t["text"], role=False).alias("text")))
    second = first.select("conv_id", "source", "escaped", F.when(F.col("escaped"), _render(safe)).otherwise(F.col("plain")).alias("formatted"))
    read = second.withColumn("raw", _raw_turns(F.col("formatted"))).withColumn("recovered", parse(F.col("formatted")))
    read = read.withColumn("formatted", F.when(F.coalesce(F.col("recovered") == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.col("conv_id").cast("string")))))
    # Where each turn's text begins: after all turns before it, its own head, role and separator.
    ends = F.aggregate(
        "raw",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + len(HEAD + SEP + END) + 1 + F.length(t["role"]) + F.length(t["text"])).cast("long").alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(HEAD + SEP) + F.length(t["role"])).cast("long").alias("start"), (acc["at"] + len(HEAD + SEP) + F.length(t["role"]) + F.length(t["text"])).cast("long").alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return read.select("conv_id", "formatted", "escaped", "recovered", ends.alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under a loss mask, span by span in the mask's order.

    The string is cut into blocks once, and a span reads the blocks that it lies in, so that many spans don't each walk the string from its beginning.
    """
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    first = lambda s: F.floor(s["start"] / BLOCK)
    held = lambda b, s: F.array_join(F.slice(b, (first(s) + 1).cast("int"), (F.floor(s["end"] / BLOCK) - first(s) + 1).cast("int")), "")
    text = lambda b, s: F.substr(held(b, s), (s["start"] - first(s) * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    # the blocks as the one element of an array: cut once for all spans
    read = F.transform(F.array(blocks), lambda b: F.array_join(F.transform(spans, lambda s: _unescape(text(b, s))), ""))
    return read[0]
