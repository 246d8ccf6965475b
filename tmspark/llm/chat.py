"""Chat formatting with a grammar round trip, all in DataFrame functions.

A turn is rendered as ``### role: text </turn>`` and a line feed. The parser cuts the rendered conversation at the end
marks, takes the role up to the first unescaped colon, and undoes escapes. A turn is first rendered as it is and parsed
back; where that does not give the same turn, its content is escaped (a backslash before each backslash, and inside each
control string), which the parser always reads back to the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template.
START, COLON, END = "### ", ": ", " </turn>\n"


def _escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("### "), F.lit("##\\# "))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit(":"), F.lit("\\:"))


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(COLON), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered text; a stretch that is not exactly one turn gives a null role."""
    pieces = F.filter(F.split(formatted, r" </turn>\n", -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        ok = piece.startswith(START) & (F.size(F.split(piece, START, -1)) == 2)
        body = F.substring(piece, len(START) + 1, 2147483647)
        role = F.regexp_extract(body, r"^((?:[^\\:]|\\.)*+): ", 1)
        text = F.substr(body, F.char_length(role) + len(COLON) + 1)
        return F.struct(
            F.when(ok, _unescape(role)).alias("role"), F.when(ok, _unescape(text)).alias("text")
        )

    return F.transform(pieces, turn)


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``rendered`` to rows with role and text: plain where it parses back to the same turn, escaped elsewhere; what
    is escaped is parsed back and compared again, and a turn that still differed would be an error. Null role or text
    counts as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))

    def reads_back(rendered: Column) -> Column:
        back = parse(rendered)
        turn = F.get(back, F.lit(0))
        return (F.size(back) == 1) & F.coalesce((turn["role"] == role) & (turn["text"] == text), F.lit(False))

    plain, escaped = render_turn(role, text), render_turn(_escape_role(role), _escape(text))
    # Only texts that hold a control character can differ, so the parser runs on those alone.
    doubtful = text.contains("\\") | text.contains("</turn>") | text.contains("### ") | ~role.rlike("^[A-Za-z0-9_]*$")
    failed = F.raise_error(F.concat(F.lit("a turn doesn't read back: "), F.substring(text, 1, 100))).cast("string")
    rendered = F.when(~doubtful, plain).when(reads_back(plain), plain).when(reads_back(escaped), escaped).otherwise(failed)
    return turns.withColumn("rendered", rendered)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back from it), loss_text (the unescaped texts of
    assistant turns as parsed back, each once, in order).

    Turns are ordered by turn number, nulls first; equal numbers by role, then text; repeated rows are turns of their
    own. Rows with a null conv_id are one conversation. Null texts and roles are empty. An empty table gives an empty
    one. Only these four columns are read. A conversation is one value and so is held in one task; its size is bounded
    by Spark's 2 GB a value."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "rendered")))
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text")
    whole = (
        format_turns(source)
        .groupBy("conv_id")
        .agg(F.concat_ws("", F.transform(ordered, lambda t: t["rendered"])).alias("formatted"), F.count(F.lit(1)).alias("_n"))
    )
    parsed = whole.withColumn("turns", parse(F.col("formatted")))
    lost = F.raise_error(F.lit("a conversation reads back as another number of turns")).cast(parsed.schema["turns"].dataType)
    parsed = parsed.withColumn("turns", F.when(F.size("turns") == F.col("_n"), F.col("turns")).otherwise(lost)).drop("_n")
    spoken = F.filter("turns", lambda t: t["role"] == "assistant")
    return parsed.withColumn("loss_text", F.concat_ws("", F.transform(spoken, lambda t: t["text"])))


def loss_spans(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, start and length of its (escaped) text in the formatted conversation."""
    from pyspark.sql import Window

    turns = format_turns(conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "rendered").rowsBetween(Window.unboundedPreceding, -1)
    head = len(START) + F.char_length("role") + len(COLON)
    before = F.coalesce(F.sum(F.char_length("rendered")).over(order), F.lit(0))
    return turns.withColumn("_before", before).where(F.col("role") == "assistant").select(
        "conv_id",
        (F.col("_before") + head).alias("start"),
        (F.char_length("rendered") - head - len(END)).alias("length"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the query returns, read back from the formatted text."""
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", each), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
