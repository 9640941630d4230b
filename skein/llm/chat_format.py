"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation:

    conversation = turn*
    turn         = "<s>[INST] " role " [/INST]" text "</s>"

A control string is one of ``<s> </s> [INST] [/INST]``. A turn is first rendered
as it is and reparsed. If the parser does not give back its role and text, its
control strings are escaped: one backslash goes after the opening bracket of each
one, and of each one that has backslashes there already. The parser takes one
backslash away again, so that one pass makes any turn identical; this is checked
per turn and again on the whole conversation, and a difference raises an error.

Results: a null role or text is empty. Turns are ordered by turn, role and text,
nulls first; repeated rows are turns of their own; a null conv_id is one
conversation. Extra columns are ignored; without rows there are none out. A
conversation is one string, so one can hold up to 2 GB of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
LOSS_ROLE = "assistant"
CONTROL = r"[<\[]\\*/?(s>|INST\])"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", r"[$1$2")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _parsed(turn: Column) -> Column:
    """Role and text of a turn without its end; null where it is no turn."""
    body = F.substring(turn, len(OPEN) + 1, 1 << 30)
    at = F.instr(body, MIDDLE)
    role = F.when(at > 1, F.substring(body, F.lit(1), at - 1)).otherwise("")
    text = F.substring(body, at + len(MIDDLE), F.lit(1 << 30))
    good = turn.startswith(OPEN) & (at > 0)
    return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    turns = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))), _parsed)


def _is_turn(formatted: Column, role: Column, text: Column) -> Column:
    found = parse(formatted)
    return (F.size(found) == 1) & F.coalesce((found[0]["role"] == role) & (found[0]["text"] == text), F.lit(False))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, source (the turns), loss_spans (code points of ``formatted`` under the loss mask)."""
    rows = turns.select(
        "conv_id",
        F.col("turn").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("_raw", render(F.col("role"), F.col("text")))
    # only control strings and escaped ones can conflict
    risky = F.col("role").rlike(CONTROL) | F.col("text").rlike(CONTROL)
    same = F.when(risky, _is_turn(F.col("_raw"), F.col("role"), F.col("text"))).otherwise(True)
    safe_role, safe_text = escape(F.col("role")), escape(F.col("text"))
    rows = rows.withColumn("_same", same)
    rows = rows.withColumn("_piece", F.when(F.col("_same"), F.col("_raw")).otherwise(render(safe_role, safe_text)))
    rows = rows.withColumn("_body", F.when(F.col("_same"), F.length("text")).otherwise(F.length(safe_text)))
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    end = F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_end", end.cast("long") - len(CLOSE)).withColumn("_n", F.row_number().over(order))
    one = F.struct("_n", "role", "text", "_piece", (F.col("_end") - F.col("_body")).alias("start"), F.col("_end").alias("end"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    spans = F.filter("_all", lambda x: x["role"] == LOSS_ROLE)
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("formatted"),
        F.transform("_all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )
    return whole


def checked(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, read back from the output; raises an error where they are not the source's."""
    back = formatted.withColumn("turns", parse(F.col("formatted")))
    differ = F.raise_error(F.concat(F.lit("round trip failed for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return back.withColumn("turns", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(differ.cast(back.schema["turns"].dataType)))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted."""
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
        "",
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = checked(formatted).withColumn("_loss", loss)
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "formatted",
        "loss_spans",
    )
