"""Chat formatting: event-sourced reconstruction of conversations, on DataFrame functions alone.

A log row is an event of a conversation: `kind` says what it does to message number `msg`:
  message     starts the message with `text`          delta       appends `text` to it
  edit        replaces its text                       regenerate  replaces it and discards all later messages so far
Events are ordered by `seq` within the conversation and folded into final messages, which are rendered as

    ### <role>: <text></turn>\\n

Texts and roles escape the template's control characters reversibly: a backslash, `<`, `#` and `:` become `\\b`, `\\l`,
`\\h` and `\\c`, so no text can hold a marker and every backslash of the output begins one escape.

Defined cases: null text is empty, a null role is an empty role, a null kind is a message; null seq sorts first; a
conversation without living events yields no row; a null conv_id is a conversation of its own; events of equal seq and msg follow each other in any
order, but rows of a table are ordered by turn, role and text; an empty table gives no rows; other columns are ignored. All steps are linear in a conversation's
events and characters; a conversation is one row in the end, so it must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(text: Column) -> Column:
    for raw, code in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) from events (conv_id, seq, msg, kind, role, text).

    An event dies when a later event restarts its message, or when a later regeneration concerns an earlier message.
    A message's role is that of its restarting event, or of its first delta.
    """
    # What comes later is what goes before in descending order: such a frame grows by a row at a time.
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("msg")).rowsBetween(Window.unboundedPreceding, -1)
    later_of_msg = Window.partitionBy("conv_id", "msg").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    ev = events.select("conv_id", "seq", "msg", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ev = ev.withColumn("cut_at", F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later))
    ev = ev.withColumn("restarted", F.max(F.col("kind") != "delta").over(later_of_msg))
    alive = ev.where(~F.coalesce(F.col("restarted"), F.lit(False)) & (F.col("cut_at").isNull() | (F.col("cut_at") > F.col("msg"))))
    folded = alive.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("parts"))
    return folded.select("conv_id", "msg", F.col("parts")[0]["role"].alias("role"), F.array_join(F.col("parts")["text"], "").alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask) from messages (conv_id, msg, role, text).

    `loss_mask` lists the spans (start, length; code points from 0) of the escaped texts of `learn_role`.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    x = messages.select("conv_id", "msg", F.col("role").alias("raw"), role.alias("role"), text.alias("text"))
    x = x.withColumn("turn", F.concat(F.lit(HEAD), "role", F.lit(SEP), "text", F.lit(TAIL)))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + len(HEAD) + F.char_length("role") + len(SEP)
    x = x.withColumn("span", F.when(F.col("raw") == learn_role, F.struct(at.cast("int").alias("start"), F.char_length("text").alias("length"))))
    conv = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "turn"))).alias("parts"), F.array_sort(F.collect_list("span")).alias("loss_mask"))
    return conv.select("conv_id", F.array_join(F.col("parts")["turn"], "").alias("formatted"), "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text) parsed from `formatted` and `loss_mask`.

    Each turn is cut out once and knows where its text begins, so a span of the mask finds its turn by a join.
    """
    cut = F.split(F.col("formatted"), TAIL)
    pieces = formatted.select("conv_id", F.posexplode(F.slice(cut, F.lit(1), F.size(cut) - 1)).alias("i", "piece"))
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece") + len(TAIL)).over(before), F.lit(0))
    body = F.instr("piece", SEP) + len(SEP)
    pieces = pieces.select("conv_id", "i", F.substring_index(F.substring("piece", len(HEAD) + 1, 2**31 - 1), SEP, 1).alias("role"), F.substring(F.col("piece"), body, F.lit(2**31 - 1)).alias("text"), (start + body - 1).alias("at"))
    spans = formatted.select("conv_id", F.inline("loss_mask")).alias("s")
    p = pieces.alias("p")
    under = p.join(spans, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("p.at") == F.col("s.start")), "left")
    loss = F.when(F.col("s.length").isNotNull(), unescape(F.substring(F.col("text"), F.lit(1), F.col("s.length"))))
    under = under.select("p.conv_id", "i", unescape(F.col("role")).alias("role"), unescape(F.col("text")).alias("text"), loss.alias("loss"))
    back = under.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "loss"))).alias("t"))
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = back.select("conv_id", turns.alias("turns"), F.array_join(F.transform("t", lambda t: t["loss"]), "").alias("loss_text")).alias("b")
    f = formatted.alias("f")
    return f.join(back, F.col("f.conv_id").eqNullSafe(F.col("b.conv_id"))).select("f.conv_id", "f.formatted", "b.turns", "b.loss_text")


def rows_as_events(rows: DataFrame) -> DataFrame:
    """Events from plain rows (conv_id, turn, role, text): each row is a message; rows by turn, ties by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order))
    return rows.select("conv_id", "seq", F.col("seq").alias("msg"), F.lit("message").alias("kind"), "role", "text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of a table of turns."""
    return render(fold_events(rows_as_events(rows)))
