"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one event a row: (conv_id, seq, msg, role, op, text). op 'delta' appends text to message msg, 'edit'
replaces what the message has so far, 'regenerate' discards it and starts again with text. Events are folded in the
order of seq. Each message is then rendered as

    ### <role>: <text></turn>\\n

Inside roles and texts a backslash is written \\\\, '#' is \\h and '<' is \\l (in roles also ':' is \\c), so the marks
'### ' and '</turn>' can't occur there and every text is read back exactly. The loss mask covers the written text
of the turns of the assistant, without marks.

Defined cases: null texts and roles are empty; a null op is 'delta'; null conv_id forms one conversation; events
with equal seq are ordered by role, then text; repeated rows are events of their own. A conversation is one value of the result, so
its length is bounded by what one value may hold. An empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, MID, END = "### ", ": ", "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    c = F.replace(F.replace(c, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescape(c: Column) -> Column:
    """Doubled backslashes are cut out first, so that what follows one isn't taken for a code."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.when(c.contains("\\"), F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")).otherwise(c)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row is a message of its own, sent in one delta."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", seq.alias("seq"), "role", "text").select("conv_id", "seq", F.col("seq").alias("msg"), "role", F.lit("delta").alias("op"), "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, seq, role, text): the final messages; seq and role are those of a message's first event."""
    op = F.coalesce("op", F.lit("delta"))
    whole = W.partitionBy("conv_id", "msg").orderBy("seq", "role", "text")
    resets = F.sum(F.when(op.isin("edit", "regenerate"), 1).otherwise(0)).over(whole.rowsBetween(W.unboundedPreceding, 0))
    marked = events.withColumn("epoch", resets)
    part = F.struct("seq", F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    epochs = marked.groupBy("conv_id", "msg", "epoch").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    last = epochs.groupBy("conv_id", "msg").agg(F.max_by("parts", "epoch").alias("parts"), F.min_by("parts", "epoch").alias("start"))
    return last.select("conv_id", "msg", F.col("start")[0]["seq"].alias("seq"), F.col("start")[0]["role"].alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, train_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): loss has (start, length, n) of code points in formatted for each turn of train_role."""
    role, text = escape(F.col("role"), True), escape(F.col("text"))
    turn = messages.select("conv_id", "seq", "msg", F.concat(F.lit(HEAD), role, F.lit(MID)).alias("head"), text.alias("body"), F.coalesce(F.col("role") == train_role, F.lit(False)).alias("train"))
    before = F.sum(F.length("head") + F.length("body") + len(END)).over(W.partitionBy("conv_id").orderBy("seq", "msg").rowsBetween(W.unboundedPreceding, -1))
    turn = turn.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "msg", F.concat("head", "body", F.lit(END)).alias("turn"), "train", "start", F.length("body").alias("length"))))
    spans = F.transform(F.filter("parts", lambda p: p["train"]), lambda p: F.struct(p["start"].cast("long").alias("start"), p["length"].cast("long").alias("length")))
    return turn.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"), spans.alias("loss"))


def format_chats(events: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Logs to training texts with their loss masks."""
    return render(fold(events), train_role)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"</turn>\n", -1), lambda x: x != "")
    cut = lambda x: F.instr(x, MID)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring(x, F.lit(len(HEAD) + 1), cut(x) - len(HEAD) - 1)).alias("role"), unescape(F.substring(x, cut(x) + len(MID), F.length(x))).alias("text")))


def read_spans(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under a loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
