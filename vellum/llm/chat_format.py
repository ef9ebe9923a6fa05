r"""Chat formatting from an event log, in DataFrame functions only.

A log has events of conversations in sequence. `message` opens a message with a role and a text, `delta`
appends to it, `edit` replaces its text so far, `regenerate` drops its text so far and its new text follows as
deltas. A message's place is that of its first event. The log is dealt by conversation; a message is what its last
`message`, `edit` or `regenerate` event and the deltas after that say.

Rendering: each turn is `<s>` role `[INST]` text `[/INST]`, but an assistant's text ends in `</s>`.
Inside roles and texts a backslash is doubled, and the control strings <s>, </s>, [INST], [/INST] get a
backslash after their first character; so no control string is left in them, and dropping each backslash
that stands before a character gives the text back. loss_spans are the code points [begin, end) of
assistant texts as they stand in the output, escapes included.

A conversation is one output string, so its turns meet in one task by definition; nothing else does. Places in the output
are running sums of turn lengths over a window, and reading back cuts each turn once, so work on a conversation is
linear in its text but for the sort of its turns.

Cases: null roles and texts are empty; a text with control strings comes back as it was; events with the same
sequence number are ordered by kind, then by role and text; repeated rows of a table of turns are turns of their own;
deltas before any message still belong to their message, its role is then empty; an empty log gives an empty result. Rows
with a null conversation are one conversation with a null id; very long texts and conversations are one row each. Further
columns of the log are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
#: The order of kinds at one sequence number; the first three start a message's text anew.
KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(\\)|(<)(?=/?s>)|(\[)(?=/?INST\])", r"$1$2$3\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_to_log(turns: DataFrame, piece: int = 512) -> DataFrame:
    """The log of a table of turns (conv_id, turn, role, text), as a server that streams would write it: a message event with
    the role, then the text in deltas of `piece` code points. Every third message is a draft (the text backwards)
    that an edit replaces after the next message has begun; every third is a draft that is regenerated."""
    numbered = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long").alias("msg_id"))
    cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    numbered = numbered.select("*", cut(F.col("text")).alias("pieces"), F.when(F.col("msg_id") % 3 != 0, cut(F.reverse("text"))).alias("draft"))
    event = lambda late, step, kind, role, text: F.struct(F.struct((F.col("msg_id") + late).alias("message"), step.cast("long").alias("step")).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none, count = F.lit(None).cast("string"), F.size("pieces")
    said = lambda pieces, after: F.transform(pieces, lambda x, i: event(0, i + 1 + after, "delta", none, x))
    opened = F.array(event(0, F.lit(0), "message", F.col("role"), F.lit("")))
    edited = F.concat(opened, said("draft", 0), F.array(event(1, count + 1, "edit", none, F.col("text"))))
    anew = F.concat(opened, said("draft", 0), F.array(event(0, count + 1, "regenerate", none, none)), said("pieces", count + 1))
    events = F.when(F.col("msg_id") % 3 == 1, edited).when(F.col("msg_id") % 3 == 2, anew).otherwise(F.concat(opened, said("pieces", 0)))
    return numbered.select("conv_id", "msg_id", F.explode(events).alias("e")).select("conv_id", "msg_id", "e.seq", "e.kind", "e.role", "e.text")


def final_messages(log: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the messages that the log (conv_id, msg_id, seq, kind, role, text) ends in."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    event = F.struct("seq", order.alias("o"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    anew = F.struct(F.col("seq"), order.alias("o"))
    grouped = log.groupBy("conv_id", "msg_id").agg(
        F.min("seq").alias("at"),
        F.max(F.when(F.col("kind") != "delta", anew)).alias("anew"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).getField("role").alias("role"),
        F.sort_array(F.collect_list(event)).alias("events"),
    )
    lasting = F.filter("events", lambda e: F.col("anew").isNull() | (F.struct(e["seq"], e["o"]) >= F.col("anew")))
    text = F.array_join(F.transform(lasting, lambda e: F.when(e["o"] == KINDS.index("regenerate") + 1, F.lit("")).otherwise(e["text"])), "")
    return grouped.select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<turn, begin, end>>): turns are numbered from 0, spans are code points."""
    loss = F.col("role") == "assistant"
    parts = messages.select("conv_id", "at", loss.alias("loss"), F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(OPEN)).alias("head"), escape(F.col("text")).alias("body"), F.when(loss, END).otherwise(CLOSE).alias("tail"))
    size = F.length("head") + F.length("body") + F.length("tail")
    order = W.partitionBy("conv_id").orderBy("at")
    start = F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("conv_id", "loss", (F.row_number().over(order) - 1).alias("turn"), F.concat("head", "body", "tail").alias("said"), (start + F.length("head")).alias("begin"), F.length("body").alias("size"))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said", "loss", "begin", "size"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["turn"].alias("turn"), t["begin"].alias("begin"), (t["begin"] + t["size"]).alias("end")))
    return turns.select("conv_id", F.array_join(F.col("turns.said"), "").alias("formatted"), spans.alias("loss_spans"))


def format_log(log: DataFrame) -> DataFrame:
    return render(final_messages(log))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted_chars): what the output says."""
    piece, span = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = F.concat(
        F.transform(F.slice(F.split("formatted", BEGIN), 2, F.length("formatted") + 1), lambda s, i: F.struct(i.cast("int").alias("turn"), F.lit(0).alias("kind"), s.alias("piece"), span.alias("begin"), span.alias("end"))),
        F.transform("loss_spans", lambda x: F.struct(x["turn"].cast("int").alias("turn"), F.lit(1).alias("kind"), piece.alias("piece"), x["begin"].cast("long").alias("begin"), x["end"].cast("long").alias("end"))),
    )
    cut = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.explode(rows).alias("r")).select("conv_id", "formatted_chars", "r.*")
    # a turn's span, if it has one, is the row after its piece; pieces lack the opening string
    order = W.partitionBy("conv_id").orderBy("turn", "kind")
    before = F.sum(F.when(F.col("kind") == 0, F.length("piece") + len(BEGIN)).otherwise(0).cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    told = cut.select("conv_id", "formatted_chars", "turn", "kind", "piece", (F.coalesce(before, F.lit(0)) + len(BEGIN)).alias("start"), F.lead("begin").over(order).alias("begin"), F.lead("end").over(order).alias("end")).where("kind = 0")
    role = unescape(F.substring_index("piece", OPEN, 1)).alias("role")
    text = unescape(F.regexp_extract("piece", r"(?s)^.*?\[INST\](.*)(?:</s>|\[/INST\])$", 1)).alias("text")
    loss = unescape(F.substring(F.col("piece"), (F.col("begin") - F.col("start") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))).alias("loss")
    back = told.groupBy("conv_id").agg(F.max("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("turn", role, text, loss))).alias("t"))
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return back.select("conv_id", turns.alias("turns"), F.filter(F.col("t.loss"), lambda x: x.isNotNull()).alias("loss_texts"), "formatted_chars")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = read_back(format_log(turns_to_log(turns.unionByName(extra))))
    said = F.array_join("loss_texts", "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.length(said).cast("long").alias("loss_chars"), sha(said).alias("loss_sha256"), "formatted_chars")
