"""Chats from event logs: messages folded from deltas, edits and regenerations, then rendered with a loss mask.

Everything is DataFrame operations.  The log is grouped by conversation and
message, so a message's events meet, never a whole log; a message keeps what
came after its last edit or regeneration.  Then the messages of a conversation
are sorted and rendered, which takes one row, as the result is one text.

The template writes each turn as ``<s>role\\ntext</s>\\n``.  Control strings inside
roles and texts are broken by a backslash after their first character, and
backslashes are doubled, which ``unescaped`` turns back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil.llm.rows import col

BEGIN, END = "<s>", "</s>\n"
#: What may not stand in a rendered text but as a mark: the first character, and what follows it.
_CONTROL = r"<(?=/?s>|</?SYS>>|\|)|\[(?=/?INST\])"
LEARNED = "assistant"


def escaped(text: Column, line_breaks: bool = True) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")
    return out if line_breaks else F.replace(out, F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column, line_breaks: bool = True) -> Column:
    def part(p: Column) -> Column:
        if not line_breaks:
            p = F.replace(p, F.lit("\\n"), F.lit("\n"))
        return F.replace(p, F.lit("\\"), F.lit(""))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def reconstruct(events: DataFrame, conversation: str = "conv_id", message: str = "message", seq: str = "seq",
                kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """The final messages as (conversation, message, role, text).

    Events count in the order of ``seq``, those with the same number by kind and
    text; an event that was delivered twice counts once.  ``delta`` appends its
    text, ``edit`` puts its text in place of what there is, ``regenerate`` starts
    anew.  Other kinds and null kinds change nothing.  A null text is empty; a
    null role is that of the message's other events, or empty.  A message
    without any text is an empty message.  Null conversations and messages are
    keys like others; other columns are ignored; no events make no messages.
    """
    rows = events.select(
        col(conversation).alias("conversation"), col(message).alias("message"), col(role).cast("string").alias("role"),
        F.struct(col(seq).alias("seq"), F.coalesce(col(kind), F.lit("")).alias("kind"),
                 F.coalesce(col(text).cast("string"), F.lit("")).alias("text")).alias("event"))
    rows = rows.withColumn("reset", F.when(F.col("event.kind").isin("edit", "regenerate"), F.col("event")))
    folded = rows.groupBy("conversation", "message").agg(
        F.min("role").alias("role"), F.max("reset").alias("reset"), F.collect_set("event").alias("events"))
    after = F.filter(F.sort_array("events"), lambda e: (e["kind"] == "delta") & (
        F.col("reset").isNull() | (e > F.col("reset"))))
    start = F.when(F.col("reset.kind") == "edit", F.col("reset.text")).otherwise("")
    return folded.select(
        F.col("conversation").alias(conversation), F.col("message").alias(message),
        F.coalesce("role", F.lit("")).alias(role),
        F.concat(start, F.array_join(F.transform(after, lambda e: e["text"]), "")).alias(text))


def render(messages: DataFrame, conversation: str = "conv_id", message: str = "message", role: str = "role",
           text: str = "text", learned: str = LEARNED) -> DataFrame:
    """One row for each conversation: its formatted text and its loss mask.

    Messages come in the order of ``message``, equal ones by role and text;
    repeated rows are repeated messages.  The mask has a run (block, start, end)
    for each message of the role ``learned``; blocks are what END separates, and
    start and end count characters in the block.  Null roles and texts are empty.
    """
    turn = F.struct(col(message).alias("message"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    grouped = messages.select(col(conversation).alias("c"), turn.alias("turn")).groupBy("c").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"))

    def block(t: Column) -> Column:
        head = F.concat(F.lit(BEGIN), escaped(t["role"], line_breaks=False), F.lit("\n"))
        return F.struct(F.length(head).alias("head"), F.concat(head, escaped(t["text"])).alias("text"),
                        (t["role"] == learned).alias("learned"))

    blocks = grouped.select("c", F.transform("turns", block).alias("blocks"))
    mask = F.filter(F.transform("blocks", lambda b, i: F.when(b["learned"], F.struct(
        i.alias("block"), b["head"].alias("start"), F.length(b["text"]).alias("end")))), lambda m: m.isNotNull())
    return blocks.select(
        F.col("c").alias(conversation),
        F.array_join(F.transform("blocks", lambda b: F.concat(b["text"], F.lit(END))), "").alias("formatted"),
        mask.alias("loss_mask"))


def _blocks(formatted: Column) -> Column:
    """What END ends; the empty rest behind the last one is left out."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(BEGIN) + 1))
        at = F.instr(body, "\n")
        return F.struct(unescaped(F.substr(body, F.lit(1), at - 1), line_breaks=False).alias("role"),
                        unescaped(F.substr(body, at + 1)).alias("text"))

    return F.transform(_blocks(formatted), turn)


def learned_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, as an array."""
    def under(blocks: Column) -> Column:
        return F.transform(mask, lambda m: unescaped(
            F.substr(F.get(blocks, m["block"]), m["start"] + 1, m["end"] - m["start"])))

    return F.get(F.transform(F.array(_blocks(formatted)), under), F.lit(0))
