"""Chat formatting from event logs, with DataFrame functions only.

The log of a conversation is a sequence of events on messages.  Messages are
folded from their events, put in order, and rendered with a template whose
control strings cannot occur in an escaped text; the loss mask marks the
assistant's texts.  A reader takes the formatted text apart again.

Template of a turn: ``### ROLE: TEXT</turn>`` and a line feed.  In texts and
roles ``\\`` becomes ``\\\\``, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l``;
in roles ``:`` becomes ``\\c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
KINDS = ("start", "delta", "edit", "regenerate", "delete")
END = "</turn>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    """``text`` without any control character of the template; null: empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")) + (((":", "\\c"),) if role else ()):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: between doubled backslashes every code is
    taken back, then the pieces are joined by single ones."""
    def codes(part: Column) -> Column:
        for code, sign in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(sign))
        return part
    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of event logs: conv_id, message, role, text.

    ``start`` opens a message and gives its role; ``delta`` appends to it;
    ``edit`` replaces its text; ``regenerate`` empties it, so that what was
    streamed before is dropped; ``delete`` takes the message away unless a
    later event but a delta brings it back.  Events apply in the order of seq,
    ties in the order of kind and text; an event that occurs twice in all
    columns applies once (logs are delivered at least once).  Null texts are
    empty, the role is that of the last event with one; a message whose events
    never give a role has an empty one.  Null conversations are one
    conversation.  Other kinds raise an error.

    Events meet by (conversation, message), so the log of a conversation that
    holds a third of all events is folded by many tasks; only its final
    messages come together.
    """
    known = events.select("conv_id", "seq", "message", "kind", "role", "text").distinct() \
        .withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(
            F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))))
    key = ("conv_id", "message")
    # what stands before the last event that sets the whole text has no effect
    reset = F.when(F.col("kind") != "delta", F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))
    marked = known.withColumn("_last", F.max(reset).over(Window.partitionBy(*key)))
    here = F.struct("seq", F.lit("delta").alias("kind"), F.lit("").alias("text"))
    live = F.col("kind").eqNullSafe("delta") & (F.col("_last").isNull() | (here > F.struct(
        F.col("_last.seq").alias("seq"), F.col("_last.kind").alias("kind"), F.lit("").alias("text"))))
    part = F.when(live, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    folded = marked.groupBy(*key).agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind"))).alias("role"),
        F.first("_last").alias("_last"), F.sort_array(F.collect_list(part)).alias("_parts"))
    head = F.when(F.col("_last.kind").isin("start", "edit"), F.col("_last.text")).otherwise("")
    return folded.where(~F.col("_last.kind").eqNullSafe("delete")).select(
        *key, F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.coalesce(head, F.lit("")), F.array_join(F.transform("_parts", lambda p: p["text"]), "")).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, and loss, the loss
    mask: for each turn the code points ``[begin, end)`` of the formatted text
    to learn from, which are empty but for the assistant's texts.  Messages
    stand in the order of message, ties by role and text."""
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    turn = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "body")
    placed = turn.withColumn("nth", F.row_number().over(order)) \
        .withColumn("to", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("to") - F.length("piece") + F.length("head")
    size = F.when(F.col("role") == LEARNED_ROLE, F.length("body")).otherwise(0)
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "nth", "piece", F.struct(begin.alias("begin"), (begin + size).alias("end")).alias("span")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
                       F.transform("t", lambda x: x["span"]).alias("loss"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Event logs (``EVENTS``; more columns are ignored) -> conv_id,
    formatted, loss, in one row for each conversation with a message left."""
    return render(fold_events(events))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Take formatted conversations apart: one row for each turn with conv_id,
    turn (from 0), role, text, learned (the unescaped text under the mask)
    and n_chars (code points of the turn in the formatted text)."""
    pieces = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    rows = formatted.select("conv_id", F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("loss").alias("span")))) \
        .select("conv_id", F.col("pos").alias("turn"), "col.piece", "col.span")
    size = F.length("piece") + len(END)
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_from", F.sum(size).over(order) - size)
    learned = F.expr("substring(piece, cast(span.begin - _from + 1 as int), cast(span.end - span.begin as int))")
    return rows.select(
        "conv_id", "turn", unescape(F.expr("substring(piece, 5, instr(piece, ': ') - 5)")).alias("role"),
        unescape(F.expr("substring(piece, instr(piece, ': ') + 2)")).alias("text"),
        unescape(learned).alias("learned"), size.alias("n_chars"))


# --- the registered query -----------------------------------------------------------

def log_of(conversations: DataFrame) -> DataFrame:
    """A stand-in event log of a table of turns (conv_id, turn, role, text):
    every row becomes a message that is streamed in deltas; some messages are
    streamed wrongly first and regenerated, some are edited afterwards."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    front, back = F.expr("substring(text, 1, cast(length(text) / 2 as int))"), F.expr(
        "substring(text, cast(length(text) / 2 as int) + 1)")
    nothing = F.lit(None).cast("string")

    def event(n: int, kind: str, text: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"),
                        (F.col("role") if kind == "start" else nothing).alias("role"), text.alias("text"))
        return made if when is None else F.when(when, made)

    again, edited = F.col("message") % 3 == 0, F.col("message") % 4 == 1
    log = F.array(
        event(0, "start", nothing),
        event(1, "delta", F.concat(F.lit("draft "), front), again), event(2, "regenerate", nothing, again),
        event(3, "delta", front), event(4, "delta", F.when(edited, F.lit("typo")).otherwise(back)),
        event(5, "edit", F.col("text"), edited))
    return rows.select("conv_id", "message", F.explode(F.filter(log, lambda e: e.isNotNull())).alias("e")).select(
        "conv_id", (F.col("message") * 8 + F.col("e.n")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold, format and read back all conversations, and one more that is full
    of control strings."""
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                 "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    formatted = materialize(format_conversations(log_of(table)), "formatted-chats")
    turns = read_formatted(formatted)
    rows = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "learned"))).alias("t"),
        F.sum(F.length("learned")).alias("loss_chars"), F.sum("n_chars").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), "loss_chars",
        F.sha2(F.array_join(F.transform("t", lambda x: x["learned"]), ""), 256).alias("loss_sha256"), "formatted_chars")


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(text) + 8
    + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
