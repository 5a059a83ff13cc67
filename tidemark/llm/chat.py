"""Chat formatting from an event log.

A conversation is a log of events (conv_id, seq, message, kind, role, text).
``message`` and ``edit`` set the text of a message, ``regenerate`` empties it or starts
it anew, ``delta`` appends to it and ``delete`` takes it out. The log is partitioned by
conversation and sorted by sequence; a message is what follows its last reset. Messages
stand in the order of their first event.

A turn is written as ``<turn role>``, a line break, the text, a line break and
``</turn>``. Inside texts and roles a backslash becomes ``\\b`` and ``<`` becomes ``\\l``
(in roles also ``>`` ``\\g`` and a line break ``\\n``), so no text can contain a
control string and every output can be read back exactly. The loss mask covers the
escaped texts of the assistant, in code points.

Defined results: null text and role are empty; a null sequence comes first; events of one
sequence number are ordered by kind, role and text; repeated rows of a plain turn table
are turns of their own; an empty log gives no conversations; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "\n</turn>\n"
KINDS = ("message", "edit", "regenerate", "delete", "delta")
LOW = -(1 << 63)


def escape(text: Column, role: bool = False) -> Column:
    pairs = [("\\", "\\b"), ("<", "\\l")] + ([(">", "\\g"), ("\n", "\\n")] if role else [])
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    pairs = ([("\n", "\\n"), (">", "\\g")] if role else []) + [("<", "\\l"), ("\\", "\\b")]
    for plain, code in pairs:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as a log in which every row is a message."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.row_number().over(order).cast("long").alias("message"),
        F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of every message that is left."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(len(KINDS)))
    at = F.struct(
        F.coalesce(F.col("seq"), F.lit(LOW)).alias("seq"), rank.alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = F.max(F.when(F.col("kind") != "delta", F.col("at")))
    messages = events.withColumn("at", at).groupBy("conv_id", "message").agg(
        F.min("at").alias("first"), last.alias("reset"), F.collect_list("at").alias("log"))
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e >= F.col("reset")))
    return messages.where(F.col("reset").isNull() | (F.col("reset.rank") != KINDS.index("delete") + 1)).select(
        "conv_id", F.struct(F.col("first.seq").alias("seq"), F.coalesce("message", F.lit(LOW)).alias("message")).alias("place"),
        F.col("first.role").alias("role"), F.array_join(F.transform(F.array_sort(live), lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: formatted, spans (of each turn and of its loss, in code points)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(">\n"))
    body = escape(F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    shown = messages.select("conv_id", "place", "role", head.alias("head"), body.alias("body"), F.concat(head, body, F.lit(CLOSE)).alias("shown"))
    start = F.coalesce(F.sum(F.char_length("shown").cast("long")).over(before), F.lit(0))
    lossy = F.col("role") == "assistant"
    placed = shown.withColumn("start", start).withColumn("from", F.col("start") + F.char_length("head")).select(
        "conv_id", F.struct(
            "place", "shown", "start", (F.col("start") + F.char_length("shown")).alias("end"),
            F.when(lossy, F.col("from")).alias("loss_start"),
            F.when(lossy, F.col("from") + F.char_length("body")).alias("loss_end")).alias("turn"))
    listed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return listed.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"], t["end"], t["loss_start"], t["loss_end"])).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, losses) from the written strings: roles and texts of
    the turns, and the unescaped texts under the loss mask."""
    parts = F.split("formatted", CLOSE)
    cut = formatted.withColumn("_parts", F.slice(parts, 1, F.size(parts) - 1))

    def turn(p: Column) -> Column:
        mark = F.locate(">\n", p)
        return F.struct(
            unescape(F.substring(p, len(OPEN) + 1, mark - len(OPEN) - 1), role=True).alias("role"),
            unescape(F.substring(p, mark + 2, F.char_length(p))).alias("text"))

    def loss(p: Column, s: Column) -> Column:
        return unescape(F.substring(p, (s["loss_start"] - s["start"] + 1).cast("int"), (s["loss_end"] - s["loss_start"]).cast("int")))

    return cut.select(
        "conv_id", "formatted", F.transform("_parts", turn).alias("turns"),
        F.filter(F.zip_with("_parts", "spans", loss), lambda x: x.isNotNull()).alias("losses"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def chat_table(turns: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    back = read_back(format_chats(turns_as_events(turns)))
    loss = F.array_join("losses", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
