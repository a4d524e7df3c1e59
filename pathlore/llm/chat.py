"""Chat formatting: conversations rebuilt from an event log, rendered with a loss mask, read back.

The log has one row per event (conv_id, msg, seq, kind, role, text). ``delta`` appends its text to
the message, ``edit`` replaces what the message holds, ``regenerate`` clears it before appending.
Folding is associative, so a message is folded in slices of its sequence first and the slices
next, and a conversation is joined from pieces of ``TURNS`` turns: no row holds more than one
message, piece or (as the result asks for) rendered conversation. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template. Texts keep no bare "<", "[" or "~", so no control string survives in one.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "</s>"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
SLICE = 256  # events of a message folded at once
TURNS = 64  # turns rendered at once


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def conversation_log(conversations: DataFrame, delta_chars: int = 2048) -> DataFrame:
    """The event log of finished turns: each row becomes the deltas that would have streamed it.

    Rows of one (conv_id, turn) are separate messages, ordered by role and a hash of the text.
    Null text and role are empty. ``seq`` counts deltas of at most ``delta_chars`` code points.
    """
    texts = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # the row number is taken before the deltas are made, so that those of a row share it
    row = F.monotonically_increasing_id().alias("row")
    turns = texts.select("conv_id", F.struct("turn", "role", F.xxhash64("text").alias("digest"), row).alias("msg"), "role", "text")
    last = F.greatest(F.ceil(F.length("text") / delta_chars).cast("int") - 1, F.lit(0))
    deltas = turns.select("conv_id", "msg", F.explode(F.sequence(F.lit(0), last)).alias("seq"), F.lit("delta").alias("kind"), "role", "text")
    return deltas.withColumn("text", F.expr(f"substring(text, seq * {delta_chars} + 1, {delta_chars})"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, piece, msg, role, text) of an event log; ``msg`` is a struct whose
    field ``turn`` numbers the turns, ``piece`` is the turn divided by ``TURNS``.

    The role is that of the message's first event with a role, the text what is left after the
    last ``edit`` or ``regenerate`` and every ``delta`` behind it. Order is by ``seq``, ties by
    kind, role and text. Null text and role are empty, an unknown or null kind counts as
    ``delta``; an exact repeat of an event (same message, seq, kind, role and text) is a second
    delivery and is applied once. Null ids form groups of their own; other columns are dropped.
    """
    event = F.struct(
        "seq",
        F.when(F.col("kind").isin("edit", "regenerate"), F.lit(1)).otherwise(F.lit(0)).alias("reset"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = lambda parts: F.array_join(F.transform(parts, lambda e: e["text"]), "")

    def folded(rows: str) -> list[Column]:
        """(reset seen, first role, text since the last reset) of sorted rows."""
        rows = F.col(rows)
        at = F.size(rows) - F.coalesce(F.array_position(F.transform(F.reverse(rows), lambda e: e["reset"]), 1), F.lit(0)) + 1
        seen = F.array_max(F.transform(rows, lambda e: e["reset"]))
        start = F.when(seen == 1, at).otherwise(F.lit(1)).cast("int")
        role = F.coalesce(F.get(F.filter(rows, lambda e: e["role"] != ""), F.lit(0))["role"], F.lit(""))
        return [seen.alias("reset"), role.alias("role"), whole(F.slice(rows, start, F.size(rows))).alias("text")]

    sliced = (
        events.select("conv_id", F.floor(F.col("msg.turn") / TURNS).alias("piece"), "msg", event.alias("e"))
        .withColumn("slice", F.floor(F.coalesce(F.col("e.seq"), F.lit(-1)) / SLICE))
        .groupBy("conv_id", "piece", "msg", "slice")
        .agg(F.array_sort(F.collect_set("e")).alias("rows"))
        .select("conv_id", "piece", "msg", "slice", *folded("rows"))
    )
    return (
        sliced.repartition("conv_id", "piece")  # serves this grouping and the one that renders pieces
        .groupBy("conv_id", "piece", "msg")
        .agg(F.array_sort(F.collect_list(F.struct("slice", "reset", "role", "text"))).alias("rows"))
        .select("conv_id", "piece", "msg", *folded("rows")[1:])
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row (conv_id, segments, formatted) per conversation, messages in order of ``msg``.

    ``segments`` is the formatted text cut where the loss mask changes: an array of (text, loss)
    whose texts joined are ``formatted``. Only texts of ``loss_role`` are under the mask.
    """
    turn = F.array(
        F.struct(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("role") == loss_role).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
    )
    joined = lambda c: F.flatten(F.transform(F.array_sort(c), lambda p: p["turn"]))
    pieces = (
        messages.select("conv_id", "piece", "msg", turn.alias("turn"))
        .groupBy("conv_id", "piece")
        .agg(joined(F.collect_list(F.struct("msg", "turn"))).alias("turn"))
    )
    whole = pieces.groupBy("conv_id").agg(joined(F.collect_list(F.struct("piece", "turn"))).alias("segments"))
    return whole.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns (array of role, text) and loss text of rendered conversations, from the output alone."""
    opened = F.split("formatted", r"<\|turn\|>")
    bodies = F.transform(F.slice(opened, 2, F.size(opened)), lambda t: F.split(t, r"<\|text\|>"))
    turns = F.transform(
        bodies,
        lambda t: F.struct(
            unescape(t[0]).alias("role"), unescape(F.substring(t[1], F.lit(1), F.length(t[1]) - len(CLOSE))).alias("text")
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return rendered.select("*", turns.alias("turns"), loss.alias("loss_text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Finished conversations as a log, folded, rendered and read back; one row per conv_id.

    An empty table gives no rows; null conv_id is one conversation; null turn sorts first.
    """
    return read_back(render(fold_events(conversation_log(conversations))))
