"""Chat transcripts by event sourcing.

A log of events is folded into the messages that stand at its end, and these are rendered as a transcript. Events are
partitioned by conversation and message and sorted by sequence:

* ``message`` gives a message its role and text, ``delta`` appends to it, ``edit`` gives it a new text;
* ``regenerate`` gives it a new text and discards the later messages of the conversation that were there before: what is discarded comes back by a ``message`` event only;
* ``delete`` takes it away, until an event other than ``delta`` gives it a text again.

A message's role is the last that a message, edit or regenerate event gave it; those but ``message`` may leave it as it is.

Only windows and aggregates are used, partitioned by message and by conversation, so only the rendered transcript has to fit
into one row.

Defined results: events without conversation or message number are ignored; a null text counts as empty, the null role of a message event as "user", a null sequence as before all others, an
unknown or null kind as ``message``; a message that no event gives a role has that of its deltas, or "user"; a message without a ``message`` event is there from its first event on; events of equal sequence are folded in the order of kind, role and text, and an event that is repeated in all columns
counts once; a message without text is rendered empty; a conversation without messages has no row; markers of the
template inside a text are broken up by a zero-width space, so no text can open or close a message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

KINDS = ("message", "delta", "edit", "regenerate", "delete")


@dataclass(frozen=True)
class Params:
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"


def events(conversations: DataFrame, seq: str = "turn", kind: str | None = None, message: str = "turn") -> DataFrame:
    """The log of a table (conv_id, turn, role, text): each row is a message event, in the order of turns. Logs of other events name the columns
    of their sequence, kind and message number; other columns, whatever they are called, don't matter."""
    what = F.lower(F.col(kind).cast("string")) if kind else F.lit("message")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col(seq).cast("long"), F.lit(-(2**63))).alias("seq"),
        F.coalesce(F.when(what.isin(*KINDS), what), F.lit("message")).alias("kind"),
        F.col(message).cast("long").alias("message"),
        F.coalesce(F.col("role").cast("string"), F.when(~F.coalesce(what.isin(*KINDS[1:]), F.lit(False)), "user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages that stand after all events."""
    log = log.where("conv_id is not null and message is not null").distinct().withColumn("o", F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).when(F.col("kind") == "delta", 3).otherwise(4))
    by = Window.partitionBy("conv_id", "message").orderBy(F.col("seq").asc_nulls_first(), "o", "role", "text")
    log = log.withColumn("k", F.row_number().over(by))
    own = Window.partitionBy("conv_id", "message")
    log = log.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("k"))).over(own))
    is_live = F.col("reset").isNull() | (F.col("k") >= F.col("reset"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(is_live, F.struct("k", "text")))), lambda x: x["text"]), "")
    given = lambda of: F.max(F.when(F.col("role").isNotNull() & of, F.struct("k", "role"))).getField("role")
    folded = log.groupBy("conv_id", "message").agg(
        told.alias("text"),
        F.coalesce(F.max(F.when(F.col("kind") == "message", F.col("seq"))), F.min("seq")).alias("since"),
        F.max(F.when(is_live & (F.col("kind") == "delete"), F.lit(True))).alias("gone"),
        F.coalesce(given(F.col("kind").isin("message", "edit", "regenerate")), given(F.col("kind") == "delta"), F.lit("user")).alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    return folded.withColumn("cut", F.max("redone").over(before)).where("gone is null and (cut is null or since > cut)").select("conv_id", "message", "role", "text")


def render(msgs: DataFrame, p: Params = Params()) -> DataFrame:
    """(conv_id, n_messages, transcript)."""
    text = F.col("text")
    for marker in (p.open, p.close):
        text = F.replace(text, F.lit(marker), F.lit(marker[0] + "​" + marker[1:]))
    line = F.concat(F.lit(p.open), "role", F.lit("\n"), text, F.lit(p.close + "\n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message", line.alias("line")))), lambda x: x["line"]), "")
    return msgs.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n_messages"), whole.alias("transcript"))


def format_chats(conversations: DataFrame, p: Params = Params()) -> DataFrame:
    return render(messages(events(conversations)), p)
