"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: `delta` appends text to a message, `edit` replaces it,
`regenerate` empties it, so that later deltas write it anew. Events are folded in order of
sequence into final messages, first by message, then the messages are rendered by conversation
with a loss mask over what the assistant says.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts
every `<`, backslashes, `|` gets one more backslash, so that no control string is left in
them; `parse` takes it away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
NEWLINE = "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at the first line feed, so its own are written as a control string."""
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def log_of(messages: DataFrame, pieces: int = 4) -> DataFrame:
    """(conv_id, msg, seq, kind, role, text): a log that folds into (conv_id, msg, role, text), as a chat service would write it.

    Each message streams in up to `pieces` deltas. By a hash of conversation and message, a third
    of them first streams a draft (the text reversed) that is regenerated, another third is
    edited: a draft is replaced by the first piece, and what follows is streamed after it. The
    events of a message come in no order. A null text has one empty delta.
    """
    text = F.coalesce("text", F.lit(""))
    width = F.greatest(F.ceil(F.length(text) / pieces), F.lit(1)).cast("int")
    way = F.pmod(F.xxhash64("conv_id", "msg"), F.lit(3))
    event = lambda seq, kind, role, said: F.struct(F.lit(seq).cast("int").alias("seq") if isinstance(seq, int) else seq.cast("int").alias("seq"), kind.alias("kind"), role.alias("role"), said.alias("text"))
    none = F.lit(None).cast("string")
    final = F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda i: event(i + 3, F.when((way == 2) & (i == 0), "edit").otherwise("delta"), F.when(i == 0, F.col("role")), F.substring(text, i * width + 1, width)),
    )
    draft = F.array(event(0, F.lit("delta"), F.col("role"), F.reverse(text)), event(1, F.lit("delta"), none, F.lit("...")))
    again = F.array(event(2, F.lit("regenerate"), none, none))
    events = F.when(way == 0, final).when(way == 1, F.concat(final, again, draft)).otherwise(F.concat(final, draft))
    return messages.select("conv_id", "msg", F.inline(F.reverse(events)))


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text) from events (conv_id, msg, seq, kind, role, text).

    Events are in order of (seq, kind, text); the last role given is the message's. A null
    text is empty, an unknown kind counts as delta, null ids are groups of their own.
    """
    last = Window.partitionBy("conv_id", "msg")
    text = F.coalesce("text", F.lit(""))
    reset = F.coalesce(F.col("kind").isin("edit", "regenerate"), F.lit(False))
    # Only events from the last edit or regeneration on are gathered.
    alive = events.select("conv_id", "msg", "seq", "kind", "role", text.alias("text"), F.max(F.when(reset, F.struct("seq", "kind", text))).over(last).alias("_reset"))
    alive = alive.withColumn("_in", F.col("_reset").isNull() | (F.struct("seq", "kind", "text") >= F.col("_reset")))
    said = F.when(F.col("_in"), F.struct("seq", "kind", F.when(F.coalesce(F.col("kind") == "regenerate", F.lit(False)), "").otherwise(F.col("text")).alias("text")))
    return alive.groupBy("conv_id", "msg").agg(
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role")))["role"].alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): the rendered conversation, and the loss mask as spans (start, length) in code points.

    Messages are in order of (msg, role, text); a null role is empty.
    """
    turn = F.struct(
        F.col("msg").alias("msg"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    whole = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    length = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + length(x)).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), spans["mask"].alias("mask"))


def format_chat(events: DataFrame) -> DataFrame:
    """Fold a log into messages and render each conversation.

    Events have conv_id, msg (the place of the message), seq, kind, role, text; other columns
    are not read. An empty log gives no conversation. Repeated deltas count each time.
    """
    return render(fold_messages(events))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): what a formatted conversation and its mask say, read back and unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("mask", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")
