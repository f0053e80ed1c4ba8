"""Chat formatting from an event log: streamed pieces, edits and regenerations are folded into final messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """``text`` without the start of any control string; ``unescaped`` gives it back exactly."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """As ``escaped``, and on one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\!"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\!"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log with columns conv_id, seq, turn, kind, role, text: conv_id, turn, role, text.

    Kinds, in order of ``seq`` within one conversation and turn: ``message`` and ``edit`` set the whole text,
    ``delta`` appends to it, ``regenerate`` empties it (the pieces of the new answer follow), ``delete`` removes the
    message unless something later sets it again; an unknown or null kind counts as ``message``. The events of one
    message meet in one row, never those of a conversation. A null text is empty; the role is the last one
    that is not null, or ``user``. Null ``seq`` comes first, ties are ordered by kind and text, repeated deltas count
    each. Null conversations or turns are keys like others.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate", "delete"), F.col("kind")).otherwise("message")
    log = events.select("conv_id", "turn", F.coalesce(F.col("seq").cast("long"), F.lit(-(2 ** 63))).alias("seq"),
                        kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct("seq", "kind", "text")
    pieces = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role")))
    folded = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") != "delta", order)).alias("base"), pieces.alias("pieces"))
    last = F.col("base")
    later = F.filter("pieces", lambda p: (p["kind"] == "delta") & (
        last.isNull() | (F.struct(p["seq"], p["kind"], p["text"]) > last)))
    start = F.when(last["kind"].isin("message", "edit"), last["text"]).otherwise("")
    roles = F.filter("pieces", lambda p: p["role"].isNotNull())
    gone = (last["kind"] == "delete") & (F.size(later) == 0)
    return folded.filter(~F.coalesce(gone, F.lit(False))).select(
        "conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("user")).alias("role"),
        F.concat(start, F.array_join(F.transform(later, lambda p: p["text"]), "")).alias("text"))


def render_chat(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    A turn is ``<|im_start|>`` role newline text ``<|im_end|>`` newline; role and text are escaped, so no control string
    can come from them. ``loss_spans`` has the [start, end) byte offsets of every assistant text in the UTF-8 output.
    Offsets are running sums over the turns of a conversation; the output itself is one value per conversation.
    """
    role = escaped_role(F.coalesce("role", F.lit("user")))
    text = escaped(F.coalesce("text", F.lit("")))
    parts = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"),
                            F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"))
    tail = f"{CLOSE}\n"
    width = F.octet_length("head") + F.octet_length("body") + len(tail)
    order = ["turn", "role", "body"]
    before = Window.partitionBy("conv_id").orderBy(*order)
    placed = parts.withColumn("end", F.sum(width.cast("long")).over(
        before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - len(tail))
    start = F.col("end") - F.octet_length("body")
    turn = F.struct("end", F.concat("head", "body", F.lit(tail)).alias("part"), start.alias("start"),
                    (F.col("role") == "assistant").alias("loss"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]),
                    lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"))


def format_chat(events: DataFrame) -> DataFrame:
    """Fold an event log and render each conversation; see ``fold_events`` and ``render_chat``."""
    return render_chat(fold_events(events))


def read_chat(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, formatted, turns (role, text), loss_texts (under the mask, in order)."""
    blocks = F.filter(F.split("formatted", F.lit("<\\|im_start\\|>")), lambda b: b != "")
    body = lambda b: F.substring_index(b, CLOSE, 1)
    role = lambda b: F.substring_index(body(b), "\n", 1)
    turns = F.transform(blocks, lambda b: F.struct(
        unescaped_role(role(b)).alias("role"),
        unescaped(F.substr(body(b), F.char_length(role(b)) + 2)).alias("text")))
    raw = F.encode("formatted", "UTF-8")
    under = F.transform("loss_spans", lambda s: unescaped(F.decode(
        F.substr(F.col("raw"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8")))
    return (chats.withColumn("raw", raw)
            .select("conv_id", "formatted", turns.alias("turns"), under.alias("loss_texts")))
