"""Conversations from event logs, rendered as training text with a loss mask, in DataFrame operations alone.

A log has one row per event: ``conv_id``, ``turn`` (key and place of a message in its conversation), ``seq`` (order of
the events of a conversation), ``kind``, ``role`` and ``text``. Events fold into messages:

* ``open`` starts a message with its role and perhaps a first text;
* ``delta`` appends to the message;
* ``edit`` replaces its text;
* ``regenerate`` empties it and withdraws all later messages as they stood: an event before it in the log counts for
  nothing in a message behind it.

The fold keeps, for each message, what stands from its last start on, so superseded drafts are dropped before any text
is brought together, and a conversation of any length is dealt by message. Rendering marks turns by control strings;
those inside texts get a backslash behind their first character (and backslashes are doubled), which reads back
exactly.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import stored, whole_text

STARTS = ("open", "edit", "regenerate")
CHUNK_CHARS = 1_024  # code points of a streamed delta in the derived log


@dataclass(frozen=True)
class Template:
    """Control strings around a turn's text, by role; ``other`` also holds the role's name.

    A text is parted from its control strings by blanks, and control strings hold none, so no text can build a
    control string together with its surroundings.
    """

    begin: str = "<s>"
    roles: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    nobody: tuple[str, str] = ("[NONE]", "[/NONE]")
    learned: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [c for c in dict.fromkeys([self.begin, *sum(self.roles.values(), ()), *self.other, *self.nobody]) if c]

    def __post_init__(self):
        marks = self.controls()
        if any(" " in c or "\\" in c or len(c) < 2 for c in marks):
            raise ValueError("control strings must have two characters or more, without blanks and backslashes")
        if any(a != b and any(b.startswith(a[k:]) for k in range(len(a))) for a in marks for b in marks):
            raise ValueError("control strings must not begin where another one goes on")
        if sum(not a for a, _ in self.roles.values()) > 1 or any(not b for _, b in self.roles.values()):
            raise ValueError("only one role may go without a control string ahead")

    def around(self, role: Column) -> tuple[Column, Column]:
        """What stands before and behind the text of a turn, blanks included."""
        first, last = (F.concat(F.lit(self.other[0] + " "), self.escaped(role), F.lit(f" {self.other[1]} ")), F.lit(" " + self.other[2]))
        for name, (a, b) in self.roles.items():
            first = F.when(role == name, F.lit(a + " ")).otherwise(first)
            last = F.when(role == name, F.lit(" " + b)).otherwise(last)
        none = role.isNull()
        return F.when(none, F.lit(self.nobody[0] + " ")).otherwise(first), F.when(none, F.lit(" " + self.nobody[1])).otherwise(last)

    def escaped(self, text: Column) -> Column:
        marks = "|".join(rf"\Q{c[0]}\E(?=\Q{c[1:]}\E)" for c in self.controls())
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), marks, r"$0\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(\\?)", "$1")

    def turn_pattern(self) -> str:
        """A whole turn; the one kind without a control string ahead begins with the blank alone."""
        kinds = [*self.roles.values(), self.nobody, (self.other[0], self.other[2])]
        return "(?s)" + "|".join((rf"\Q{a}\E" if a else "") + rf" .*? \Q{b}\E" for a, b in kinds)

    def parsed(self, turn: Column) -> tuple[Column, Column]:
        """Role and text of a rendered turn, still escaped."""

        def inner(a: str, b: str) -> Column:
            return F.substring(turn, F.lit(len(a) + 2), F.char_length(turn) - (len(a) + len(b) + 2))

        named = inner(self.other[0], self.other[2])
        middle = f" {self.other[1]} "
        at = F.instr(named, middle)
        role, text = F.substring(named, F.lit(1), at - 1), F.substring(named, at + len(middle), F.char_length(named))
        none = F.startswith(turn, F.lit(self.nobody[0] + " "))
        role = F.when(none, F.lit(None).cast("string")).otherwise(self.unescaped(role))
        text = F.when(none, inner(*self.nobody)).otherwise(text)
        for name, (a, b) in self.roles.items():
            own = F.startswith(turn, F.lit(a + " "))
            role, text = F.when(own, F.lit(name)).otherwise(role), F.when(own, inner(a, b)).otherwise(text)
        return role, text


def _same(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])


def _standing(events: DataFrame) -> DataFrame:
    """Per message its role, its last start and the newest regeneration ahead of it in the conversation.

    The newest regeneration is a running maximum along the turns. It runs inside ranges of turns, and what the ranges
    before add comes from a table of one row per conversation and range, so no conversation has to fit a task.
    """
    kind, seq = F.col("kind"), F.struct(F.col("seq"))
    messages = stored(
        events.groupBy("conv_id", "turn").agg(
            F.max_by("role", F.when(F.col("role").isNotNull(), seq)).alias("role"),
            F.max(F.when(kind.isin(*STARTS), seq)).alias("started"),
            F.max(F.when(kind == "regenerate", seq)).alias("redone"),
        ),
        "messages",
    )
    ranged = stored(messages.repartitionByRange("conv_id", "turn").withColumn("range", F.spark_partition_id()), "ranged")
    ahead = Window.unboundedPreceding, -1
    carried = ranged.groupBy("conv_id", "range").agg(F.max("redone").alias("most"))
    carried = carried.select("conv_id", "range", F.max("most").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(*ahead)).alias("before"))
    inside = F.max("redone").over(Window.partitionBy("conv_id", "range").orderBy("turn").rowsBetween(*ahead))
    ranged = ranged.select("conv_id", "turn", "role", "started", "range", inside.alias("inside"))
    return ranged.join(carried, _same(ranged, carried, ("conv_id", "range")), "left").select(
        ranged["conv_id"], "turn", "role", "started", F.greatest("inside", "before").alias("withdrawn")
    )


def messages_of(events: DataFrame) -> DataFrame:
    """Fold a log: ``conv_id, turn, role, text``, one row for each message that stands.

    Events of other kinds count for nothing; a null text adds nothing. A message without an ``open`` begins with its
    first event; its role is the newest one given, or null. Null ids and turns are values like others, before all
    others. Of events with equal ``seq``, deltas of a message join in the order of their texts, behind its start, and a
    regeneration withdraws the others too; repeated events count each. An empty log gives an empty table; further columns are ignored. A message must fit a row.
    """
    log = events.select("conv_id", "turn", "seq", "kind", "role", "text").where(F.col("kind").isin(*STARTS, "delta"))
    standing = _standing(log)
    seq = F.struct(log["seq"])
    kept = log.join(standing.withColumnsRenamed({"role": "last_role"}), _same(log, standing, ("conv_id", "turn"))).where(
        (F.col("started").isNull() | (seq >= F.col("started"))) & (F.col("withdrawn").isNull() | (seq > F.col("withdrawn")))
    )
    parts = F.sort_array(F.collect_list(F.struct(log["seq"], whole_text("text").alias("text"))))
    folded = kept.select(log["conv_id"], log["turn"], log["seq"], "text", "last_role").groupBy("conv_id", "turn")
    return folded.agg(F.first("last_role").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def rendered(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, n_turns, formatted, loss``: one row for each conversation.

    ``loss`` has an entry for each turn, its ``start`` and ``length`` in code points of ``formatted`` where the turn
    is to be learned and null elsewhere; a span covers the text alone. Messages go by ``turn``, nulls first, equal
    ones by role and text; repeated messages stay. Roles without control strings of their own are written by name.
    A conversation must fit a row.
    """
    before, behind = template.around(F.col("role"))
    text = template.escaped(whole_text("text"))
    pieces = messages.select("conv_id", "turn", "role", F.col("text").alias("plain"), before.alias("before"), text.alias("text"), behind.alias("behind"))
    pieces = pieces.withColumns({"head": F.char_length("before").cast("long"), "body": F.char_length("text").cast("long"), "tail": F.char_length("behind")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain")
    earlier = F.coalesce(F.sum(F.col("head") + F.col("body") + F.col("tail")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(
        F.col("role").isin(*template.learned),
        F.struct((earlier + len(template.begin) + F.col("head")).cast("long").alias("start"), F.col("body").alias("length")),
    )
    placed = pieces.select("conv_id", F.row_number().over(order).alias("at"), F.concat("before", "text", "behind").alias("piece"), span.alias("span"))
    turns = F.sort_array(F.collect_list(F.struct("at", "piece", "span")))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(template.begin), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("loss"),
    )


def read_back(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, at, role, text, learned, formatted_chars``: the turns of rendered conversations and the text under
    the loss mask, with the length of the whole.

    Turns are found by the control strings alone, texts are unescaped; ``learned`` is cut from the rendered text by
    the mask's span and null where there is none.
    """
    found = F.regexp_extract_all("formatted", F.lit(template.turn_pattern()), F.lit(0))
    body = F.substring("formatted", F.lit(len(template.begin) + 1), F.char_length("formatted"))
    chars = F.char_length("formatted").cast("long").alias("formatted_chars")
    whole = conversations.select("conv_id", body.alias("formatted"), "loss", chars)
    turns = whole.select("conv_id", "formatted_chars", F.posexplode(F.arrays_zip(found.alias("piece"), F.col("loss"))).alias("at", "turn"))
    turns = turns.select("conv_id", "formatted_chars", "at", F.col("turn.piece").alias("piece"), F.col("turn.loss").alias("span"))
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("piece").cast("long")).over(earlier), F.lit(0)) + len(template.begin)
    role, text = template.parsed(F.col("piece"))
    under = F.substring("piece", (F.col("span.start") - F.col("begin") + 1).cast("int"), F.col("span.length").cast("int"))
    return turns.withColumn("begin", begin).select(
        "conv_id", "at", role.alias("role"), template.unescaped(text).alias("text"), template.unescaped(under).alias("learned"), "formatted_chars"
    )


def conversation_digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what reads back from rendered conversations: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``."""
    turns = read_back(conversations, template).withColumn(
        "whole", F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), "text", F.lit("\n"))
    )
    both = F.sort_array(F.collect_list(F.struct("at", "whole", F.coalesce("learned", F.lit("")).alias("learned"))))
    read = turns.groupBy("conv_id").agg(both.alias("turns"), F.first("formatted_chars").alias("formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: t["whole"]), ""), 256).alias("turns_sha256"),
        F.array_join(F.transform("turns", lambda t: t["learned"]), "").alias("learned"),
        "formatted_chars",
    )
    return read.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def streamed_log(rows: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A log that ends in the given messages (``conv_id, turn, role, text``), as a chat service would have written it.

    Assistant texts begin with a draft that another message follows; a regeneration withdraws both, and the text
    streams in as deltas. All other texts are opened with a draft and edited. Rows of one turn are messages of their
    own, ordered by the digest of role and text; equal rows are counted and numbered, so they stay apart.
    """
    text = whole_text("text")
    counted = rows.groupBy("conv_id", "turn", "role", text.alias("text")).count()
    digest = F.unhex(F.md5(F.encode(F.concat(F.coalesce(F.concat(F.lit("r"), "role"), F.lit("n")), F.lit("\n"), "text"), "utf-8")))
    copies = counted.select("conv_id", "turn", "role", "text", digest.alias("hash"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))

    def key(follows: int) -> Column:
        return F.struct("turn", "hash", "copy", F.lit(follows).alias("follows"))

    def event(step: Column, kind: str, content: Column, follows: int = 0, role: Column = F.col("role")) -> Column:
        return F.struct(key(follows).alias("turn"), F.struct(key(0).alias("of"), step.cast("int").alias("step")).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), content.alias("text"))

    none, draft = F.lit(None).cast("string"), F.left("text", F.lit(chunk_chars))
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    streamed = F.concat(
        F.array(
            event(F.lit(0), "open", none),
            event(F.lit(1), "delta", draft),
            event(F.lit(2), "open", draft, 1, F.lit("user")),
            event(F.lit(3), "delta", draft, 1),
            event(F.lit(4), "regenerate", none),
        ),
        F.transform(chunks, lambda c, i: event(i + 5, "delta", c)),
    )
    edited = F.array(event(F.lit(0), "open", draft), event(F.lit(1), "delta", draft), event(F.lit(2), "edit", F.col("text")))
    steps = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    return copies.select("conv_id", F.explode(steps).alias("event")).select("conv_id", "event.*")


def formatted_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Write rows of messages as a log, fold it, render the conversations and return the digests of what reads back.

    One row for each ``conv_id`` of ``rows``, null included; null texts are empty, null roles read back as none (and
    as empty in the digest). Turns that tie go by the digest of role and text, and repeated rows are turns each. An
    empty table gives an empty one; further columns are ignored. Texts and conversations must fit a row (2 GB).
    """
    log = streamed_log(rows.select("conv_id", "turn", "role", "text"))
    return conversation_digests(rendered(messages_of(log), template), template)
