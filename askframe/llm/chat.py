"""Conversations as event logs, folded into messages and rendered for training.

An event writes to one message of a conversation, and events are ordered by ``seq``:

* ``open`` begins message ``msg`` with a role; ``delta`` appends text to it;
* ``edit`` replaces the text of ``msg`` so far, later messages stay;
* ``regenerate`` throws away ``msg`` and every later message and opens ``msg`` anew, with its own
  text and role (the assistant's, if null).

The fold needs no state: an event counts unless a later event of its conversation takes it back,
which two windows over one sort tell. Everything is Spark SQL functions.

The template marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts ``&``,
``<`` and ``[`` become character references, so neither this template's control strings nor those
of bracket templates can appear inside a turn; undoing them in reverse order gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What is escaped, in this order; ``&`` first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))


def escape(text: Column, in_role: bool = False) -> Column:
    """``text`` without control characters of templates; roles have no line end either."""
    for plain, coded in ESCAPES if in_role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, in_role: bool = False) -> Column:
    for plain, coded in reversed(ESCAPES if in_role else ESCAPES[:-1]):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def as_events(rows: DataFrame, chunk: int = 256, drafts: bool = False) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: each turn opens a message and streams its text
    in deltas of ``chunk`` code points.

    With ``drafts`` the log also holds what a chat leaves behind, made of the rows themselves: the
    second of every three turns streams its text backwards first and is then edited; the third one
    begins in another role with the text backwards, is followed by a message that is given up, and
    is regenerated. Such a log folds to the same turns.

    Turns equal in number keep apart (ordered by role and text); null turns come first, null roles
    and texts are empty. Returns conv_id, seq, kind, msg, role, text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("role"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
        F.col("text").asc_nulls_first())
    turns = rows.select("conv_id", "turn", "role", "text").withColumn(
        "msg", F.row_number().over(order) - 1)

    def event(kind: str, role: Column | None = None, part: Column | None = None, later: int = 0) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), (F.col("msg") + later).alias("msg"),
            (none if role is None else role).alias("role"), (none if part is None else part).alias("text"))

    def stream(whole: Column) -> Column:
        cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
        return F.transform(cut, lambda part: event("delta", part=part))

    log = F.concat(F.array(event("open", own)), stream(text))
    if drafts:
        draft = stream(F.reverse(text))
        edited = F.concat(
            F.array(event("open", own)), draft, F.array(event("edit", part=F.lit(""))), stream(text))
        again = F.concat(
            F.array(event("open", F.lit("draft"))), draft,
            F.array(event("open", F.lit("user"), later=1), event("delta", part=own, later=1),
                    event("regenerate", own)), stream(text))
        place = F.col("msg") % 3
        log = F.when(place == 1, edited).when(place == 2, again).otherwise(log)
    return turns.select("conv_id", "msg", F.posexplode(log).alias("n", "e")).select(
        "conv_id", F.struct("msg", "n").alias("seq"), "e.kind", "e.msg", "e.role", "e.text")


def known_kind() -> Column:
    """Whether an event is of a kind that the fold knows; false for null."""
    return F.coalesce(F.col("kind").isin("open", "delta", "edit", "regenerate"), F.lit(False))


def unknown_events(events: DataFrame) -> DataFrame:
    """The events that ``messages`` leaves out, as they are."""
    return events.where(~known_kind())


def messages(events: DataFrame) -> DataFrame:
    """The messages that are left: conv_id, msg, role, text.

    ``events`` has conv_id, seq (any type with an order), kind, msg, role, text. Null texts add
    nothing; a message without an ``open`` left has an empty role; events of an unknown kind count
    for nothing here and are what ``unknown_events`` returns. Events of equal seq are taken in order of kind, role and text. A log without events
    gives no rows. Null conv_id is a conversation of its own.
    """
    # One sort per conversation serves both windows and the grouping by message.
    order = [F.col("seq").asc_nulls_first(), F.col("kind"), F.col("role"), F.col("text")]
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    place = Window.partitionBy("conv_id").orderBy(*order)
    live = (
        events.where(known_kind()).withColumns({
            "role": F.when(F.col("kind") == "regenerate", F.coalesce("role", F.lit("assistant")))
            .otherwise(F.col("role")),
            "text": F.coalesce("text", F.lit("")),
        })
        .withColumns({
            "at": F.row_number().over(place),
            "back_to": F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later),
        })
        .where(F.col("back_to").isNull() | (F.col("msg") < F.col("back_to")))
    )
    parts = F.sort_array(F.collect_list(F.struct("at", "kind", "role", "text")))
    edited = F.array_max(F.transform(
        F.filter("parts", lambda p: p.kind.isin("edit", "regenerate")), lambda p: p["at"]))
    return live.groupBy("conv_id", "msg").agg(parts.alias("parts")).select(
        "conv_id", "msg",
        F.coalesce(F.element_at(F.filter(
            F.transform("parts", lambda p: p.role), lambda r: r.isNotNull()), -1), F.lit("")).alias("role"),
        F.concat_ws("", F.transform(
            F.filter("parts", lambda p: p["at"] >= F.coalesce(edited, F.lit(0))),
            lambda p: p.text)).alias("text"))


def render(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, and the loss mask ``loss``, the spans
    (start from 1, length, in code points of ``formatted``) of the texts of role ``learn``.
    """
    body, at = escape(F.col("text")), Window.partitionBy("conv_id").orderBy("msg")
    pieces = rows.select(
        "conv_id", "msg", (F.col("role") == learn).alias("learn"),
        F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n")).alias("head"),
        body.alias("body"),
    ).withColumn("end", F.sum(
        (F.length("head") + F.length("body") + len(CLOSE)).cast("long")).over(at))
    spot = F.struct(
        (F.col("end") - F.length("body") - len(CLOSE) + 1).alias("start"),
        F.length("body").cast("long").alias("length"))
    turns = F.sort_array(F.collect_list(F.struct(
        "msg", F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.when(F.col("learn"), spot).alias("spot"))))
    return rows_of(pieces.groupBy("conv_id").agg(turns.alias("turns")))


def rows_of(grouped: DataFrame) -> DataFrame:
    """The text and the mask of the collected turns."""
    return grouped.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda t: t.piece)).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.spot.isNotNull()), lambda t: t.spot).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """What the rendered text holds: conv_id, ``turns`` (role, text) and ``loss_text``."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    turns = F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1), True).alias("role"),
        unescape(F.substring(
            b, F.locate("\n", b) + 1,
            F.length(b) - F.locate("\n", b) - len(CLOSE))).alias("text")))
    masked = F.transform("loss", lambda s: unescape(
        F.substring(F.col("formatted"), s.start.cast("int"), s.length.cast("int"))))
    return rendered.select(
        "conv_id", "formatted", turns.alias("turns"), F.concat_ws("", masked).alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """Lengths and SHA-256 of what was read back."""
    listed = F.concat_ws("", F.transform(
        "turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
