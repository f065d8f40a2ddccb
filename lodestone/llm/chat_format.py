"""Chat formatting: conversations of typed content parts to one marked text each, in DataFrame operations only.

A turn is ``<|turn|>role<|says|>body<|end|>``. A visitor turns each part of a body into text: text parts as they are
(escaped), images, audio and documents into a placeholder. Adjacent parts are joined by ``<|part|>``. Control strings
all start with ``<|``; in roles and texts every ``<``, backslashes, ``|`` gets one more backslash, so no control string
can appear there, other text stays as it is, and ``unescape`` gives back the original.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The type of a content part; unused fields are null.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings (each starts with ``<|``), roles under the loss mask, and how far placeholders expand."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>"
    part: str = "<|part|>"
    learned_roles: tuple[str, ...] = ("assistant",)
    patch: int = 28  # pixels of a side of an image patch, a token each
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 256  # tokens a page


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


class PartVisitor:
    """One method for each kind of part; each gives the part's text and its expanded token count as expressions."""

    def __init__(self, template: ChatTemplate):
        self.t = template

    def visit_text(self, p: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(p["text"], F.lit(""))), F.lit(0).cast("long")

    def visit_image(self, p: Column) -> tuple[Column, Column]:
        side = lambda x: F.greatest(F.lit(1), F.ceil(F.coalesce(x, F.lit(0)) / self.t.patch))
        return F.lit("<|image|>"), (side(p["width"]) * side(p["height"])).cast("long")

    def visit_audio(self, p: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.greatest(F.lit(1), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * self.t.audio_rate)).cast("long")

    def visit_document(self, p: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), (F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(0))) * self.t.page_tokens).cast("long")

    def visit(self, p: Column) -> Column:
        """``struct<text, attachment>``; a part of unknown or null kind is taken as text, and what it refers to is recorded under its kind, with no tokens."""
        text, _ = self.visit_text(p)
        other = F.coalesce(p["kind"], F.lit("unknown"))
        attachment = F.when(p["ref"].isNotNull() & (other != "text"), F.struct(other.alias("kind"), p["ref"].alias("ref"), F.lit(0).cast("long").alias("tokens")))
        for kind in ("image", "audio", "document"):
            mark, tokens = getattr(self, f"visit_{kind}")(p)
            is_kind = p["kind"] == kind
            text = F.when(is_kind, mark).otherwise(text)
            attachment = F.when(is_kind, F.struct(F.lit(kind).alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))).otherwise(attachment)
        return F.struct(text.alias("text"), attachment.alias("attachment"))


def text_part(text: Column) -> Column:
    """A plain text as the parts of a turn; null counts as empty."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str | Column = "parts") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask, attachments, expanded_tokens``.

    ``turns`` has a row per turn; ``parts`` is an ``array<PART>`` column or expression. ``mask`` has an entry for each turn,
    null outside the loss, else ``struct<start, begin, length>``: ``start`` counts code points from the beginning of
    ``formatted``, ``begin`` those from the beginning of the turn, ``length`` covers the body. ``attachments`` are in reading order
    with their turn. Turns go by ``turn``, then role, then text (null first), so ties and repeated rows have one order; each
    row is a turn. A null role counts as empty, no parts as an empty body; null ids form one conversation; an empty table gives
    an empty one. Other columns are not read. Each turn is formatted before the shuffle; offsets are running sums in a sorted
    window, so a very long conversation costs time in proportion to its length.
    """
    t = template
    parts = F.col(parts) if isinstance(parts, str) else parts
    visited = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), PartVisitor(t).visit)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visited.alias("visited"))
    head = F.concat(F.lit(t.turn), escape(F.col("role")), F.lit(t.says))
    rows = rows.select(
        "conv_id", "turn", "role", head.alias("head"), F.array_join(F.transform("visited", lambda v: v["text"]), t.part).alias("body"),
        F.filter(F.transform("visited", lambda v: v["attachment"]), lambda a: a.isNotNull()).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(t.end)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumns({"place": F.row_number().over(order), "before": before})
    learned = F.col("role").isin(*t.learned_roles)
    span = F.struct((F.col("before") + F.length("head")).alias("start"), F.length("head").alias("begin"), F.length("body").alias("length"))
    each = F.struct("place", F.concat("head", "body", F.lit(t.end)).alias("text"), F.when(learned, span).alias("span"), "attached")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("each"))
    attachments = F.flatten(F.transform("each", lambda e: F.transform(e["attached"], lambda a: F.struct((e["place"] - 1).alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select("conv_id", F.array_join(F.transform("each", lambda e: e["text"]), "").alias("formatted"), F.transform("each", lambda e: e["span"]).alias("mask"), attachments.alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The marked text back as ``array<struct<role, body, marked>>``: role and body unescaped, the turn as it is marked."""
    t = template
    quoted = "\\Q" + t.end + "\\E"
    # split() leaves an empty string after the last end mark
    marked = F.filter(F.split(formatted, quoted), lambda x, i: x.startswith(t.turn))
    head = lambda x: F.substring_index(x, t.says, 1)
    return F.transform(marked, lambda x: F.struct(unescape(F.substr(head(x), F.lit(len(t.turn) + 1))).alias("role"), unescape(F.substr(x, F.length(head(x)) + len(t.says) + 1)).alias("body"), x.alias("marked")))


def masked_text(turns: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; ``turns`` from ``read_turns``."""
    return F.array_join(F.zip_with(turns, mask, lambda x, s: F.when(s.isNull(), F.lit("")).otherwise(unescape(F.substr(x["marked"], s["begin"] + 1, s["length"])))), "")
