"""Chat formatting with typed content parts.

A visitor turns each content part of a turn into text: text parts are escaped,
image, audio and document parts become numbered placeholders, and what they
refer to is recorded with the number of tokens they expand to. DataFrame
operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Characters that begin the control strings of this and of other templates, and what stands for them. ``&`` makes it reversible.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
LINE = ("\n", "&#10;")  # in a role, which ends with its line
PATCH = 28  # pixels to a side of one image token
AUDIO_RATE = 25  # tokens for each second
PAGE_TOKENS = 1024  # for each page of a document

PARTS = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _image(part: Column) -> Column:
    side = [F.ceil(F.coalesce(part[x], F.lit(0)) / PATCH) for x in ("width", "height")]
    return side[0] * side[1]


def _audio(part: Column) -> Column:
    return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)


def _document(part: Column) -> Column:
    return F.coalesce(part["pages"], F.lit(0)).cast("bigint") * PAGE_TOKENS


#: What a visit of an attachment of each type counts as its expanded tokens.
VISITORS: dict[str, Callable[[Column], Column]] = {"image": _image, "audio": _audio, "document": _document}


def _visit(part: Column, turn: Column, at: Column) -> Column:
    """(shown, attachment): a part's text in the output, and the reference of any part but text."""
    shown, tokens = escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("bigint")
    name = F.concat(F.lit("<|"), part["type"], F.lit(":"), turn.cast("string"), F.lit("."), at.cast("string"), F.lit("|>"))
    attached = part["type"].isin(*VISITORS)
    for kind, count in VISITORS.items():
        tokens = F.when(part["type"] == kind, count(part)).otherwise(tokens)
    return F.struct(F.when(attached, name).otherwise(shown).alias("shown"),
                    F.when(attached, F.struct(name.alias("placeholder"), part["type"].alias("type"), part["ref"].alias("ref"),
                                              tokens.alias("tokens"))).alias("attachment"))


def format_chat(turns: DataFrame, parts: str = "parts", conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                learn: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, mask, attachments, attachment_tokens)``, a row for each conversation.

    ``turns`` has a row for each turn with its content in ``parts`` (of type
    ``PARTS``). ``formatted`` is the turns in order, each ``<|turn|>role``, a new
    line, the parts and ``<|end|>`` with a new line; equal turn numbers are
    ordered by role and content, and null ones come first. ``mask`` has, for each
    turn of role ``learn``, the turn's place and where its content is in the turn's
    string (from 0, in code points). Placeholders are ``<|type:turn.part|>`` with both
    numbers from 0. A part of null or unknown type is text; null texts, roles and
    parts are empty, a null conv_id is a conversation. No rows in, no rows out.

    A conversation is one value of the result, so its rows meet in one task.
    """
    none = F.array().cast(PARTS)
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(parts).cast(PARTS), none).alias("parts"))
    grouped = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    visited = grouped.select("conv_id", F.transform("turns", lambda t, i: F.struct(
        t["role"].alias("role"),
        F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(LINE[0]), F.lit(LINE[1])), F.lit("\n")).alias("head"),
        F.transform(t["parts"], lambda p, j: _visit(p, i, j)).alias("parts"))).alias("turns"))
    built = visited.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["head"].alias("head"),
        F.array_join(F.transform(t["parts"], lambda p: p["shown"]), "").alias("body"),
        F.filter(F.transform(t["parts"], lambda p: p["attachment"]), lambda a: a.isNotNull()).alias("attachments"))).alias("turns"))
    return built.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == learn, F.struct(
            i.alias("turn"), F.length(t["head"]).alias("start"), F.length(t["body"]).alias("length")))),
            lambda m: m.isNotNull()).alias("mask"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_chat(chats: DataFrame) -> DataFrame:
    """``chats`` with what its ``formatted`` and ``mask`` say: ``turns`` (role, text) and ``learned``, the text under the mask.

    Texts come back as they were before formatting; placeholders stay.
    """
    pieces = F.split("formatted", CLOSE.replace("|", "\\|"), -1)
    cut = chats.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))  # the last one is what follows the last turn: nothing

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        head = F.substring_index(rest, "\n", 1)
        return F.struct(unescape(F.replace(head, F.lit(LINE[1]), F.lit(LINE[0]))).alias("role"),
                        unescape(F.substring(rest, F.length(head) + 2, F.length(rest))).alias("text"))

    learned = F.transform("mask", lambda m: unescape(F.substring(F.element_at("pieces", m["turn"] + 1), m["start"] + 1, m["length"])))
    return (cut.withColumn("turns", F.transform("pieces", turn)).withColumn("learned", F.array_join(learned, "")).drop("pieces"))
