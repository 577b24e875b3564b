"""Rendered message parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.text import escape_html, render_head, render_html, render_msg_id
from ..llm.blocks import small_batches

_PART_OPEN, _PART_CLOSE = "<code>part: ", "</code>\n"


def cut_text(text: str, room: int) -> list[str]:
    """Pieces of at most ``room`` characters, ending at a line or word break when one lies
    in the last fifth of the piece."""
    pieces, at = [], 0
    while at < len(text):
        end = at + room
        if end < len(text):
            for mark in ("\n", " "):
                where = text.rfind(mark, at, end)
                if where - at > room * 0.8:
                    end = where + 1
                    break
        pieces.append(text[at:end])
        at = end
    return pieces


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, room in parts:
        out = pd.Series([cut_text(t, int(r)) for t, r in zip(text, room)])
        del text, room  # not held beside the pieces while these are written
        yield out


def iso(ts):
    """ISO-8601 text; fractions only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.when(exact.endswith(".000000"), whole).otherwise(exact), F.lit(""))


def split_parts(messages: DataFrame, max_len: int = fixed.MAX_PART_CHARS, sender_id: str | None = None) -> DataFrame:
    """``(msg_id, render_id, date, sender, part, content)``; ``part`` is null for whole messages.

    Messages that fit never leave the JVM; only longer ones go through the splitter, in batches
    that a few long texts do not make large.
    """
    small_batches(messages.sparkSession)
    date = iso(F.col("ts"))
    sender = F.coalesce("from_id", F.lit(fixed.UNKNOWN_SENDER))
    text = F.coalesce("text", F.lit(""))
    sid = F.col(sender_id) if sender_id else None
    base = messages.select(
        "msg_id",
        render_msg_id(F.col("msg_id")).alias("render_id"),
        date.alias("date"),
        sender.alias("sender"),
        text.alias("body"),
        *([sid.alias("sender_id")] if sid is not None else []),
    )
    sid = F.col("sender_id") if sid is not None else None
    full = base.withColumn("full", render_html(F.col("render_id"), F.col("date"), F.col("sender"), F.col("body"), sid))
    head = render_head(F.col("render_id"), F.col("date"), F.col("sender"))
    overhead = len(_PART_OPEN) + 1 + len(_PART_CLOSE) + len("<pre></pre>")
    room = F.lit(max_len - overhead) - F.char_length("head")
    short = full.filter(F.char_length("full") <= max_len).select(
        "msg_id", "render_id", "date", "sender", F.lit(None).cast("int").alias("part"), F.col("full").alias("content")
    )
    long = full.filter(F.char_length("full") > max_len).withColumn("head", head).withColumn("room", room)
    truncated = long.filter(F.col("room") <= 0).select(
        "msg_id", "render_id", "date", "sender", F.lit(None).cast("int").alias("part"), F.substring("full", 1, max_len).alias("content")
    )
    cut = (
        long.filter(F.col("room") > 0)
        .select("msg_id", "render_id", "date", "sender", "head", F.posexplode(_cut(escape_html(F.col("body")), F.col("room"))).alias("at", "piece"))
        .select(
            "msg_id",
            "render_id",
            "date",
            "sender",
            (F.col("at") + 1).alias("part"),
            F.concat("head", F.lit(_PART_OPEN), (F.col("at") + 1).cast("string"), F.lit(_PART_CLOSE), F.lit("<pre>"), "piece", F.lit("</pre>")).alias("content"),
        )
    )
    return short.unionByName(truncated).unionByName(cut)
