"""Conversation history: windows, budgets, counters, context packing and prompts."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import Config
from ..functions.text import strip, token_count
from ..session import cut
from .ordered import SEG, numbered, running_sum, segmented, with_halo

TAIL = 5


def speaker_line(role: Column, content: Column) -> Column:
    return F.concat(F.when(role == "user", F.lit("User")).otherwise(F.lit("Bot")), F.lit(": "), content)


def render_history(lines: Column) -> Column:
    """Lines as prompt text; an empty history has a placeholder."""
    text = strip(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return F.when(F.size(lines) == 0, F.lit(fixed.EMPTY_HISTORY)).otherwise(text)


def history_window(turns: DataFrame, n: int = TAIL, key: str = "conv_id", order: str = "turn", parts: int | None = None) -> DataFrame:
    """The n turns before each turn as prompt text, in ``history``."""
    lines = turns.withColumn("_line", speaker_line(F.col("role"), F.col("text")))
    wide = with_halo(numbered(lines, [key], [order], parts=parts), [key], n)
    before = Window.partitionBy(key, SEG).orderBy("_n").rowsBetween(-n, -1)
    return (
        wide.withColumn("history_lines", F.collect_list("_line").over(before))
        .filter(~F.col("_halo"))
        .withColumn("history", render_history(F.col("history_lines")))
        .drop("_line", "_n", SEG, "_halo")
    )


def messages_ordered(messages: DataFrame, limit: int | None = None, per: str | None = None, parts: int | None = None) -> DataFrame:
    """Messages by time then id; ``limit`` counts over all rows, or within each ``per``."""
    if limit is None:
        return messages.orderBy("ts", "msg_id")
    if per is None:
        return messages.orderBy("ts", "msg_id").limit(limit)
    first = Window.partitionBy(per).orderBy("ts", "msg_id")
    return messages.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit).drop("_n")


# --- prompts -----------------------------------------------------------------------


def prompt_tokens(messages: Column) -> Column:
    """Tokens of ``array<struct<role, content>>``: 4 a message, all values, 2 for the reply."""
    return F.aggregate(
        messages,
        F.lit(2),
        lambda acc, m: acc + F.lit(4) + token_count(m["role"]) + token_count(m["content"]),
    )


def pack_context(hits: DataFrame, budget: int = Config.max_context_chars) -> DataFrame:
    """Ranked texts of each query as numbered blocks within a character budget.

    Expects ``query_id, rank, text, topic_l1_title, topic_l2_title``; rows per query are
    the retrieval's k.  The first block over the budget is cut when more than 100
    characters are left, and nothing follows it.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    l1, l2 = F.coalesce("topic_l1_title", F.lit("")), F.coalesce("topic_l2_title", F.lit(""))
    topic = F.concat(
        F.when(l2 != "", F.concat(F.lit("Category: "), l2, F.lit(" > "))).otherwise(F.lit("")),
        F.when(l1 != "", F.concat(F.lit("Topic: "), l1)).otherwise(F.lit("")),
    )
    head = F.concat(
        F.lit("--- Chunk "), F.col("_i").cast("string"),
        F.when(topic != "", F.concat(F.lit(" ("), topic, F.lit(")"))).otherwise(F.lit("")), F.lit(" ---\n"),
    )
    blocks = (
        hits.withColumn("_i", F.row_number().over(order))
        .withColumn("_block", F.concat(head, "text", F.lit("\n\n")))
        .withColumn("_len", F.char_length("_block"))
        .withColumn("_cum", F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    left = F.lit(budget) - (F.col("_cum") - F.col("_len"))
    over_before = F.coalesce(F.max(F.col("_cum") > budget).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    piece = (
        F.when(F.col("_cum") <= budget, F.col("_block"))
        .when(~over_before & (left > 100), F.concat(F.expr(f"substring(_block, 1, cast({budget} - (_cum - _len) as int))"), F.lit("...\n")))
    )
    kept = F.when(piece.isNotNull(), F.struct(F.col("_i"), piece.alias("_piece")))  # collect_list skips nulls
    packed = blocks.withColumn("_kept", kept).groupBy("query_id").agg(F.array_sort(F.collect_list("_kept")).alias("_p"))
    text = F.array_join("_p._piece", "")
    return packed.select("query_id", F.when(text == "", F.lit(fixed.EMPTY_CONTEXT)).otherwise(strip(text)).alias("context"))


def fill_template(task: Column, context: Column, history: Column, template: str = fixed.PROMPT_TEMPLATE) -> Column:
    """The prompt as one concatenation, so slot text is never read as a template again.

    A template that asks for an unknown slot is reported in front of the default prompt.
    """
    slots = {"task": task, "context": context, "history": history}
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in slots:
            notice = F.lit(f"Error in system prompt template: '{name}'\nUsing default.\n")
            return F.concat(notice, fill_template(task, context, history))
        parts.append(slots[name])
    return F.concat(*parts)


def build_prompts(queries: DataFrame, contexts: DataFrame, histories: DataFrame, template: str = fixed.PROMPT_TEMPLATE) -> DataFrame:
    """``query_id, prompt, tokens`` from task text, packed context and history text."""
    rows = queries.join(contexts, "query_id", "left").join(histories, "query_id", "left")
    prompt = fill_template(
        F.col("task"), F.coalesce("context", F.lit(fixed.EMPTY_CONTEXT)), F.coalesce("history", F.lit(fixed.EMPTY_HISTORY)), template
    )
    call = F.array(
        F.struct(F.lit("system").alias("role"), F.col("prompt").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("task").alias("content")),
    )
    return rows.withColumn("prompt", prompt).withColumn("tokens", prompt_tokens(call)).select("query_id", "prompt", "tokens")


# --- counters ----------------------------------------------------------------------


def respond_reason(frequency: Column, mention: Column, command: Column, private: Column, counter: Column) -> Column:
    match = counter % frequency == 0
    return (
        F.when(command | private, F.lit("command_or_private"))
        .when(mention, F.lit("mentioned"))
        .when(frequency < 1, F.lit("freq_zero_no_mention"))
        .when(frequency == 1, F.lit("freq_one"))
        .when(match, F.concat(F.lit("freq_match_"), counter.cast("string")))
        .otherwise(F.concat(F.lit("freq_skip_"), counter.cast("string")))
    )


def counts(frequency: Column, mention: Column, command: Column, private: Column) -> Column:
    """Only plain group messages under an every-N setting advance the counter."""
    return ~(mention | command | private) & (frequency > 1)


def respond_every(events: DataFrame, key: str = "chat_id", order: str = "seq", parts: int | None = None) -> DataFrame:
    """Every-N decision per event: ``counter, respond, reason``.

    Expects ``frequency, has_mention, is_command, is_private`` and, optionally,
    ``is_reset`` events, which set the counter of their chat back to zero.
    """
    has_reset = "is_reset" in events.columns
    base = events if has_reset else events.withColumn("is_reset", F.lit(False))
    seg = segmented(base, [key], [order], parts)
    counted = counts(F.col("frequency"), F.col("has_mention"), F.col("is_command"), F.col("is_private")) & ~F.col("is_reset")
    keys = [key]
    if has_reset:
        seg = running_sum(seg, keys, [order], F.col("is_reset").cast("int"), "epoch")
        keys = [key, "epoch"]  # still sorted: the epoch only grows along the order
    out = running_sum(seg, keys, [order], counted.cast("long"), "counter")
    reason = respond_reason(F.col("frequency"), F.col("has_mention"), F.col("is_command"), F.col("is_private"), F.col("counter"))
    out = out.withColumn("reason", F.when(F.col("is_reset"), F.lit("reset")).otherwise(reason))
    respond = ~F.col("reason").startswith("freq_skip") & ~F.col("reason").isin("freq_zero_no_mention", "reset")
    out = out.withColumn("respond", respond).drop(SEG)
    return out if has_reset else out.drop("is_reset")


def counters(events: DataFrame, key: str = "chat_id", order: str = "seq", parts: int | None = None) -> DataFrame:
    """The counter of every chat after its last event."""
    return respond_every(events, key, order, parts).groupBy(key).agg(F.max_by("counter", order).alias("counter"))


# --- session budget ----------------------------------------------------------------


def usage_by_depth(window, template: str = fixed.PROMPT_TEMPLATE) -> Column:
    """Prompt tokens if the last 1..TAIL lines before a turn were the history.

    The rule counts characters, so lengths suffice: lines start with a speaker and only the
    newest one's trailing blanks are stripped.  Expects ``_len`` and ``_trail`` columns.
    """
    frame = template.format(task="", context=fixed.EMPTY_CONTEXT, history="")
    around = prompt_tokens(
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit("").alias("content")) for r in ("system", "user")])
    )
    total = F.lit(len(frame)) - F.lag("_trail", 1).over(window)
    depths = []
    for d in range(1, TAIL + 1):
        total = total + F.coalesce(F.lag("_len", d).over(window) + F.lit(0 if d == 1 else 1), F.lit(0))
        depths.append(around + F.floor(total / 4).cast("int"))
    return F.array(*depths)


_SCAN_OUT = "key string, seg int, n long, before array<int>, after array<int>"


def _depth_scan(limit: int):
    """Depth of the history before and after each turn, for every depth at segment entry.

    Rows come sorted by key, segment and number; what a batch ends with carries over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, depth = None, []
        for pdf in batches:
            before, after = [], []
            for key, seg, user, usage in zip(pdf["key"], pdf["seg"], pdf["is_user"], pdf["usage"]):
                if at != (key, seg):
                    at, depth = (key, seg), list(range(TAIL + 1))
                before.append(depth)
                if user:
                    depth = [0 if d and usage[d - 1] >= limit else d for d in depth]
                depth = [min(d + 1, TAIL) for d in depth]
                after.append(depth)
            yield pdf[["key", "seg", "n"]].assign(before=before, after=after)

    return run


def session_reset(turns: DataFrame, max_tokens: int = Config.max_context_tokens, key: str = "conv_id", order: str = "turn", parts: int | None = None) -> DataFrame:
    """Token usage before each turn and whether it empties the history.

    The history since the last reset only matters up to five turns, so a segment is a map
    from six entry depths to six exit depths.  Segments are mapped in parallel and the maps
    of a conversation are chained; there are at most as many as partitions.
    """
    line = speaker_line(F.col("role"), F.col("text"))
    sized = turns.withColumn("_len", F.char_length(line)).withColumn("_trail", F.col("_len") - F.char_length(strip(line)))
    known = numbered(sized, [key], [order], parts=parts)
    wide = with_halo(known.select(key, SEG, "_n", "role", "_len", "_trail"), [key], TAIL)
    window = Window.partitionBy(key, SEG).orderBy("_n")
    rows = wide.withColumn("usage", usage_by_depth(window)).filter(~F.col("_halo"))
    narrow = rows.select(
        F.col(key).cast("string").alias("key"), F.col(SEG).alias("seg"), F.col("_n").cast("long").alias("n"),
        (F.col("role") == "user").alias("is_user"), "usage",
    )
    ordered = narrow.repartition("key", "seg").sortWithinPartitions("key", "seg", "n")
    scanned = cut(ordered.mapInPandas(_depth_scan(max_tokens), _SCAN_OUT).join(narrow.select("key", "n", "usage"), ["key", "n"]))
    maps = (
        scanned.groupBy("key", "seg").agg(F.max_by("after", "n").alias("after"))
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", "after"))).alias("maps"))
    )
    chained = F.transform(
        "maps",
        lambda m: F.struct(
            m["seg"].alias("seg"),
            F.aggregate(
                F.filter("maps", lambda e: e["seg"] < m["seg"]), F.lit(0), lambda d, e: F.element_at(e["after"], d + 1)
            ).alias("entry"),
        ),
    )
    entry = maps.select("key", F.explode(chained).alias("e")).select("key", "e.seg", "e.entry")
    depth = F.element_at("before", F.col("entry") + 1)
    usage = F.when(depth == 0, F.lit(0)).otherwise(F.element_at("usage", F.greatest(depth, F.lit(1))))
    found = scanned.join(entry, ["key", "seg"]).select("key", "n", depth.alias("depth"), usage.alias("usage"))
    return (
        known.withColumn("key", F.col(key).cast("string"))
        .withColumn("n", F.col("_n").cast("long"))
        .join(found, ["key", "n"])
        .withColumn("reset", (F.col("role") == "user") & (F.col("depth") > 0) & (F.col("usage") >= max_tokens))
        .drop("key", "n", "_n", "_len", "_trail", SEG)
    )
