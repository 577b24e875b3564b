"""Token-budget chunking of message archives.

Chunks follow each other within a chat, so the work is an ordered scan.  Messages are
range-partitioned by (chat, time, id); a chat may span many partitions.  A partition then
needs one number from its predecessor -- how many tokens the open chunk already holds --
and it can say beforehand how it maps that number to its own last open chunk.  So:

  pass 1  every partition returns that map for the chat it starts in      (narrow columns)
  driver  chains the maps, one row per partition
  pass 2  every partition marks the messages that start a chunk
  pass 3  every partition numbers its rows by chunk, given the last starts before it

Overlap, merging of small chunks and the text itself are joins and groupings by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..config import Config
from ..functions.text import chunk_prefix, compose_id, format_message, raw_id, token_count
from ..session import cut, cut_in_place
from .ordered import ranged


# --- scans over one run of messages (inside tasks) ---------------------------------


def next_starts(tok: np.ndarray, limit: int, nl: int) -> np.ndarray:
    """For a chunk that starts at i, the index at which the next one starts."""
    total = np.cumsum(tok + nl)
    before = total - (tok + nl)
    reach = np.searchsorted(total, before + limit + nl, side="right")
    return np.maximum(reach, np.arange(len(tok)) + 1)


def first_break(tok: np.ndarray, open_tokens: int, limit: int, nl: int) -> int:
    """The first message that no longer fits a chunk already holding ``open_tokens``."""
    if open_tokens < 0:
        return 0
    return int(np.searchsorted(np.cumsum(tok + nl), limit - open_tokens, side="right"))


def open_at_end(tok: np.ndarray, start: int, nl: int) -> int:
    """Tokens of the chunk that starts at ``start`` and is still open at the end."""
    return int(tok[start:].sum() + nl * (len(tok) - start - 1))


def last_start(nxt: np.ndarray, start: int) -> int:
    while nxt[start] < len(nxt):
        start = nxt[start]
    return int(start)


def exit_map(tok: np.ndarray, limit: int, nl: int) -> tuple[list[int], list[int], int]:
    """How a run turns the tokens of an incoming open chunk into those of its last one.

    ``breaks[j]`` is the greatest incoming value that still lets message j in; with the
    first message refused at j the run ends with ``exits[j]`` open tokens.  If nothing is
    refused, the run's own total is added.
    """
    nxt = next_starts(tok, limit, nl)
    total = np.cumsum(tok + nl)
    possible = int(np.searchsorted(total, limit, side="right"))
    breaks, exits, seen = [], [], {}
    for j in range(min(possible + 1, len(tok))):
        tail = last_start(nxt, j)
        if tail not in seen:
            seen[tail] = open_at_end(tok, tail, nl)
        breaks.append(int(limit - total[j]))
        exits.append(seen[tail])
    return breaks, exits, int(total[-1])


def apply_map(open_tokens: int, breaks: list[int], exits: list[int], total: int) -> int:
    for fits_up_to, out in zip(breaks, exits):
        if open_tokens > fits_up_to:
            return out
    return open_tokens + total


# --- the operator ------------------------------------------------------------------


def _sorted_lines(messages: DataFrame, token_counter, parts: int | None) -> DataFrame:
    line = format_message(F.col("ts"), F.col("from_id"), F.col("text"))
    lines = messages.select(
        "chat_id",
        "ts",
        "msg_id",
        F.coalesce("from_id", F.lit(fixed.UNKNOWN_SENDER)).alias("sender"),
        line.alias("line"),
    ).withColumn("tok", token_counter(F.col("line")).cast("long"))
    by = ["chat_id", "ts", "msg_id"]
    placed = ranged(lines, by, parts).sortWithinPartitions(*by)
    return cut_in_place(placed.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))


_SUMMARY = "part int, first_chat string, last_chat string, breaks array<long>, exits array<long>, total long, open long"


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if len(b)]
    return pa.Table.from_batches(got) if got else None


def _runs(chat: np.ndarray) -> np.ndarray:
    return np.r_[0, np.nonzero(chat[1:] != chat[:-1])[0] + 1, len(chat)]


def membership(messages: DataFrame, cfg: Config = Config(), token_counter=token_count, newline_tokens: int = 0, parts: int | None = None, overlap: bool = True) -> DataFrame:
    """Every message of every chunk before merging, overlap rows included.

    Columns: ``chat_id, chunk_pos, prev_pos, pos, ts, msg_id, sender, line, tok, is_overlap``;
    ``chunk_pos`` is the position of the chunk's first own message and orders chunks.
    """
    limit, nl = cfg.chunk_token_max, newline_tokens
    target = int(limit * cfg.chunk_overlap_ratio) if overlap else -1
    lines = _sorted_lines(messages, token_counter, parts)

    def summarise(batches):
        table = _whole(batches)
        if table is None:
            return
        chat = table.column("chat_id").to_numpy(zero_copy_only=False)
        tok = table.column("tok").to_numpy()
        runs = _runs(chat)
        first, last = tok[: runs[1]], tok[runs[-2] :]
        breaks, exits, total = exit_map(first, limit, nl)
        open_ = open_at_end(last, last_start(next_starts(last, limit, nl), 0), nl)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                "first_chat": [chat[0]],
                "last_chat": [chat[-1]],
                "breaks": pa.array([breaks], pa.list_(pa.int64())),
                "exits": pa.array([exits], pa.list_(pa.int64())),
                "total": pa.array([total], pa.int64()),
                "open": pa.array([open_], pa.int64()),
            }
        )

    # one row per partition: bounded by the partition count, whatever the archive holds
    summaries = lines.select("chat_id", "tok", "part").mapInArrow(summarise, _SUMMARY).collect()
    entry: dict[int, tuple[str, int]] = {}
    carried: tuple[str, int] | None = None
    for s in sorted(summaries, key=lambda r: r["part"]):
        if carried is not None and carried[0] == s["first_chat"]:
            entry[s["part"]] = carried
        if s["first_chat"] != s["last_chat"]:
            carried = (s["last_chat"], s["open"])
        elif s["part"] in entry:
            carried = (s["last_chat"], apply_map(carried[1], s["breaks"], s["exits"], s["total"]))
        else:
            carried = (s["last_chat"], s["open"])

    own_fields = ["chat_id", "pos", "ts", "msg_id", "sender", "line", "tok"]
    own_schema = T.StructType([lines.schema[n] for n in own_fields] + [T.StructField("is_start", T.BooleanType())])

    def mark(batches):
        table = _whole(batches)
        if table is None:
            return
        chat = table.column("chat_id").to_numpy(zero_copy_only=False)
        tok = table.column("tok").to_numpy()
        part = table.column("part")[0].as_py()
        start = np.zeros(len(tok), dtype=bool)
        runs = _runs(chat)
        for i, (a, b) in enumerate(zip(runs[:-1], runs[1:])):
            inherited = entry.get(part) if i == 0 else None
            at = first_break(tok[a:b], inherited[1], limit, nl) if inherited and inherited[0] == chat[a] else 0
            nxt = next_starts(tok[a:b], limit, nl)
            while at < b - a:
                start[a + at] = True
                at = nxt[at]
        out = table.select(own_fields).append_column("is_start", pa.array(start))
        yield from out.to_batches()

    marked = cut_in_place(lines.mapInArrow(mark, own_schema).withColumn("part", F.spark_partition_id()))
    return _members(marked, target, nl)


def _members(marked: DataFrame, target: int, nl: int) -> DataFrame:
    """Own and overlap rows of every chunk from messages flagged as chunk starts."""
    # the last two chunk starts a partition leaves open, again one row per partition
    rank = Window.partitionBy("part").orderBy(F.desc("pos"))
    last_two = (
        marked.filter("is_start")
        .select("part", "chat_id", "pos")
        .withColumn("n", F.row_number().over(rank))
        .filter("n <= 2")
        .groupBy("part")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "chat_id"))).alias("open"))
    )
    open_by_part = {r["part"]: [(x["pos"], x["chat_id"]) for x in r["open"]] for r in last_two.collect()}
    held = sorted(open_by_part)
    schema = T.StructType(
        [marked.schema[n] for n in ("chat_id", "pos", "ts", "msg_id", "sender", "line", "tok")]
        + [T.StructField("chunk_pos", T.LongType()), T.StructField("prev_pos", T.LongType())]
    )

    def own(batches):
        table = _whole(batches)
        if table is None:
            return
        part = table.column("part")[0].as_py()
        before = [x for p in held if p < part for x in open_by_part[p]][-2:]
        chat = table.column("chat_id").to_numpy(zero_copy_only=False)
        pos = table.column("pos").to_numpy()
        flag = table.column("is_start").to_numpy(zero_copy_only=False)
        all_pos = np.r_[[p for p, _ in before], pos[flag]].astype(np.int64)
        all_chat = np.array([c for _, c in before] + list(chat[flag]), dtype=object)
        which = np.searchsorted(all_pos, pos, side="right") - 1
        chunk = all_pos[which]
        previous = np.where(which > 0, which - 1, 0)
        same = (which > 0) & (all_chat[previous] == chat)
        prev = pa.array(all_pos[previous], mask=~same)
        out = table.select([f.name for f in schema.fields[:7]])
        out = out.append_column("chunk_pos", pa.array(chunk)).append_column("prev_pos", prev)
        yield from out.to_batches()

    owned = cut(marked.mapInArrow(own, schema)).withColumn("is_overlap", F.lit(False))
    if target < 0:
        return owned
    return owned.unionByName(_overlap(owned, target, nl))


def _overlap(owned: DataFrame, target: int, nl: int) -> DataFrame:
    """For every chunk but a chat's first, the longest run of messages just before it that
    fits the target.  (Taking the tail of the previous *extended* chunk comes to the same:
    that chunk's own overlap begins no later than this run does.)

    The run of a chunk lies in the chunks before it.  Each step visits the next chunk back
    for those chunks whose run has used up all visited messages, so there are as many steps
    as short chunks in a row, nearly always one.
    """
    inside = Window.partitionBy("chunk_pos").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    # only the last `target` tokens of a chunk can ever be overlap
    tails_in_reach = (
        owned.drop("is_overlap").withColumn("_used", F.sum(F.col("tok") + nl).over(inside)).filter(F.col("_used") - nl <= target)
    )
    chunk_links = cut(
        owned.groupBy("chunk_pos").agg(F.max("prev_pos").alias("prev_pos"), F.sum(F.col("tok") + nl).alias("_whole"))
    )
    frontier = chunk_links.filter(F.col("prev_pos").isNotNull()).select(
        F.col("chunk_pos").alias("for_chunk"), F.col("prev_pos").alias("for_prev"), F.col("prev_pos").alias("visit"), F.lit(0).cast("long").alias("spent")
    )
    found = None
    while True:
        step = (
            frontier.join(tails_in_reach.withColumnRenamed("chunk_pos", "visit").withColumnRenamed("prev_pos", "_p"), "visit")
            .filter(F.col("spent") + F.col("_used") - nl <= target)
            .select(
                "chat_id", "pos", "ts", "msg_id", "sender", "line", "tok",
                F.col("for_chunk").alias("chunk_pos"), F.col("for_prev").alias("prev_pos"),
            )
        )
        found = step if found is None else found.unionByName(step)
        frontier = cut(
            frontier.join(chunk_links.withColumnRenamed("chunk_pos", "visit"), "visit")
            .filter((F.col("spent") + F.col("_whole") - nl <= target) & F.col("prev_pos").isNotNull())
            .select("for_chunk", "for_prev", F.col("prev_pos").alias("visit"), (F.col("spent") + F.col("_whole")).alias("spent"))
        )
        if frontier.isEmpty():
            return found.withColumn("is_overlap", F.lit(True))


def _heads(chunks: DataFrame) -> DataFrame:
    """``chunk_pos -> head``: a merged chunk belongs to the nearest kept chunk before it.

    Only merged chunks are followed, by pointer doubling.
    """
    known = chunks.filter(~F.col("merged")).select("chunk_pos", F.col("chunk_pos").alias("head"))
    todo = cut(chunks.filter("merged").select("chunk_pos", F.col("prev_pos").alias("head")))
    while True:
        hop = todo.select(F.col("chunk_pos").alias("head"), F.col("head").alias("_next"))
        stepped = todo.join(hop, "head", "left")
        moved = stepped.filter(F.col("_next").isNotNull())
        if moved.isEmpty():
            return known.unionByName(todo.select("chunk_pos", "head"))
        todo = cut(stepped.select("chunk_pos", F.coalesce("_next", "head").alias("head")))


def chunk_rollup(members: DataFrame, key: list[str]) -> DataFrame:
    """First/last id, time range, count, senders and joined text of each chunk's members.

    A chunk holds at most its token budget, so the collected group is bounded by it.
    """
    item = F.struct("at", "ts", "msg_id", "sender", "line")
    rows = members.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    return rows.select(
        *key,
        F.col("m")[0]["msg_id"].alias("msg_id_start"),
        F.element_at("m", -1)["msg_id"].alias("msg_id_end"),
        F.col("m")[0]["ts"].alias("ts_from"),
        F.element_at("m", -1)["ts"].alias("ts_to"),
        F.size("m").alias("message_count"),
        F.array_sort(F.array_distinct("m.sender")).alias("senders"),
        F.array_join("m.line", "\n").alias("body"),
    )


def chunk_messages(messages: DataFrame, cfg: Config = Config(), token_counter=token_count, newline_tokens: int = 0, parts: int | None = None) -> DataFrame:
    """Finished chunks of every chat: packed, overlapped, small ones merged, rendered."""
    members = membership(messages, cfg, token_counter, newline_tokens, parts)
    sizes = members.groupBy("chat_id", "chunk_pos").agg(
        F.max("prev_pos").alias("prev_pos"),
        F.sum("tok").alias("tok"),
        F.min_by("ts", "pos").alias("ts_from"),
        F.max_by("ts", "pos").alias("ts_to"),
        F.collect_set("sender").alias("senders"),
    )
    finals = messages.groupBy("chat_id").agg(F.max(F.struct("ts", "msg_id")).alias("_f")).select(
        "chat_id", F.col("_f.msg_id").alias("final_id")
    )
    last_chunk = sizes.groupBy("chat_id").agg(F.max("chunk_pos").alias("last_pos"))
    suffix_tokens = token_counter(F.lit(fixed.CONTINUATION))
    header = token_counter(chunk_prefix(F.col("ts_from"), F.col("ts_to"), F.col("senders")))
    graded = cut(
        sizes.join(last_chunk, "chat_id")
        .withColumn(
            "size", F.col("tok") + header + F.when(F.col("chunk_pos") == F.col("last_pos"), F.lit(0)).otherwise(suffix_tokens)
        )
        .select("chunk_pos", "prev_pos", ((F.col("size") < cfg.chunk_token_min) & F.col("prev_pos").isNotNull()).alias("merged"))
    )
    placed = members.join(_heads(graded), "chunk_pos").withColumn("at", F.struct("chunk_pos", "pos"))
    rows = chunk_rollup(placed, ["chat_id", "head"]).join(finals, "chat_id")
    prefix = chunk_prefix(F.col("ts_from"), F.col("ts_to"), F.col("senders"))
    suffix = F.when(F.col("msg_id_end") == F.col("final_id"), F.lit("")).otherwise(F.lit(fixed.CONTINUATION))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        F.sha2(F.concat_ws("|", "chat_id", "msg_id_start", "msg_id_end", F.col("head").cast("string")), 256).alias("_h"),
        "*",
    ).select(
        F.substring("_h", 1, 32).alias("chunk_id"),
        "chat_id",
        F.concat(prefix, "body", suffix).alias("text"),
        "msg_id_start",
        "msg_id_end",
        "ts_from",
        "ts_to",
        "message_count",
        F.to_json(
            F.struct(F.col("message_count"), iso("ts_from").alias("start_date"), iso("ts_to").alias("end_date"))
        ).alias("metadata"),
    )
