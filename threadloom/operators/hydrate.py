"""Chunk-to-message joins, insert and set operators over the archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import running_sum, segmented

TARGET_BUCKET_ROWS = 256


def insert_new(existing: DataFrame, incoming: DataFrame, observe: Observation | None = None) -> DataFrame:
    """Incoming messages whose id is new, one row per id (the first by time, then text).

    ``row_number() = 1`` is limited on the map side, so a much-copied id reaches its
    reducer as one row per task.
    """
    first = Window.partitionBy("msg_id").orderBy("ts", "text")
    unique = incoming.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")
    fresh = unique.join(existing.select("msg_id"), "msg_id", "left_anti")
    return fresh.observe(observe, F.count("*").alias("inserted")) if observe is not None else fresh


def insert_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: how many incoming rows are inserted, how many skipped."""
    flags = insert_new(existing, incoming).select(F.lit(1).alias("new"), F.lit(0).alias("seen")).unionByName(
        incoming.select(F.lit(0).alias("new"), F.lit(1).alias("seen"))
    )
    return flags.agg(F.sum("new").alias("inserted"), (F.sum("seen") - F.sum("new")).alias("skipped"))


def _micros(name: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(
        f"cast(date_diff(to_date({name}), date'1970-01-01') as bigint) * 86400000000 + hour({name}) * 3600000000 "
        f"+ minute({name}) * 60000000L + cast(extract(second from {name}) * 1000000 as bigint)"
    )


def _bucketed(messages: DataFrame) -> DataFrame:
    """Per chat, the time width that holds about ``TARGET_BUCKET_ROWS`` messages."""
    ends = messages.groupBy("chat_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    span = F.ceil((_micros("hi") - _micros("lo")) * TARGET_BUCKET_ROWS / F.col("n"))
    return ends.select(
        "chat_id", F.greatest(F.lit(1), span).cast("long").alias("width"), F.col("lo").alias("_first"), F.col("hi").alias("_last")
    )


def range_members(ranges: DataFrame, messages: DataFrame, lo: str, hi: str) -> DataFrame:
    """Messages of ``chat_id`` with ``lo <= ts <= hi`` for every range row.

    Time is cut into buckets as wide as the chat is busy; a range meets only its own
    buckets, so even one huge chat joins on many keys.  Ranges are clipped to the chat's
    own time first, so a wide one meets no more buckets than the chat has.  A message lies
    in exactly one bucket, hence no row comes twice.
    """
    width = _bucketed(messages)
    left = (
        ranges.filter(F.col(lo) <= F.col(hi))
        .join(width, "chat_id")
        .withColumns({"_a": F.greatest(lo, "_first"), "_z": F.least(hi, "_last")})
        .filter(F.col("_a") <= F.col("_z"))
        .withColumn(
            "_bucket",
            F.explode(F.sequence(F.floor(_micros("_a") / F.col("width")), F.floor(_micros("_z") / F.col("width")))),
        )
        .drop("width", "_first", "_last", "_a", "_z")
    )
    right = messages.join(width, "chat_id").select(
        "chat_id",
        F.floor(_micros("ts") / F.col("width")).alias("_bucket"),
        "ts",
        "msg_id",
        "from_id",
        F.col("text").alias("text_message"),
    )
    return left.join(right, ["chat_id", "_bucket"]).filter(F.col("ts").between(F.col(lo), F.col(hi))).drop("_bucket")


def chunk_messages(chunks: DataFrame, messages: DataFrame, by: str = "ids") -> DataFrame:
    """Member messages of every chunk: ``(chunk_id, ts, msg_id, from_id, text_message)``.

    ``ids``: between the timestamps of the start and end messages, within the chunk's chat;
    a missing end gives the start alone, a missing start gives nothing.
    ``ts``: the chunk's own time window, else its id range, else its start message.
    """
    out = ["chunk_id", "ts", "msg_id", "from_id", "text_message"]
    one = messages.select(F.col("msg_id"), "ts", "from_id", F.col("text").alias("text_message"))
    if by == "ids":
        ends = messages.select(F.col("msg_id").alias("_id"), F.col("ts").alias("_ts"))
        bounds = (
            chunks.select("chunk_id", "chat_id", "msg_id_start", "msg_id_end")
            .join(ends.select(F.col("_id").alias("msg_id_start"), F.col("_ts").alias("_lo")), "msg_id_start")
            .join(ends.select(F.col("_id").alias("msg_id_end"), F.col("_ts").alias("_hi")), "msg_id_end", "left")
        )
        ranged = range_members(bounds.filter(F.col("_hi").isNotNull()), messages, "_lo", "_hi").select(out)
        alone = (
            bounds.filter(F.col("_hi").isNull())
            .select("chunk_id", F.col("msg_id_start").alias("msg_id"))
            .join(one, "msg_id")
            .select(out)
        )
        return ranged.unionByName(alone)
    base = chunks.select("chunk_id", "chat_id", "msg_id_start", "msg_id_end", "ts_from", "ts_to").filter(
        F.coalesce("chat_id", F.lit("")) != ""
    )
    by_time = range_members(base.filter(F.col("ts_from").isNotNull() & F.col("ts_to").isNotNull()), messages, "ts_from", "ts_to").select(out)
    left_over = cut(base.join(by_time.select("chunk_id").distinct(), "chunk_id", "left_anti"))
    if left_over.isEmpty():
        return by_time
    by_id = _id_range(left_over, messages).select(out)
    last = (
        left_over.join(by_id.select("chunk_id").distinct(), "chunk_id", "left_anti")
        .select("chunk_id", F.col("msg_id_start").alias("msg_id"))
        .join(one, "msg_id")
        .select(out)
    )
    return by_time.unionByName(by_id).unionByName(last)


def _id_range(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages whose id lies, as text, between a chunk's start and end id.

    Ids and range ends are put in one order; counting ids along it turns every range into
    positions, which join in blocks like times do.
    """
    ends = chunks.filter((F.coalesce("msg_id_start", F.lit("")) != "") & (F.coalesce("msg_id_end", F.lit("")) != ""))
    nobody = F.lit(None).cast(ends.schema["chunk_id"].dataType).alias("chunk_id")
    ids = messages.join(ends.select("chat_id").distinct(), "chat_id", "left_semi").select(
        "chat_id", F.col("msg_id").alias("at"), F.lit(1).alias("kind"), nobody
    )
    lows = ends.select("chat_id", F.col("msg_id_start").alias("at"), F.lit(0).alias("kind"), "chunk_id")
    highs = ends.select("chat_id", F.col("msg_id_end").alias("at"), F.lit(2).alias("kind"), "chunk_id")
    order = ["at", "kind", "chunk_id"]
    placed = cut(
        running_sum(
            segmented(ids.unionByName(lows).unionByName(highs), ["chat_id"], order), ["chat_id"], order, (F.col("kind") == 1).cast("long"), "n"
        )
    )
    spans = placed.filter("kind <> 1").groupBy("chat_id", "chunk_id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n") + 1)).alias("lo"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("hi")
    ).filter("lo <= hi")
    block = lambda c: F.floor(F.col(c) / TARGET_BUCKET_ROWS)
    left = spans.withColumn("_block", F.explode(F.sequence(block("lo"), block("hi"))))
    right = placed.filter("kind = 1").select("chat_id", F.col("at").alias("msg_id"), "n", block("n").alias("_block"))
    found = left.join(right, ["chat_id", "_block"]).filter(F.col("n").between(F.col("lo"), F.col("hi"))).select("chunk_id", "msg_id")
    return found.join(messages.select("msg_id", "ts", "from_id", F.col("text").alias("text_message")), "msg_id")


def orphans(index: DataFrame, store: DataFrame) -> DataFrame:
    """Index ids without a stored chunk."""
    return index.select("id").join(store.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def children(topics_l1: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(level, topic_id, kind, child_id)``: topics of a super-topic, chunks of either level."""
    parts = [
        topics_l1.filter("parent_l2_id is not null").select(
            F.lit("l2").alias("level"), F.col("parent_l2_id").alias("topic_id"), F.lit("topic").alias("kind"), F.col("topic_id").cast("string").alias("child_id")
        )
    ]
    for level in ("l1", "l2"):
        key = f"topic_{level}_id"
        parts.append(
            chunks.filter(F.col(key).isNotNull()).select(
                F.lit(level).alias("level"), F.col(key).alias("topic_id"), F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("child_id")
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def first_wins(*frames: DataFrame, key: list[str]) -> DataFrame:
    """Union in order; the first frame that brings a key keeps it."""
    tagged = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f)
    rest = [c for c in union.columns if c not in (*key, "_from")]
    best = Window.partitionBy(*key).orderBy("_from", *rest)
    return union.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_from")


def chats_like(chats: DataFrame, part: str) -> DataFrame:
    return chats.filter(F.lower("name").contains(part.lower()))


def chats_exact(chats: DataFrame, key: str) -> DataFrame:
    return chats.filter((F.col("id").cast("string") == key) | (F.col("name") == key))
