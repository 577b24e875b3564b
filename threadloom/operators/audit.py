"""Counts and coverage statistics of an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import is_named, meta_get, token_count
from .hydrate import orphans


def table_counts(**tables: DataFrame) -> DataFrame:
    """``name, n`` for any number of tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def audit_messages(messages: DataFrame) -> DataFrame:
    chat = F.coalesce("chat_id", F.lit(fixed.UNKNOWN_CHAT)).alias("chat_id")
    return messages.groupBy(chat).agg(
        F.count("*").alias("messages"),
        F.date_format(F.min("ts"), fixed.DATE_FORMAT).alias("first_ts"),
        F.date_format(F.max("ts"), fixed.DATE_FORMAT).alias("last_ts"),
    )


def audit_chunks(chunks: DataFrame, token_min: int = 50) -> DataFrame:
    """One row per chat; sums and counts add up over chats."""
    chat = F.coalesce("chat_id", F.lit(fixed.UNKNOWN_CHAT)).alias("chat_id")
    tok = token_count(F.col("text")).cast("long")
    return chunks.groupBy(chat).agg(
        F.count("*").alias("chunks"),
        F.sum(tok).alias("tokens"),
        F.floor(F.sum(tok) / F.count("*")).cast("long").alias("avg_tokens"),
        F.count_if(tok < token_min).alias("small_chunks"),
        F.count_if(F.coalesce("msg_id_start", F.lit("")) == "").alias("without_messages"),
    )


def audit_vectors(chunks: DataFrame, index: DataFrame) -> DataFrame:
    have = chunks.agg(
        F.count_if(F.col("embedding").isNotNull()).alias("with_vector"),
        F.count_if(F.col("embedding").isNull()).alias("without_vector"),
    )
    stored = index.agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"))
    extra = orphans(index, chunks).agg(F.count("*").alias("orphans"))
    return _metrics(have, stored, extra)


def _metrics(*frames: DataFrame) -> DataFrame:
    """One-row frames as ``metric, value`` rows."""
    out = None
    for df in frames:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns])
        rows = df.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_topics(chunks: DataFrame, topics_l1: DataFrame, topics_l2: DataFrame) -> DataFrame:
    c = chunks.agg(
        F.count_if(F.col("topic_l1_id").isNotNull()).alias("chunks_with_topic_l1"),
        F.count_if(F.col("topic_l1_id").isNull()).alias("chunks_without_topic_l1"),
    )
    one = topics_l1.agg(
        F.count("*").alias("topics_l1"),
        F.count_if(F.col("center_vec").isNotNull()).alias("topics_l1_with_center"),
        F.count_if(F.col("parent_l2_id").isNotNull()).alias("l1_with_parent"),
        F.count_if(F.col("parent_l2_id").isNull()).alias("l1_without_parent"),
    )
    two = topics_l2.agg(
        F.count("*").alias("topics_l2"), F.count_if(F.col("center_vec").isNotNull()).alias("topics_l2_with_center")
    )
    return _metrics(c, one, two)


def audit_names(topics_l1: DataFrame, topics_l2: DataFrame) -> DataFrame:
    def one(df: DataFrame, level: str) -> DataFrame:
        named = F.count_if(is_named(F.col("title"), level))
        return df.agg(named.alias("named"), (F.count("*") - named).alias("unnamed")).select(
            F.lit(level).alias("level"), "named", "unnamed"
        )

    return one(topics_l1, "l1").unionByName(one(topics_l2, "l2"))


def date_range(chunks: DataFrame, first_key: str = "start_date", last_key: str = "end_date") -> DataFrame:
    return chunks.agg(
        F.substring(F.min(meta_get(F.col("metadata"), first_key)), 1, 10).alias("min_date"),
        F.substring(F.max(meta_get(F.col("metadata"), last_key)), 1, 10).alias("max_date"),
    )


def ingest_report(
    messages: DataFrame, chunks: DataFrame, index: DataFrame, topics_l1: DataFrame, topics_l2: DataFrame, token_min: int = 50
) -> DataFrame:
    """All audits as ``stage, metric, value``."""
    tok = token_count(F.col("text")).cast("long")
    m = _metrics(messages.agg(F.count("*").alias("messages"), F.count_distinct("chat_id").alias("chats")))
    c = _metrics(
        chunks.agg(
            F.count("*").alias("chunks"),
            F.coalesce(F.floor(F.sum(tok) / F.greatest(F.count("*"), F.lit(1))), F.lit(0)).alias("avg_tokens"),
            F.count_if(tok < token_min).alias("small_chunks"),
            F.count_if(F.coalesce("msg_id_start", F.lit("")) == "").alias("without_messages"),
        )
    )
    names = audit_names(topics_l1, topics_l2).select(
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("named_"), F.col("level")).alias("metric"), F.col("named").alias("value")),
                F.struct(F.concat(F.lit("unnamed_"), F.col("level")).alias("metric"), F.col("unnamed").alias("value")),
            )
        ).alias("p")
    ).select("p.metric", "p.value")
    stages = (
        ("messages", m),
        ("chunks", c),
        ("vectors", audit_vectors(chunks, index)),
        ("topics", audit_topics(chunks, topics_l1, topics_l2)),
        ("names", names),
    )
    out = None
    for stage, df in stages:
        rows = df.select(F.lit(stage).alias("stage"), "metric", F.col("value").cast("long").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
