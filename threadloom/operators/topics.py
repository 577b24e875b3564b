"""Topic roll-ups, assignment, hierarchy views and naming support."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import needs_name, parse_title_response, short_title, strip
from ..functions.vectors import cosine, l2_normalise

_NO_TIME = "timestamp_ntz"


def mean_vector(vec: Column) -> Column:
    """Element-wise mean as a partial (map-side) aggregate."""
    return vector_to_array(Summarizer.mean(array_to_vector(vec.cast("array<double>"))))


def _iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text).cast(_NO_TIME)


def rollup_l1(assigned: DataFrame, metric: str = "cosine") -> DataFrame:
    """One row per topic from ``chunk_id, topic_l1_id, embedding, metadata``.

    The centroid is the mean of what was clustered (unit vectors for cosine) and is not
    normalised again.  Dates compare as ISO text; an unparsable extreme gives null.
    """
    vec = l2_normalise(F.col("embedding")) if metric == "cosine" else F.col("embedding")
    meta = F.from_json("metadata", "message_count long, start_date string, end_date string")
    rows = assigned.filter(F.col("topic_l1_id").isNotNull()).select(
        F.col("topic_l1_id").alias("topic_id"), vec.alias("v"), meta.alias("m")
    )
    blank = lambda c: F.when(c != "", c)
    return rows.groupBy("topic_id").agg(
        F.lit(fixed.UNNAMED_TITLE).alias("title"),
        F.lit(fixed.PENDING_DESCRIPTION).alias("descr"),
        F.lit(None).cast("long").alias("parent_l2_id"),
        F.count("*").alias("chunk_count"),
        F.sum(F.coalesce("m.message_count", F.lit(0))).alias("msg_count"),
        _iso_time(F.min(blank(F.col("m.start_date")))).alias("ts_from"),
        _iso_time(F.max(blank(F.col("m.end_date")))).alias("ts_to"),
        mean_vector(F.col("v")).alias("center_vec"),
    )


def rollup_l2(topics_l1: DataFrame, metric: str = "cosine") -> DataFrame:
    """One row per super-topic from level-1 topics that carry ``parent_l2_id``."""
    vec = l2_normalise(F.col("center_vec")) if metric == "cosine" else F.col("center_vec")
    return (
        topics_l1.filter(F.col("parent_l2_id").isNotNull())
        .select(F.col("parent_l2_id").alias("topic_id"), vec.alias("v"), "chunk_count")
        .groupBy("topic_id")
        .agg(
            F.lit(fixed.UNNAMED_TITLE).alias("title"),
            F.lit(fixed.PENDING_DESCRIPTION).alias("descr"),
            F.sum("chunk_count").alias("chunk_count"),
            mean_vector(F.col("v")).alias("center_vec"),
        )
    )


def noise_stats(labels: DataFrame, label: str = "label") -> DataFrame:
    """Clusters, noise rows (label -1), noise share in percent and whether it is above half."""
    noise = F.count_if(F.col(label) == -1)
    share = F.when(F.count("*") > 0, noise * 100.0 / F.count("*")).otherwise(F.lit(0.0))
    return labels.agg(
        F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("clusters"),
        noise.alias("noise"),
        F.round(share, 6).alias("noise_percentage"),
        (share > 50.0).alias("high_noise"),
    )


# --- assignment --------------------------------------------------------------------


def assign_l1(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks with the label as level-1 topic (noise is null); level 2 starts empty."""
    found = labels.select("chunk_id", F.when(F.col("label") >= 0, F.col("label")).cast("long").alias("topic_l1_id"))
    return chunks.drop("topic_l1_id", "topic_l2_id").join(found, "chunk_id", "left").withColumn(
        "topic_l2_id", F.lit(None).cast("long")
    )


def assign_l2(topics_l1: DataFrame, labels: DataFrame) -> DataFrame:
    """Level-1 topics with their super-topic as parent (noise is null)."""
    found = labels.select("topic_id", F.when(F.col("label") >= 0, F.col("label")).cast("long").alias("parent_l2_id"))
    return topics_l1.drop("parent_l2_id").join(found, "topic_id", "left")


def propagate_l2(chunks: DataFrame, topics_l1: DataFrame) -> DataFrame:
    """Every chunk takes the parent of its level-1 topic as its level-2 topic."""
    parents = topics_l1.select(F.col("topic_id").alias("topic_l1_id"), F.col("parent_l2_id").alias("topic_l2_id"))
    return chunks.drop("topic_l2_id").join(parents, "topic_l1_id", "left")


# --- views -------------------------------------------------------------------------


def topic_tree(topics_l1: DataFrame, topics_l2: DataFrame) -> DataFrame:
    """``kind, topic_id, title, l1_count, chunk_count``: super-topics, then level-1 topics
    under them, then those without a parent."""
    named = topics_l1.select("topic_id", short_title(F.col("title")).alias("title"), "parent_l2_id", "chunk_count")
    known = topics_l2.select(F.col("topic_id").alias("parent_l2_id"))
    sums = named.groupBy("parent_l2_id").agg(F.count("*").alias("l1_count"), F.sum("chunk_count").alias("chunks"))
    zero = F.lit(0).cast("long")
    top = topics_l2.join(sums, topics_l2["topic_id"] == sums["parent_l2_id"], "left").select(
        F.lit("l2").alias("kind"), topics_l2["topic_id"], short_title(F.col("title")).alias("title"),
        F.coalesce("l1_count", zero).alias("l1_count"), F.coalesce("chunks", zero).alias("chunk_count"),
    )
    under = named.join(known, "parent_l2_id", "left_semi").select(
        F.lit("l1").alias("kind"), "topic_id", "title", zero.alias("l1_count"), F.col("chunk_count").cast("long")
    )
    alone = named.filter(F.col("parent_l2_id").isNull()).select(
        F.lit("orphan").alias("kind"), "topic_id", "title", zero.alias("l1_count"), F.col("chunk_count").cast("long")
    )
    return top.unionByName(under).unionByName(alone)


# --- naming ------------------------------------------------------------------------


def representatives(topics_l2: DataFrame, topics_l1: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts that stand for a super-topic: of its five most central topics, the five most
    central chunks each; short and repeated texts are dropped after that limit.

    Similarities are ranked to twelve places: two topics are always equally far from their
    own mean, and summation order must not decide between them.
    """
    by_l1 = Window.partitionBy("l2_id").orderBy(F.desc("l1_similarity"), "l1_id")
    by_chunk = Window.partitionBy("l2_id", "l1_id").orderBy(F.desc("similarity"), "chunk_id")
    l2 = topics_l2.select(F.col("topic_id").alias("l2_id"), F.col("center_vec").alias("_c2"))
    l1 = topics_l1.select(
        F.col("topic_id").alias("l1_id"), F.col("parent_l2_id").alias("l2_id"), F.col("center_vec").alias("_c1")
    ).filter(F.col("_c1").isNotNull())
    central = (
        l1.join(l2, "l2_id")
        .withColumn("l1_similarity", F.round(cosine(F.col("_c2"), F.col("_c1")), 12))
        .withColumn("l1_rank", F.row_number().over(by_l1))
        .filter(F.col("l1_rank") <= fixed.MAX_L1_PER_L2)
        .select("l2_id", "l1_id", "_c1", "l1_rank")
    )
    close = (
        chunks.filter(F.col("embedding").isNotNull())
        .select("chunk_id", F.col("topic_l1_id").alias("l1_id"), "embedding", "text")
        .join(central, "l1_id")
        .withColumn("similarity", F.round(cosine(F.col("_c1"), F.col("embedding")), 12))
        .withColumn("chunk_rank", F.row_number().over(by_chunk))
        .filter(F.col("chunk_rank") <= fixed.MAX_CHUNKS_PER_L1)
        .select("l2_id", "l1_id", "l1_rank", "chunk_rank", "chunk_id", "text")
    )
    first = Window.partitionBy("l2_id", "_norm").orderBy("l1_rank", "chunk_rank")
    place = Window.partitionBy("l2_id").orderBy("l1_rank", "chunk_rank")
    return (
        close.withColumn("_strip", strip(F.coalesce("text", F.lit(""))))
        .filter(F.char_length("_strip") >= fixed.MIN_CHUNK_CHARS)
        .withColumn("_norm", F.sha2(F.lower("_strip"), 256))
        .withColumn("_seen", F.row_number().over(first))
        .filter("_seen = 1")
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= fixed.MAX_CHUNKS_PER_L2)
        .select(
            "l2_id", F.col("place").cast("long").alias("place"), "l1_id", "chunk_id",
            F.concat(
                F.lit("--- chunk from topic l1-"), F.col("l1_id").cast("string"), F.lit(" ---\n"),
                F.substring("text", 1, fixed.MAX_CHUNK_CHARS),
            ).alias("block"),
        )
    )


def sample_order(chunk_id, seed: int):
    """A seeded random order that SQL engines share: the digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), chunk_id.cast("string")))


def sample_chunks(chunks: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """Up to n chunks of every topic in a seeded random order, as numbered blocks.

    The n least digests of a topic are the least of those of its sixteen parts by first digit; parts are
    sampled on their own, ids and digests only, so a topic with a third of all chunks is no single task. Texts
    are joined to what is left."""
    keyed = chunks.filter(F.col("topic_l1_id").isNotNull() & F.col("chunk_id").isNotNull()).select("topic_l1_id", "chunk_id", sample_order(F.col("chunk_id"), seed).alias("_h"))
    least = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "chunk_id"))
    parts = keyed.withColumn("_at", least("topic_l1_id", F.substring("_h", 1, 1))).filter(F.col("_at") <= n).drop("_at")
    picked = parts.withColumn("nth", least("topic_l1_id")).filter(F.col("nth") <= n)
    return picked.join(chunks.select("topic_l1_id", "chunk_id", "text"), ["topic_l1_id", "chunk_id"]).select(
        F.col("topic_l1_id").alias("topic_id"), "nth", "chunk_id",
        F.concat(F.lit("Chunk "), F.col("nth").cast("string"), F.lit(":\n"), F.substring("text", 1, 200), F.lit("...")).alias("block"),
    )


def naming_material(blocks: DataFrame, key: str, nth: str) -> DataFrame:
    """The blocks of each topic (at most 25) joined for one request."""
    return (
        blocks.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(nth), F.col("block")))).alias("b"))
        .select(F.col(key).alias("topic_id"), F.array_join("b.block", "\n\n").alias("material"))
    )


def unnamed(topics: DataFrame, level: str = "l1", mode: str = "only_unnamed") -> DataFrame:
    return topics.filter(needs_name(F.col("title"), level, mode))


def apply_titles(topics: DataFrame, responses: DataFrame) -> DataFrame:
    """Topics with validated titles; a response that does not validate sets "unknown".

    ``responses``: ``topic_id, response``; topics without a response keep their title.
    """
    parsed = responses.select("topic_id", parse_title_response(F.col("response")).alias("_r"))
    ok = F.col("_r.status") == "ok"
    kept = [c for c in topics.columns if c not in ("title", "descr")]
    return topics.join(parsed, "topic_id", "left").select(
        *kept,
        F.when(F.col("_r").isNull(), F.col("title")).when(ok, F.col("_r.title")).otherwise(F.lit(fixed.UNNAMED_TITLE)).alias("title"),
        F.when(F.col("_r").isNull(), F.col("descr")).when(ok, F.col("_r.description")).otherwise(F.lit(fixed.FAILED_DESCRIPTION)).alias("descr"),
    )
