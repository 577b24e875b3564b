"""Retrieval: direct, two-stage, topic-sourced and hybrid search over a batch of queries.

Frames used throughout:
  queries   query_id, query_vec
  chunks    chunk_id, text, metadata, embedding, topic_l1_id, topic_l2_id, ts_from, ...
  topics    topic_id, title, center_vec, ...
  hits      query_id, chunk_id, score, distance, source
No side is forced into a broadcast: topic and chunk tables may be large, so the size-checked
join choice is left to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..config import Config
from ..functions.text import link_msg_id, message_link, meta_get
from ..functions.vectors import score, score_hydrated
from ..session import cut
from .nearest import top_k


def search_direct(queries: DataFrame, chunks: DataFrame, k: int, **kw) -> DataFrame:
    """The k nearest chunks of every query by index distance."""
    return top_k(queries, chunks, k, **kw)


def search_basic(queries: DataFrame, chunks: DataFrame, k: int = 3, **kw) -> DataFrame:
    """Nearest chunks with their metadata."""
    hits = search_direct(queries, chunks, k, **kw)
    return hits.join(chunks.select("chunk_id", "metadata"), "chunk_id", "left").select(
        "query_id", "rank", "chunk_id", "distance", "metadata"
    )


def within(hits: DataFrame, max_distance: float | None) -> DataFrame:
    return hits if max_distance is None else hits.filter(F.col("distance") <= max_distance)


def similar_topics(
    queries: DataFrame, topics: DataFrame, n: int, min_similarity: float = fixed.TOPIC_MIN_SIMILARITY, **kw
) -> DataFrame:
    """Topics whose centroid is at least ``min_similarity`` similar, best ``n`` per query."""
    usable = topics.filter(F.exists("center_vec", lambda x: x != 0)).select("topic_id", "center_vec")
    asked = queries.filter(F.exists("query_vec", lambda x: x != 0))
    best = top_k(asked, usable, n, vector_id="topic_id", vector="center_vec", metric="cosine", **kw)
    return best.withColumn("similarity", 1.0 - F.col("distance")).filter(F.col("similarity") >= min_similarity).drop("distance")


def l2_candidates(queries: DataFrame, topics_l2: DataFrame, n: int = 5, **kw) -> DataFrame:
    """The n super-topics with the nearest centroid, by index distance."""
    usable = topics_l2.filter(F.col("center_vec").isNotNull())
    return top_k(queries, usable, n, vector_id="topic_id", vector="center_vec", metric="sq_l2", **kw)


def search_two_stage(
    queries: DataFrame,
    chunks: DataFrame,
    topics_l2: DataFrame,
    l2_top_k: int = 5,
    chunk_top_k: int = 50,
    mode: str = "index",
    score_kind: str = "compat",
    **kw,
) -> DataFrame:
    """Nearest chunks inside each query's nearest super-topics, re-ranked by score.

    ``mode="cosine"`` scores by cosine similarity, the way taken when an index cannot filter.
    """
    picked = l2_candidates(queries, topics_l2, l2_top_k, **kw).select("query_id", F.col("topic_id").alias("topic_l2_id"))
    usable = chunks
    if mode == "cosine":
        usable = chunks.filter(F.exists("embedding", lambda x: x != 0))
    hits = top_k(
        queries, usable, chunk_top_k, metric="cosine" if mode == "cosine" else "sq_l2", within=picked, cell="topic_l2_id", **kw
    )
    graded = 1.0 - F.col("distance") if mode == "cosine" else score(F.col("distance"), score_kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        hits.withColumn("score", graded)
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .withColumn("source", F.lit("two_stage"))
    )


def search(queries: DataFrame, chunks: DataFrame, topics_l2: DataFrame, k: int, cfg: Config = Config(), **kw) -> DataFrame:
    """Two-stage hits limited to k; queries it finds nothing for are answered directly.

    The hits, k per query at most, are materialised: which queries are left depends on them."""
    direct_queries = queries
    found = None
    if cfg.search_mode == "two_stage":
        found = cut(search_two_stage(queries, chunks, topics_l2, cfg.l2_top_k, cfg.chunk_top_k, **kw).filter(F.col("rank") <= k))
        direct_queries = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
        if direct_queries.isEmpty():
            return found
    direct = (
        search_direct(direct_queries, chunks, k, **kw)
        .withColumn("score", score(F.col("distance")))
        .withColumn("source", F.lit("vector"))
    )
    return direct if found is None else found.unionByName(direct)


def first_chunks(chunks: DataFrame, topic: str, m: int) -> DataFrame:
    """The first m chunks of every topic in time order (pre-limited before the shuffle)."""
    order = Window.partitionBy(topic).orderBy(F.col("ts_from").asc_nulls_last(), "chunk_id")
    return (
        chunks.filter(F.col(topic).isNotNull())
        .select("chunk_id", F.col(topic).alias("topic_id"), F.row_number().over(order).alias("nth"))
        .filter(F.col("nth") <= m)
    )


def topic_hits(similar_l1: DataFrame, similar_l2: DataFrame, chunks: DataFrame, m: int = fixed.TOPIC_CHUNKS) -> DataFrame:
    """Chunks taken from similar topics: first-level topics first, first occurrence wins."""
    def side(similar: DataFrame, topic: str, level: int, points: float) -> DataFrame:
        return similar.select("query_id", "topic_id", "rank").join(first_chunks(chunks, topic, m), "topic_id").select(
            "query_id",
            "chunk_id",
            F.struct(F.lit(level).alias("level"), F.col("rank"), F.col("nth")).alias("place"),
            F.lit(points).alias("score"),
            F.lit(topic[:-3]).alias("source"),
        )

    both = side(similar_l1, "topic_l1_id", 1, fixed.TOPIC_L1_SCORE).unionByName(
        side(similar_l2, "topic_l2_id", 2, fixed.TOPIC_L2_SCORE)
    )
    return (
        both.groupBy("query_id", "chunk_id")
        .agg(F.min_by(F.struct("score", "source"), "place").alias("_w"))
        .select("query_id", "chunk_id", "_w.score", "_w.source")
    )


def merge_hits(vector_hits: DataFrame, topic_found: DataFrame, weight: float = 0.3) -> DataFrame:
    """Weighted union: (1-w) of the vector score plus half of w times the topic score;
    chunks only a topic brought get w times their topic score."""
    v = vector_hits.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("v_score"), F.max_by(F.struct("distance", "source"), "score").alias("v_row")
    )
    t = topic_found.select("query_id", "chunk_id", F.col("score").alias("t_score"), F.col("source").alias("t_source"))
    both = v.join(t, ["query_id", "chunk_id"], "full_outer")
    merged = (
        F.when(F.col("v_score").isNull(), F.col("t_score") * weight)
        .when(F.col("t_score").isNull(), F.col("v_score") * (1.0 - weight))
        .otherwise(F.col("v_score") * (1.0 - weight) + F.col("t_score") * weight * 0.5)
    )
    return both.select(
        "query_id",
        "chunk_id",
        merged.alias("score"),
        F.col("v_row.distance").alias("distance"),
        F.coalesce(F.col("v_row.source"), F.col("t_source")).alias("source"),
    )


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    topics_l1: DataFrame,
    topics_l2: DataFrame,
    k: int = 5,
    cfg: Config = Config(),
    use_topics: bool | None = None,
    rag_ntop: int = 0,
    **kw,
) -> DataFrame:
    """Hybrid retrieval: vector hits merged with topic hits, best k per query."""
    hits = search(queries, chunks, topics_l2, k, cfg, **kw)
    if cfg.use_topics if use_topics is None else use_topics:
        from_topics = topic_hits(
            similar_topics(queries, topics_l1, fixed.TOPIC_L1_WIDTH, cfg.topic_min_similarity, **kw),
            similar_topics(queries, topics_l2, fixed.TOPIC_L2_WIDTH, cfg.topic_min_similarity, **kw),
            chunks,
        )
        merged = merge_hits(hits, from_topics, cfg.topic_weight)
    else:
        merged = hits.select(
            "query_id", "chunk_id", (F.col("score") * (1.0 - cfg.topic_weight)).alias("score"), "distance", "source"
        )
    limit = min(k, rag_ntop) if rag_ntop > 0 else k
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return best.withColumn("rank", F.col("rank").cast("long"))


# --- joining hits back to the archive ----------------------------------------------


def resolve_topics(chunks: DataFrame, topics_l1: DataFrame, topics_l2: DataFrame) -> DataFrame:
    """Level-1 topic by key; level 2 through its parent, the chunk's own only without level 1."""
    l1 = topics_l1.select(
        F.col("topic_id").alias("topic_l1_id"), F.col("title").alias("topic_l1_title"), F.col("parent_l2_id").alias("_parent")
    )
    l2 = topics_l2.select(F.col("topic_id").alias("_l2"), F.col("title").alias("topic_l2_title"))
    through = F.when(F.col("topic_l1_id").isNotNull(), F.col("_parent")).otherwise(F.col("topic_l2_id"))
    return (
        chunks.join(l1, "topic_l1_id", "left")
        .withColumn("_through", through)
        .join(l2, F.col("_through") == F.col("_l2"), "left")
        .withColumn("resolved_l2_id", F.col("_l2"))
        .drop("_parent", "_l2", "_through")
    )


def hydrate(hits: DataFrame, chunks: DataFrame, topics_l1: DataFrame, topics_l2: DataFrame) -> DataFrame:
    """Hits with text, metadata and the titles of both topic levels; unknown ids drop out."""
    l1 = topics_l1.select(F.col("topic_id").alias("topic_l1_id"), F.col("title").alias("topic_l1_title"))
    l2 = topics_l2.select(F.col("topic_id").alias("topic_l2_id"), F.col("title").alias("topic_l2_title"))
    wanted = chunks.select("chunk_id", "text", "metadata", "topic_l1_id", "topic_l2_id")
    return hits.join(wanted, "chunk_id").join(l1, "topic_l1_id", "left").join(l2, "topic_l2_id", "left")


def link_info(chunks: DataFrame) -> DataFrame:
    """``chat`` and ``message`` numbers, user name and permalink of each chunk's first message."""
    from ..functions.text import to_bigint

    return (
        chunks.select(
            "chunk_id",
            to_bigint(F.col("chat_id")).alias("link_chat_id"),
            link_msg_id(F.col("msg_id_start")).alias("link_msg_id"),
            meta_get(F.col("metadata"), "chat_username").alias("chat_username"),
        )
        .filter(F.col("link_chat_id").isNotNull() & F.col("link_msg_id").isNotNull())
        .withColumn("link", message_link(F.col("link_chat_id"), F.col("link_msg_id"), F.col("chat_username")))
    )


def search_links(queries: DataFrame, chunks: DataFrame, k: int = 3, **kw) -> DataFrame:
    hits = search_direct(queries, chunks, k, **kw)
    return hits.join(link_info(chunks), "chunk_id")


def search_full(
    queries: DataFrame, chunks: DataFrame, messages: DataFrame, topics_l1: DataFrame, topics_l2: DataFrame, k: int = 5, **kw
) -> DataFrame:
    """Hits with topics, link and the list of their messages (J3), scored by the hydrated rule."""
    from .hydrate import chunk_messages

    hits = search_direct(queries, chunks, k, **kw).withColumn("similarity", score_hydrated(F.col("distance")))
    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    member = F.struct("ts", "msg_id", "from_id", "text_message")
    listed = (
        chunk_messages(wanted, messages, by="ts")
        .groupBy("chunk_id")
        .agg(F.array_sort(F.collect_list(member)).alias("messages"))
    )
    return (
        hits.join(resolve_topics(wanted, topics_l1, topics_l2), "chunk_id")
        .join(listed, "chunk_id", "left")
        .join(link_info(wanted), "chunk_id", "left")
        .withColumn("messages", F.coalesce("messages", F.array().cast(listed.schema["messages"].dataType)))
    )


def search_contents(
    queries: DataFrame,
    chunks: DataFrame,
    messages: DataFrame,
    k: int = 3,
    max_distance: float | None = None,
    two_stage=None,
    dedupe: bool = False,
    **kw,
) -> DataFrame:
    """Messages of the best chunks, rendered and split into parts.

    Four times k candidates are fetched before the distance filter cuts to k.  ``two_stage``
    is a function ``k -> retrieved hits`` for the hybrid way; without it search is direct.
    """
    if two_stage is not None:
        found = two_stage(4 * k).withColumn("distance", F.coalesce("distance", 1.0 - F.col("score")))
        order = Window.partitionBy("query_id").orderBy("rank")
    else:
        found = search_direct(queries, chunks, 4 * k, **kw)
        order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    kept = within(found, max_distance).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    kept = kept.withColumn("rank", F.col("rank").cast("long"))
    return message_parts(kept, chunks, messages, dedupe)


def find(queries: DataFrame, chunks: DataFrame, messages: DataFrame, max_distance: float = Config.max_distance, width: int = fixed.FIND_WIDTH, **kw) -> DataFrame:
    """Threshold search: the nearest ``width`` chunks within ``max_distance``, as message parts."""
    return message_parts(within(search_direct(queries, chunks, width, **kw), max_distance), chunks, messages)


def find_totals(queries: DataFrame, chunks: DataFrame, messages: DataFrame, max_distance: float = Config.max_distance, width: int = fixed.FIND_WIDTH, **kw) -> DataFrame:
    """``query_id, parts, chars, chunks``: how many parts ``find`` gives a query, their characters and chunks.

    Parts are counted once a message and once a chunk, so no text meets the hits."""
    from .hydrate import chunk_messages
    from .render import split_parts

    hits = cut(within(search_direct(queries, chunks, width, **kw), max_distance).select("query_id", "chunk_id"))
    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    members = chunk_messages(wanted, messages, by="ids").select("chunk_id", "msg_id")
    of_message = split_parts(messages).groupBy("msg_id").agg(F.count("*").alias("parts"), F.sum(F.char_length("content")).alias("chars"))
    of_chunk = members.join(of_message, "msg_id").groupBy("chunk_id").agg(F.sum("parts").alias("parts"), F.sum("chars").alias("chars"))
    return hits.join(of_chunk, "chunk_id").groupBy("query_id").agg(
        F.sum("parts").alias("parts"), F.sum("chars").alias("chars"), F.count_distinct("chunk_id").alias("chunks")
    )


def message_parts(hits: DataFrame, chunks: DataFrame, messages: DataFrame, dedupe: bool = False) -> DataFrame:
    """Hits to message rows to rendered parts; every message is rendered once, whoever hit it."""
    from .hydrate import chunk_messages
    from .render import split_parts

    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    members = chunk_messages(wanted, messages, by="ids").select("chunk_id", "msg_id")
    rows = hits.select("query_id", "rank", "chunk_id", "distance").join(members, "chunk_id")
    if dedupe:
        rows = rows.groupBy("query_id", "msg_id").agg(
            F.min_by(F.struct("rank", "chunk_id", "distance"), F.struct("distance", "rank")).alias("_b")
        ).select("query_id", "msg_id", "_b.*")
    shown = messages.join(members.select("msg_id").distinct(), "msg_id", "left_semi")
    return rows.join(split_parts(shown), "msg_id")


def topic_detail(topics_l1: DataFrame, topics_l2: DataFrame, chunks: DataFrame, samples: int = 3) -> DataFrame:
    """One row per child of a super-topic, and per sample text of a topic."""
    from ..functions.text import preview

    subs = topics_l1.filter(F.col("parent_l2_id").isNotNull()).join(
        topics_l2.select(F.col("topic_id").alias("parent_l2_id")), "parent_l2_id", "left_semi"
    ).select(
        F.lit("l2").alias("level"),
        F.col("parent_l2_id").alias("topic_id"),
        F.col("topic_id").alias("item"),
        F.col("title").alias("content"),
        F.col("chunk_count").cast("long").alias("chunk_count"),
    )
    nth = first_chunks(chunks, "topic_l1_id", samples)
    shown = (
        nth.join(chunks.select("chunk_id", "text"), "chunk_id")
        .join(topics_l1.select("topic_id", "chunk_count"), "topic_id")
        .select(
            F.lit("l1").alias("level"),
            "topic_id",
            F.col("nth").cast("long").alias("item"),
            preview(F.col("text")).alias("content"),
            F.col("chunk_count").cast("long").alias("chunk_count"),
        )
    )
    return subs.unionByName(shown)
