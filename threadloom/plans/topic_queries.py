"""Roll-ups, hierarchy and clustering over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import hydrate, topics
from . import bindings as b
from .catalog import query

FMT = "'%Y-%m-%d %H:%M'"


@query(
    b.sql(
        f"SELECT topic_id, chunk_count, msg_count, strftime(ts_from, {FMT}) AS ts_from, strftime(ts_to, {FMT}) AS ts_to FROM topics_l1",
        "topics_l1",
    )
)
def rollup_l1(spark, d):
    fmt = "yyyy-MM-dd HH:mm"
    return topics.rollup_l1(b.chunks(spark, d)).select(
        "topic_id", "chunk_count", "msg_count", F.date_format("ts_from", fmt).alias("ts_from"), F.date_format("ts_to", fmt).alias("ts_to")
    )


@query(b.sql("SELECT topic_id, i AS pos, round(center[i], 6) + 0.0 AS value FROM topics_l1, range(1, 65) AS t(i)", "topics_l1"))
def centroids_l1(spark, d):
    rows = topics.rollup_l1(b.chunks(spark, d)).select("topic_id", F.posexplode("center_vec").alias("p", "x"))
    return rows.select("topic_id", (F.col("p") + 1).cast("long").alias("pos"), rounded(F.col("x")).alias("value"))


@query(
    b.sql("SELECT topic_id, chunk_count, i AS pos, round(center[i], 6) + 0.0 AS value FROM topics_l2, range(1, 65) AS t(i)", "topics_l2")
)
def rollup_l2(spark, d):
    rows = topics.rollup_l2(b.topics_l1(spark, d)).select("topic_id", "chunk_count", F.posexplode("center_vec").alias("p", "x"))
    return rows.select("topic_id", "chunk_count", (F.col("p") + 1).cast("long").alias("pos"), rounded(F.col("x")).alias("value"))


@query(
    """SELECT count(DISTINCT CASE WHEN label < 6 THEN label END) AS clusters, count(*) FILTER (WHERE label >= 6) AS noise,
  round(count(*) FILTER (WHERE label >= 6) * 100.0 / count(*), 6) AS noise_percentage, count(*) FILTER (WHERE label >= 6) * 100.0 / count(*) > 50 AS high_noise FROM embeddings"""
)
def noise_stats(spark, d):
    e = b.table(spark, d, "embeddings")
    return topics.noise_stats(e.select(F.when(F.col("label") < 6, F.col("label")).otherwise(F.lit(-1)).alias("label")))


@query(
    b.sql(
        """SELECT 'l2' AS kind, z.topic_id, CASE z.title WHEN '' THEN 'unknown' ELSE substr(z.title, 1, 38) END AS title, count(a.topic_id) AS l1_count,
  CAST(coalesce(sum(a.chunk_count), 0) AS BIGINT) AS chunk_count
FROM topics_l2 z LEFT JOIN topics_l1 a ON a.parent_l2_id = z.topic_id GROUP BY z.topic_id, z.title
UNION ALL
SELECT CASE WHEN parent_l2_id IS NULL THEN 'orphan' ELSE 'l1' END, topic_id, substr(title, 1, 38), 0, chunk_count FROM topics_l1""",
        "topics_l2",
    )
)
def topic_tree(spark, d):
    return topics.topic_tree(b.topics_l1(spark, d), b.topics_l2(spark, d))


@query(
    b.sql(
        """SELECT 'l2' AS level, parent_l2_id AS topic_id, 'topic' AS kind, CAST(topic_id AS VARCHAR) AS child_id FROM topics_l1 WHERE parent_l2_id IS NOT NULL
UNION ALL SELECT 'l1', topic_l1_id, 'chunk', CAST(chunk_id AS VARCHAR) FROM chunks WHERE topic_l1_id IS NOT NULL
UNION ALL SELECT 'l2', topic_l2_id, 'chunk', CAST(chunk_id AS VARCHAR) FROM chunks WHERE topic_l2_id IS NOT NULL""",
        "topics_l1", whole=True,
    )
)
def topic_children(spark, d):
    return hydrate.children(b.topics_l1(spark, d), b.all_chunks(spark, d))


@query(
    """SELECT vec_id AS chunk_id, CASE WHEN label < 8 THEN label ELSE -1 END AS topic_l1_id,
  CASE WHEN label IN (0, 1, 2, 4, 5, 6) THEN label % 4 ELSE -1 END AS topic_l2_id FROM embeddings JOIN documents ON vec_id = doc_id"""
)
def assign_topics(spark, d):
    """Labels to chunks, super-labels to topics, and those on to the chunks."""
    e = b.table(spark, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") < 8, F.col("label")).otherwise(F.lit(-1)).alias("label"))
    chunks = topics.assign_l1(b.chunks(spark, d), labels)
    one = topics.rollup_l1(chunks)
    super_labels = one.select("topic_id", F.expr("if(topic_id % 4 = 3, -1, topic_id % 4)").alias("label"))
    placed = topics.propagate_l2(chunks, topics.assign_l2(one, super_labels))
    blank = F.lit(-1)
    return placed.select(
        "chunk_id", F.coalesce("topic_l1_id", blank).cast("int").alias("topic_l1_id"), F.coalesce("topic_l2_id", blank).cast("int").alias("topic_l2_id")
    )


@query(
    b.sql(
        """SELECT l2_id, row_number() OVER (PARTITION BY l2_id ORDER BY l1_rank, chunk_rank) AS place, l1_id, chunk_id, '--- chunk from topic l1-' || l1_id || ' ---' || chr(10) || substr(text, 1, 4096) AS block FROM (
  SELECT *, row_number() OVER (PARTITION BY l2_id, lower(s) ORDER BY l1_rank, chunk_rank) AS seen FROM (
    SELECT t.l2_id, t.l1_id, t.l1_rank, c.chunk_id, c.text, regexp_replace(regexp_replace(c.text, '^\\s+', ''), '\\s+$', '') AS s,
      row_number() OVER (PARTITION BY t.l2_id, t.l1_id ORDER BY round(array_cosine_similarity(t.center, c.v), 12) DESC, c.chunk_id) AS chunk_rank
    FROM (SELECT z.topic_id AS l2_id, a.topic_id AS l1_id, a.center,
            row_number() OVER (PARTITION BY z.topic_id ORDER BY round(array_cosine_similarity(z.center, a.center), 12) DESC, a.topic_id) AS l1_rank
          FROM topics_l2 z JOIN topics_l1 a ON a.parent_l2_id = z.topic_id) t JOIN chunks c ON c.topic_l1_id = t.l1_id
    WHERE t.l1_rank <= 5) WHERE chunk_rank <= 5 AND length(s) >= 30) WHERE seen = 1""",
        "topics_l2",
    )
)
def representatives(spark, d):
    return topics.representatives(b.topics_l2(spark, d), b.topics_l1(spark, d), b.chunks(spark, d))


@query(
    b.sql(
        """SELECT topic_l1_id AS topic_id, nth, chunk_id, 'Chunk ' || nth || chr(58) || chr(10) || substring(text, 1, 200) || '...' AS block FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_l1_id ORDER BY md5('0:' || chunk_id), chunk_id) AS nth FROM chunks WHERE topic_l1_id IS NOT NULL)
WHERE nth <= 5""",
        "chunks",
    )
)
def sample_chunks(spark, d):
    return topics.sample_chunks(b.chunks(spark, d)).withColumn("nth", F.col("nth").cast("long"))


@query(
    """WITH RECURSIVE e AS MATERIALIZED (
  SELECT a.vec_id AS a, o.vec_id AS b FROM embeddings a, embeddings o
  WHERE a.vec_id <> o.vec_id AND array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(o.embedding AS DOUBLE[64])) <= 1.08),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
SELECT id AS vec_id, min(root) AS root FROM r GROUP BY 1"""
)
def components_eps(spark, d):
    from ..operators.density import flat_cut

    return flat_cut(b.table(spark, d, "embeddings"), 1.08, "vec_id")


@query()
def density_topics(spark, d):
    """Hierarchical density labels of every vector; compared with brute force in the tests."""
    from ..operators.density import cluster

    return cluster(b.table(spark, d, "embeddings"), "vec_id", min_cluster_size=3, metric="cosine")


@query()
def spanning_tree(spark, d):
    from ..operators.density import spanning_tree_of

    tree = spanning_tree_of(b.table(spark, d, "embeddings"), "vec_id", metric="cosine")
    return tree.withColumn("w", rounded(F.col("w")))
