"""The archive tables as derived from the given parquet tables, in Spark and in SQL.

Every ``CTE`` entry is the SQL twin of the function with the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise
from ..operators import topics as topic_ops

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(expr: str):
    return F.expr(f"{EPOCH} + make_dt_interval(0, 0, cast({expr} as int), 0)")


def messages(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.expr("concat_ws('_', conv_id, turn)").alias("msg_id"),
        F.col("conv_id").cast("string").alias("chat_id"),
        _minutes("turn").alias("ts"),
        F.col("role").alias("from_id"),
        "text",
    )


def queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def all_chunks(spark, d) -> DataFrame:
    """One chunk per document; those without a vector have no topic either."""
    e, doc = table(spark, d, "embeddings"), table(spark, d, "documents")
    kind = "coalesce(label, doc_id % 10)"
    rows = doc.join(e, e["vec_id"] == doc["doc_id"], "left").select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        "embedding",
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("embedding_dim"),
        F.expr("case when label = 9 then null else cast(label as bigint) end").alias("topic_l1_id"),
        F.expr("case when label = 8 then null when label = 9 then 2L else cast(label % 3 as bigint) end").alias("topic_l2_id"),
        F.expr(
            f"case {kind} % 3 when 0 then concat('-100', 1000 + {kind}) when 1 then concat('-', 500 + {kind}) else concat('', 70 + {kind}) end"
        ).alias("chat_id"),
        _minutes("doc_id").alias("ts_from"),
        _minutes("doc_id + n_chars % 7").alias("ts_to"),
        (F.col("n_chars") % 7 + 1).alias("message_count"),
        "label",
    )
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumn("msg_id_start", F.concat_ws("_", "chat_id", "chunk_id")).withColumn("msg_id_end", F.col("msg_id_start")).withColumn(
        "metadata",
        F.concat(
            F.lit('{"message_count": '), F.col("message_count").cast("string"), F.lit(', "start_date": "'), iso("ts_from"),
            F.lit('", "end_date": "'), iso("ts_to"), F.lit('"'),
            F.when(F.col("label") % 4 == 0, F.concat(F.lit(', "chat_username": "room'), F.col("label").cast("string"), F.lit('"'))).otherwise(F.lit("")),
            F.lit("}"),
        ),
    ).drop("label")


def chunks(spark, d) -> DataFrame:
    """The chunks that have a vector."""
    return all_chunks(spark, d).filter(F.col("embedding").isNotNull())


def conv_chunks(spark, d) -> DataFrame:
    """Chunks whose message range is a whole conversation, dealt over all of them; every fifth has no known end."""
    c = table(spark, d, "conversations")
    span = c.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    many = c.agg((F.max("conv_id") + 1).alias("many"))
    rows = chunks(spark, d).crossJoin(F.broadcast(many)).withColumn("conv_id", F.expr("chunk_id % many")).join(span, "conv_id")  # one row
    return rows.withColumns(
        {
            "chat_id": F.expr("cast(conv_id as string)"),
            "msg_id_start": F.expr("concat(conv_id, '_', lo)"),
            "msg_id_end": F.expr("case when chunk_id % 5 = 0 then concat(conv_id, '_none') else concat(conv_id, '_', hi) end"),
            "ts_from": F.expr(f"case when chunk_id % 7 = 0 then null when chunk_id % 7 = 1 then {EPOCH} + make_dt_interval(0, 0, cast(hi + 500 as int), 0) else {EPOCH} + make_dt_interval(0, 0, cast(lo as int), 0) end"),
            "ts_to": F.expr(f"{EPOCH} + make_dt_interval(0, 0, cast(case when chunk_id % 7 = 1 then hi + 600 else hi end as int), 0)"),
        }
    ).drop("conv_id", "lo", "hi", "many")


def topics_l1(spark, d) -> DataFrame:
    rolled = topic_ops.rollup_l1(chunks(spark, d))
    return rolled.withColumns(
        {
            "title": F.expr("case when topic_id % 4 = 3 then 'unknown' else concat('Topic number ', topic_id) end"),
            "parent_l2_id": F.expr("case when topic_id = 8 then null else topic_id % 3 end"),
        }
    )


def topics_l2(spark, d) -> DataFrame:
    return super_topics(topics_l1(spark, d))


def super_topics(one: DataFrame) -> DataFrame:
    rolled = topic_ops.rollup_l2(one)
    return rolled.withColumn("title", F.expr("case when topic_id = 1 then '' else concat('Area ', topic_id) end"))


CTE = {
    "messages": """messages AS (
  SELECT conv_id || '_' || turn AS msg_id, CAST(conv_id AS VARCHAR) AS chat_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS ts, role AS from_id, text
  FROM conversations)""",
    "queries": "queries AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[64]) AS q FROM embeddings)",
    "chunks": """chunks0 AS (
  SELECT doc_id AS chunk_id, text, CAST(embedding AS DOUBLE[64]) AS v, label, coalesce(label, doc_id % 10) AS kind,
         CASE WHEN label = 9 THEN NULL ELSE CAST(label AS BIGINT) END AS topic_l1_id,
         CASE WHEN label = 8 THEN NULL WHEN label = 9 THEN 2 ELSE CAST(label % 3 AS BIGINT) END AS topic_l2_id,
         CASE kind % 3 WHEN 0 THEN '-100' || (1000 + kind) WHEN 1 THEN '-' || (500 + kind) ELSE '' || (70 + kind) END AS chat_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts_from,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id + n_chars % 7) AS ts_to,
         n_chars % 7 + 1 AS message_count
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
chunks AS (
  SELECT *, chat_id || '_' || chunk_id AS msg_id_start, chat_id || '_' || chunk_id AS msg_id_end,
         '{"message_count": ' || message_count || ', "start_date": "' || strftime(ts_from, '%Y-%m-%dT%H:%M:%S')
           || '", "end_date": "' || strftime(ts_to, '%Y-%m-%dT%H:%M:%S') || '"'
           || CASE WHEN label % 4 = 0 THEN ', "chat_username": "room' || label || '"' ELSE '' END || '}' AS metadata
  FROM chunks0 WHERE v IS NOT NULL)""",
    "conv_chunks": """conv_span AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1),
conv_many AS (SELECT max(conv_id) + 1 AS many FROM conversations),
conv_chunks AS (
  SELECT chunk_id, text, v, topic_l1_id, topic_l2_id, metadata,
         CAST(conv_id AS VARCHAR) AS chat_id, conv_id || '_' || lo AS msg_id_start,
         CASE WHEN chunk_id % 5 = 0 THEN conv_id || '_none' ELSE conv_id || '_' || hi END AS msg_id_end,
         CASE WHEN chunk_id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CASE WHEN chunk_id % 7 = 1 THEN hi + 500 ELSE lo END) END AS ts_from,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CASE WHEN chunk_id % 7 = 1 THEN hi + 600 ELSE hi END) AS ts_to
  FROM chunks, conv_many JOIN conv_span ON conv_id = chunk_id % many)""",
    "topics_l1": """unit AS (
  SELECT chunk_id, topic_l1_id, i AS pos, v[i] / sqrt(array_inner_product(v, v)) AS x
  FROM chunks, range(1, 65) AS t(i) WHERE topic_l1_id IS NOT NULL),
center1 AS (SELECT topic_id, list(c ORDER BY pos) AS center_list FROM
  (SELECT topic_l1_id AS topic_id, pos, avg(x) AS c FROM unit GROUP BY ALL) GROUP BY topic_id),
topics_l1 AS (
  SELECT g.topic_id, CASE WHEN g.topic_id % 4 = 3 THEN 'unknown' ELSE 'Topic number ' || g.topic_id END AS title,
         CASE WHEN g.topic_id = 8 THEN NULL ELSE g.topic_id % 3 END AS parent_l2_id,
         chunk_count, msg_count, ts_from, ts_to, CAST(center_list AS DOUBLE[64]) AS center
  FROM (SELECT topic_l1_id AS topic_id, count(*) AS chunk_count, CAST(sum(message_count) AS BIGINT) AS msg_count,
               min(ts_from) AS ts_from, max(ts_to) AS ts_to
        FROM chunks WHERE topic_l1_id IS NOT NULL GROUP BY 1) g JOIN center1 USING (topic_id))""",
    "topics_l2": """center2 AS (SELECT topic_id, list(c ORDER BY pos) AS center_list FROM
  (SELECT parent_l2_id AS topic_id, i AS pos, avg(center[i] / sqrt(array_inner_product(center, center))) AS c
   FROM topics_l1, range(1, 65) AS t(i) WHERE parent_l2_id IS NOT NULL GROUP BY ALL) GROUP BY topic_id),
topics_l2 AS (
  SELECT g.topic_id, CASE WHEN g.topic_id = 1 THEN '' ELSE 'Area ' || g.topic_id END AS title, g.chunk_count,
         CAST(center_list AS DOUBLE[64]) AS center
  FROM (SELECT parent_l2_id AS topic_id, CAST(sum(chunk_count) AS BIGINT) AS chunk_count
        FROM topics_l1 WHERE parent_l2_id IS NOT NULL GROUP BY 1) g JOIN center2 USING (topic_id))""",
    # every query against every chunk, once
    "pairs": """pairs AS MATERIALIZED (
  SELECT query_id, chunk_id, topic_l2_id, array_distance(q, v) ** 2 AS distance, array_cosine_similarity(q, v) AS cos
  FROM queries, chunks)""",
    "direct": """direct AS (
  SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs)""",
    "l2_hits": """l2_hits AS (
  SELECT query_id, topic_id, distance, rank FROM (
    SELECT query_id, topic_id, array_distance(q, center) ** 2 AS distance,
           row_number() OVER (PARTITION BY query_id ORDER BY array_distance(q, center) ** 2, topic_id) AS rank
    FROM queries, topics_l2) WHERE rank <= 2)""",
    "two_stage": """two_stage AS (
  SELECT query_id, chunk_id, distance, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT *, CASE WHEN distance <= 1 THEN 1 - distance WHEN distance <= 2 THEN 1 - distance / 2 ELSE greatest(0.0, 1 - distance) END AS score
    FROM (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.chunk_id) AS near
          FROM pairs p JOIN l2_hits h ON p.query_id = h.query_id AND p.topic_l2_id = h.topic_id)
    WHERE near <= 50))""",
    "alike": """alike AS (
  SELECT query_id, level, topic_id, similarity, rank FROM (
    SELECT query_id, level, topic_id, array_cosine_similarity(q, center) AS similarity,
           row_number() OVER (PARTITION BY query_id, level ORDER BY 1 - array_cosine_similarity(q, center), topic_id) AS rank
    FROM queries, (SELECT 1 AS level, topic_id, center FROM topics_l1 UNION ALL SELECT 2, topic_id, center FROM topics_l2))
  WHERE rank <= CASE level WHEN 1 THEN 2 ELSE 1 END AND similarity >= 0.2)""",
    "topic_hits": """topic_hits AS (
  SELECT query_id, chunk_id, CASE level WHEN 1 THEN 0.8 ELSE 0.75 END AS score,
         CASE level WHEN 1 THEN 'topic_l1' ELSE 'topic_l2' END AS source FROM (
    SELECT s.query_id, c.chunk_id, s.level,
           row_number() OVER (PARTITION BY s.query_id, c.chunk_id ORDER BY s.level, s.rank, c.nth) AS n
    FROM alike s JOIN (
      SELECT 1 AS level, topic_l1_id AS topic_id, chunk_id, row_number() OVER (PARTITION BY topic_l1_id ORDER BY ts_from, chunk_id) AS nth
      FROM chunks WHERE topic_l1_id IS NOT NULL
      UNION ALL
      SELECT 2, topic_l2_id, chunk_id, row_number() OVER (PARTITION BY topic_l2_id ORDER BY ts_from, chunk_id)
      FROM chunks WHERE topic_l2_id IS NOT NULL) c
    ON s.level = c.level AND s.topic_id = c.topic_id AND c.nth <= 3) WHERE n = 1)""",
    "merged": """merged AS (
  SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id,
         CASE WHEN v.score IS NULL THEN t.score * 0.3 WHEN t.score IS NULL THEN v.score * 0.7
              ELSE v.score * 0.7 + t.score * 0.3 * 0.5 END AS score,
         v.distance, CASE WHEN v.score IS NULL THEN t.source ELSE 'two_stage' END AS source
  FROM (SELECT * FROM two_stage WHERE rank <= 5) v FULL OUTER JOIN topic_hits t
    ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id)""",
    "retrieved": """retrieved AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM merged) WHERE rank <= 5)""",
    "links": """links AS (
  SELECT chunk_id, link_chat_id, link_msg_id, chat_username,
    CASE WHEN length(trim(coalesce(chat_username, ''))) > 0 THEN 'https://t.me/' || chat_username || '/' || link_msg_id
         WHEN link_chat_id < 0 AND starts_with(CAST(-link_chat_id AS VARCHAR), '100')
           THEN 'https://t.me/c/' || CAST(CAST(substr(CAST(-link_chat_id AS VARCHAR), 4) AS BIGINT) AS VARCHAR) || '/' || link_msg_id
         WHEN link_chat_id < 0 THEN 'tg://openmessage?chat_id=' || link_chat_id || '&message_id=' || link_msg_id
         ELSE 'tg://openmessage?user_id=' || link_chat_id || '&message_id=' || link_msg_id END AS link
  FROM (SELECT chunk_id, CAST(chat_id AS BIGINT) AS link_chat_id,
               CAST(substr(msg_id_start, strpos(msg_id_start, '_') + 1) AS BIGINT) AS link_msg_id,
               json_extract_string(metadata, '$.chat_username') AS chat_username FROM chunks))""",
    # member messages of conv_chunks, by ids and by time window with its fallbacks
    "by_ids": """by_ids AS (
  SELECT c.chunk_id, m.ts, m.msg_id, m.from_id, m.text AS text_message
  FROM conv_chunks c JOIN messages s ON s.msg_id = c.msg_id_start LEFT JOIN messages e ON e.msg_id = c.msg_id_end
  JOIN messages m ON (e.msg_id IS NOT NULL AND m.chat_id = c.chat_id AND m.ts BETWEEN s.ts AND e.ts)
                  OR (e.msg_id IS NULL AND m.msg_id = c.msg_id_start))""",
    "by_ts": """window_rows AS (
  SELECT c.chunk_id, m.ts, m.msg_id, m.from_id, m.text AS text_message
  FROM conv_chunks c JOIN messages m ON m.chat_id = c.chat_id AND m.ts BETWEEN c.ts_from AND c.ts_to),
id_rows AS (
  SELECT c.chunk_id, m.ts, m.msg_id, m.from_id, m.text AS text_message
  FROM conv_chunks c JOIN messages m ON m.chat_id = c.chat_id AND m.msg_id BETWEEN c.msg_id_start AND c.msg_id_end
  WHERE c.chunk_id NOT IN (SELECT chunk_id FROM window_rows)),
by_ts AS (
  SELECT * FROM window_rows UNION ALL SELECT * FROM id_rows UNION ALL
  SELECT c.chunk_id, m.ts, m.msg_id, m.from_id, m.text
  FROM conv_chunks c JOIN messages m ON m.msg_id = c.msg_id_start
  WHERE c.chunk_id NOT IN (SELECT chunk_id FROM window_rows) AND c.chunk_id NOT IN (SELECT chunk_id FROM id_rows))""",
    # render and split, for rows (msg_id, render_id, date, sender, body)
    "parts": """esc AS (
  SELECT *, replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS e,
    '<code>id: ' || render_id || '</code>' || chr(10) || '<code>date: ' || date || '</code>' || chr(10) || '<code>sender: '
      || replace(replace(replace(replace(replace(sender, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
      || '</code>' || chr(10) AS head
  FROM rendered),
step AS (
  SELECT msg_id, head, e AS rest, 0 AS part, CAST('' AS VARCHAR) AS piece, 4096 - length(head) - 21 - 11 AS room
  FROM esc WHERE length(head || '<pre>' || e || '</pre>') > 4096
  UNION ALL
  SELECT msg_id, head, substr(rest, cut + 1), part + 1, substr(rest, 1, cut), room FROM (
    SELECT *, CASE WHEN length(rest) <= room THEN length(rest)
                   WHEN room - strpos(reverse(substr(rest, 1, room)), chr(10)) > room * 0.8 AND strpos(reverse(substr(rest, 1, room)), chr(10)) > 0
                     THEN room - strpos(reverse(substr(rest, 1, room)), chr(10)) + 1
                   WHEN room - strpos(reverse(substr(rest, 1, room)), ' ') > room * 0.8 AND strpos(reverse(substr(rest, 1, room)), ' ') > 0
                     THEN room - strpos(reverse(substr(rest, 1, room)), ' ') + 1
                   ELSE room END AS cut
    FROM step WHERE length(rest) > 0)),
parts AS (
  SELECT msg_id, 0 AS part, head || '<pre>' || e || '</pre>' AS content FROM esc WHERE length(head || '<pre>' || e || '</pre>') <= 4096
  UNION ALL
  SELECT msg_id, part, head || '<code>part: ' || part || '</code>' || chr(10) || '<pre>' || piece || '</pre>' FROM step WHERE part > 0)""",
}

NEEDS = {
    "conv_chunks": ["chunks"],
    "topics_l1": ["chunks"],
    "topics_l2": ["topics_l1"],
    "pairs": ["queries", "chunks"],
    "direct": ["pairs"],
    "l2_hits": ["queries", "topics_l2"],
    "two_stage": ["pairs", "l2_hits"],
    "alike": ["queries", "topics_l2"],
    "topic_hits": ["alike", "chunks"],
    "merged": ["two_stage", "topic_hits"],
    "retrieved": ["merged"],
    "links": ["chunks"],
    "by_ids": ["conv_chunks", "messages"],
    "by_ts": ["conv_chunks", "messages"],
}


def sql(body: str, *ctes: str, recursive: bool = False, extra: str = "", whole: bool = False) -> str:
    """``body`` behind the named CTEs and all they need, each once; ``whole``: over ``all_chunks``."""
    seen: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in seen:
            seen.append(name)

    late = [c for c in ctes if c == "parts"]
    for c in ctes:
        if c not in late:
            add(c)
    texts = [CTE[n] for n in seen] + ([extra] if extra else []) + [CTE[n] for n in late]
    if whole:
        texts = [t.replace("FROM chunks0 WHERE v IS NOT NULL", "FROM chunks0") for t in texts]
    head = "WITH RECURSIVE " if recursive or late else "WITH "
    return (head + ",\n".join(texts) + "\n" if texts else "") + body
