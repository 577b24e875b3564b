"""Projections, parsing and rendering over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import render
from . import bindings as b
from .catalog import query

NL = "chr(10)"


@query(
    b.sql(
        """SELECT msg_id, substr(msg_id, strpos(msg_id, '_') + 1) AS raw,
  CAST(substr(msg_id, strpos(msg_id, '_') + 1) AS BIGINT) AS num,
  '[date: ' || strftime(ts, '%Y-%m-%d %H:%M') || '] [user: ' || from_id || '] ' || text AS line,
  CAST(length('[date: ' || strftime(ts, '%Y-%m-%d %H:%M') || '] [user: ' || from_id || '] ' || text) // 4 AS BIGINT) AS tok,
  replace(text, chr(10), ' ') AS clean FROM messages""",
        "messages",
    )
)
def message_lines(spark, d):
    line = tx.format_message(F.col("ts"), F.col("from_id"), F.col("text"))
    return b.messages(spark, d).select(
        "msg_id",
        tx.raw_id(F.col("msg_id")).alias("raw"),
        tx.link_msg_id(F.col("msg_id")).alias("num"),
        line.alias("line"),
        tx.token_count(line).cast("long").alias("tok"),
        tx.clean_text(F.col("text")).alias("clean"),
    )


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
def strip_tags(spark, d):
    return b.table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    f"""SELECT doc_id, '<code>id: ' || doc_id || '</code>' || {NL} || '<code>date: ' || lang || '</code>' || {NL}
  || '<code>sender: ' || {_ESC.format('source')} || CASE WHEN lang = 'en' THEN ' (user_id: ' || n_chars || ')' ELSE '' END
  || '</code>' || {NL} || '<pre>' || {_ESC.format('text')} || '</pre>' AS html FROM documents"""
)
def render_html(spark, d):
    sender_id = F.when(F.col("lang") == "en", F.col("n_chars"))
    return b.table(spark, d, "documents").select(
        "doc_id", tx.render_html(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text"), sender_id).alias("html")
    )


_DOC_ROWS = """rendered AS (SELECT 'd_' || doc_id AS msg_id, doc_id AS render_id, '2024-01-01T00:00:00' AS date, source AS sender, text AS body
  FROM documents)"""


@query(b.sql("SELECT msg_id, CAST(part AS BIGINT) AS part, content FROM parts", "parts", extra=_DOC_ROWS))
def split_parts(spark, d):
    rows = b.table(spark, d, "documents").select(
        F.expr("concat('d_', doc_id)").alias("msg_id"), F.expr(b.EPOCH).alias("ts"), F.col("source").alias("from_id"), "text"
    )
    return render.split_parts(rows).select("msg_id", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "content")


@query(b.sql("SELECT chunk_id, link_chat_id, link_msg_id, coalesce(chat_username, '') AS chat_username, link FROM links", "links", whole=True))
def link_info(spark, d):
    from ..operators.search import link_info as op

    return op(b.all_chunks(spark, d)).withColumn("chat_username", F.coalesce("chat_username", F.lit("")))


@query(
    """SELECT conv_id, turn, CAST(CASE role WHEN 'system' THEN -1.0 WHEN 'user' THEN 1.5 ELSE length(text) + 0.5 END AS DOUBLE) AS threshold,
  CASE role WHEN 'system' THEN '' ELSE regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') END AS query,
  CASE role WHEN 'system' THEN 'threshold_without_query' ELSE '' END AS error FROM conversations"""
)
def parse_search_args(spark, d):
    said = F.expr(
        "case role when 'user' then concat('/find  ', text) when 'assistant' then concat(char_length(text), '.5 ', text) "
        "else cast(char_length(text) as string) end"
    )
    parsed = tx.parse_search_args(said)
    return (
        b.table(spark, d, "conversations")
        .select("conv_id", "turn", parsed.alias("p"))
        .select(
            "conv_id", "turn",
            F.coalesce("p.threshold", F.lit(-1.0)).alias("threshold"),
            F.coalesce("p.query", F.lit("")).alias("query"),
            F.coalesce("p.error", F.lit("")).alias("error"),
        )
    )


@query(
    """SELECT conv_id, turn, role <> 'assistant' OR conv_id = 7 AS mentioned,
  CASE WHEN role = 'user' AND turn % 2 = 0 THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') ELSE '' END AS search
  FROM conversations"""
)
def search_mention(spark, d):
    said = F.expr(
        "case role when 'user' then concat(' @Helper ', if(turn % 2 = 0, 'Поиск ', 'look '), text) "
        "when 'system' then concat(' @HELPER', text) else text end"
    )
    entity = F.expr(
        "array(named_struct('type', if(role = 'assistant', 'text_mention', 'mention'), 'offset', 1L, 'length', 7L, "
        "'user_id', if(role = 'assistant', conv_id, cast(null as bigint))))"
    )
    rows = b.table(spark, d, "conversations").select("conv_id", "turn", said.alias("said"), entity.alias("e"))
    rows = rows.withColumn("mentioned", tx.has_mention(F.col("said"), F.col("e"), "helper", 7))
    found = tx.search_mention(F.col("said"), F.col("mentioned"), "helper")
    return rows.select("conv_id", "turn", "mentioned", F.coalesce(found, F.lit("")).alias("search"))


def access_events(spark, d):
    """Events with the flags the gate needs, admins and allow-list joined in."""
    e = b.table(spark, d, "events").select(
        "event_id", "user_id", (F.col("user_id") % 10).alias("chat_id"), "ts",
        (F.col("event_type") == "signup").alias("is_private"),
        F.col("event_type").isin("click", "error").alias("is_command"),
        F.expr("case when event_type = 'error' then '/set_admin x' when event_type = 'click' then '/help' end").alias("command"),
    )
    source = b.table(spark, d, "events")
    admins = source.groupBy("user_id").agg(F.max("value").alias("m")).filter("m > 250").select("user_id", F.lit(True).alias("admin"))
    allowed = (
        source.groupBy((F.col("user_id") % 10).alias("chat_id")).agg(F.sum(F.col("event_id") % 97).alias("s")).filter("s % 2 = 0")
        .select("chat_id", F.lit(True).alias("listed"))
    )
    return (
        e.join(admins, "user_id", "left").join(allowed, "chat_id", "left")
        .withColumn("admin", F.coalesce("admin", F.lit(False)))
        .withColumn("listed", F.coalesce("listed", F.lit(False)))
    )


ACCESS_SQL = """admins AS (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 250),
allowed AS (SELECT user_id % 10 AS chat_id FROM events GROUP BY 1 HAVING sum(event_id % 97) % 2 = 0),
gate AS (
  SELECT event_id, user_id, user_id % 10 AS chat_id, ts, event_type,
    CASE WHEN event_type = 'error' THEN '' WHEN user_id IN (SELECT user_id FROM admins) THEN ''
         WHEN event_type = 'signup' THEN 'private_non_admin'
         WHEN event_type = 'click' THEN '' WHEN user_id % 10 IN (SELECT chat_id FROM allowed) THEN ''
         ELSE 'chat_not_whitelisted' END AS reason
  FROM events)"""


@query(b.sql("SELECT event_id, reason = '' AS allowed, reason FROM gate", extra=ACCESS_SQL))
def access_decision(spark, d):
    decision = tx.access_decision(
        F.col("is_private"), F.col("is_command"), F.col("command"), F.col("admin"), F.col("listed")
    )
    return access_events(spark, d).select("event_id", decision.alias("x")).select(
        "event_id", F.col("x.allowed").alias("allowed"), F.coalesce("x.reason", F.lit("")).alias("reason")
    )


def title_responses(spark, d):
    """A generated response per document; its shape depends on language and source."""
    one = F.expr(
        "to_json(named_struct('title', concat('About ', source), 'description', if(n_chars % 11 = 0, ' ', text)))"
    )
    return b.table(spark, d, "documents").select(
        F.col("doc_id").alias("topic_id"),
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Here:\n```json\n"), one, F.lit("\n```\nDone")))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("```\n"), one, F.lit("\n```")))
        .when(F.col("doc_id") % 6 == 2, one)
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("["), one, F.lit("]")))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("{\"title\": "), F.to_json(F.struct("source")), F.lit("}")))
        .otherwise(F.col("text"))
        .alias("response"),
        "lang",
    )


_TITLES = """titles AS (
  SELECT doc_id AS topic_id, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN CASE WHEN n_chars % 11 = 0 THEN 'empty_value' ELSE 'ok' END
     WHEN doc_id % 6 = 3 THEN 'not_an_object' WHEN doc_id % 6 = 4 THEN 'missing_key' ELSE 'invalid_json' END AS status,
     'About ' || source AS title, text AS description, lang FROM documents)"""


@query(
    b.sql(
        """SELECT topic_id, status, CASE status WHEN 'ok' THEN title ELSE '' END AS title,
  CASE status WHEN 'ok' THEN description ELSE '' END AS description FROM titles""",
        extra=_TITLES,
    )
)
def title_response(spark, d):
    return title_responses(spark, d).select("topic_id", tx.parse_title_response(F.col("response")).alias("r")).select(
        "topic_id", F.col("r.status").alias("status"), F.coalesce("r.title", F.lit("")).alias("title"),
        F.coalesce("r.description", F.lit("")).alias("description"),
    )


@query(
    b.sql(
        """SELECT topic_id, CASE WHEN lang = 'de' THEN 'kept' WHEN status = 'ok' THEN title ELSE 'unknown' END AS title,
  CASE WHEN lang = 'de' THEN 'old' WHEN status = 'ok' THEN description ELSE 'Failed to generate description after retries.' END AS descr
  FROM titles""",
        extra=_TITLES,
    )
)
def apply_titles(spark, d):
    from ..operators.topics import apply_titles as op

    responses = title_responses(spark, d)
    topics = responses.select("topic_id", F.lit("kept").alias("title"), F.lit("old").alias("descr"))
    return op(topics, responses.filter("lang <> 'de'"))


@query(
    """SELECT doc_id, trim(lower(t)) IN ('', 'unknown') OR starts_with(t, 'Topic L1-') AS l1_unnamed,
  trim(lower(t)) IN ('', 'unknown') AS l2_unnamed,
  NOT (lower(t) IN ('', 'unknown') OR starts_with(t, 'Topic L1-')) AS l1_named
FROM (SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN ' Unknown ' WHEN 1 THEN '' WHEN 2 THEN 'Topic L1-' || doc_id ELSE source || ' ' || text END AS t FROM documents)"""
)
def needs_name(spark, d):
    t = F.expr("case n_chars % 5 when 0 then ' Unknown ' when 1 then '' when 2 then concat('Topic L1-', doc_id) else concat(source, ' ', text) end")
    rows = b.table(spark, d, "documents").select("doc_id", t.alias("t"))
    return rows.select(
        "doc_id",
        tx.needs_name(F.col("t"), "l1").alias("l1_unnamed"),
        tx.needs_name(F.col("t"), "l2").alias("l2_unnamed"),
        tx.is_named(F.col("t"), "l1").alias("l1_named"),
    )


@query(
    """SELECT doc_id, replace(substr(text, 1, 200), chr(10), ' ') || '...' AS preview, substr(source || ' ' || text, 1, 38) AS title FROM documents"""
)
def text_preview(spark, d):
    return b.table(spark, d, "documents").select(
        "doc_id", tx.preview(F.col("text")).alias("preview"), tx.short_title(F.concat_ws(" ", "source", "text")).alias("title")
    )


@query(
    """SELECT doc_id, p AS percentage, CASE WHEN p > 80 THEN 'high' WHEN p > 50 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT doc_id, round(CAST(length(text) // 4 AS DOUBLE) / 1000.0 * 100, 2) AS p FROM documents)"""
)
def usage_band(spark, d):
    p = tx.usage_percentage(tx.token_count(F.col("text")), 1000)
    return b.table(spark, d, "documents").select("doc_id", p.alias("percentage"), tx.usage_band(p).alias("band"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_get(spark, d):
    return b.table(spark, d, "events").select("event_id", tx.meta_get(F.col("props"), "k").cast("long").alias("k"))


@query(
    """SELECT vec_id, round(cos, 6) + 0.0 AS cosine, round(sq, 6) + 0.0 AS sq_l2, round(n, 6) AS norm,
  round(CASE WHEN sq <= 1 THEN 1 - sq WHEN sq <= 2 THEN 1 - sq / 2 ELSE greatest(0.0, 1 - sq) END, 6) + 0.0 AS score,
  round(CASE WHEN sq <= 1 THEN 1 - sq ELSE 0.0 END, 6) + 0.0 AS score_hydrated, round(1 - cos, 6) + 0.0 AS distance
FROM (SELECT a.vec_id, array_cosine_similarity(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64])) AS cos,
        array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64])) ** 2 AS sq,
        sqrt(array_inner_product(CAST(a.embedding AS DOUBLE[64]), CAST(a.embedding AS DOUBLE[64]))) AS n
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
)
def vector_pairs(spark, d):
    e = b.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = e.join(nxt, "vec_id").select(
        "vec_id", vx.cosine(F.col("embedding"), F.col("other")).alias("c"), vx.sq_l2(F.col("embedding"), F.col("other")).alias("s"),
        vx.norm(F.col("embedding")).alias("n"),
    )
    return rows.select(
        "vec_id", vx.rounded(F.col("c")).alias("cosine"), vx.rounded(F.col("s")).alias("sq_l2"), vx.rounded(F.col("n")).alias("norm"),
        vx.rounded(vx.score(F.col("s"))).alias("score"), vx.rounded(vx.score_hydrated(F.col("s"))).alias("score_hydrated"),
        vx.rounded(vx.effective_distance(F.lit(None).cast("double"), F.col("c"))).alias("distance"),
    )
