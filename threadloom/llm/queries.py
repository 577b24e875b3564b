"""Named queries of the numbered operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_products import top_products

    return top_products(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


ORACLES["op7_minhash"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
        ELSE list_distinct([w[i:i+4] for i in range(1, len(w) - 3)]) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) ON u = doc_id
"""

ORACLES["op8_near_vectors"] = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
    AND len([c for c in embedding if c <> 0]) > 0),
links AS MATERIALIZED (
    SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u), least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.u = vec_id LEFT JOIN least_of ON least_of.u = vec_id
"""

ORACLES["op9_top_products"] = """
WITH vectors AS (
    SELECT vec_id, [floor(1024 * c::DOUBLE) for c in embedding] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
        FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0))
WHERE rank <= 10
"""


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify
    from .text_bytes import held_out

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{held_out(5, 0)} AS held_out", "text", "lang")
    found = identify(docs.drop("lang"), fit(docs.where("NOT held_out")), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .text_bytes import held_out
    from .toxicity import FIT_ROWS, fit, labelled_rows, score

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{held_out(3, 1)} AS held_out", "text")
    labels = table(spark, sf_dir, "labels").where(f"NOT {held_out(3, 1)}")
    model = fit(docs, labelled_rows(docs, labels, "toxic", FIT_ROWS))
    found = score(docs, model, ["doc_id", "held_out"])
    return found.withColumn("predicted", (found["score"] >= 0.7).cast("int"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import FIT_ROWS, fit, labelled_rows, score
    from .text_bytes import held_out

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{held_out(5, 0)} AS held_out", "text")
    labels = table(spark, sf_dir, "labels").where(f"NOT {held_out(5, 0)}")
    found = score(docs, fit(labelled_rows(docs, labels, "quality", FIT_ROWS)), ["doc_id", "held_out"])
    return found.withColumn("predicted", (found["score"] >= 0.3).cast("int"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .blocks import shared_folder
    from .warc import build_index, capture_key, look_up, write_archives

    pages, folder = table(spark, sf_dir, "pages"), shared_folder(spark, "warc")
    shards = build_index(write_archives(pages, folder), folder)
    asked = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return look_up(asked, shards, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .blocks import shared_folder
    from .token_files import token_counts

    # 50256 is no id of the vocabulary
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_counts(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), path, public_tokenizers.PATTERN, 50256)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import copies, fit_domains, rates
    from .text_bytes import held_out

    docs = table(spark, sf_dir, "documents")
    model = fit_domains(docs.where(f"NOT {held_out(5, 0)}").select("text", F.col("lang").alias("domain")))
    found = rates(docs, model, keep=["doc_id", "source"])
    return found.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), a, b).documents


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")


ORACLES["op13_hard_negatives"] = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) for c in embedding] AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
    FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
