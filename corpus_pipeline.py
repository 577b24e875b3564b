"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote.

Every stage but the last returns the columns of its input. ``ORACLE_SQL`` is None: models, sketches
and encodings are not SQL; the tests hold each stage against a plain version.

Null, empty and blank texts and those without a letter leave with the language stage; an empty table stays empty
in every stage. Texts are never cut: a very long one, or one unbroken run of letters, is a block of its own in each stage
and takes memory in proportion to its length; only the encoding takes more than proportional time on such a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import bpe, language, minhash, mixing, toxicity
from threadloom.llm.blocks import shared_folder
from threadloom.llm.text_bytes import held_out

TOXIC = 0.7
CACHED, BLOCK = 150_000, 1_000_000


def _packed(docs: DataFrame) -> DataFrame:
    """``text`` and all other columns in ``row``, so that a stage's own columns cannot clash with them."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")


def _unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select("row.*", "text").select(*like.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter and ambiguous ones go."""
    model = language.fit(docs.where(f"NOT {held_out(5, 0)}"))
    found = language.identify(_packed(docs), model, ["row", "text"])
    return _unpacked(found.where("lang_pred <> 'und' AND NOT ambiguous"), docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"NOT {held_out(3, 1)}")
    model = toxicity.fit(docs, toxicity.labelled_rows(docs, labels, "toxic", toxicity.FIT_ROWS))
    found = toxicity.score(_packed(docs), model, ["row", "text"])
    return _unpacked(found.where(F.col("score") < TOXIC), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id; of rows that repeat
    an id the one of the least text. Rows without id stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text")).where("doc_id IS NOT NULL")
    of_id = minhash.cut(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    apart = of_id.where("NOT kept OR n > 1").select("doc_id")
    out = docs.join(apart, "doc_id", "left_anti")
    again = of_id.where("kept AND n > 1").select("doc_id")
    if not again.isEmpty():
        order = Window.partitionBy("row.doc_id").orderBy("text", F.xxhash64("row"))
        rows = _packed(docs.join(again, "doc_id", "left_semi")).withColumn("place", F.row_number().over(order))
        out = out.select(*docs.columns).union(_unpacked(rows.where("place = 1"), docs))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by rate, so that languages come near tempered shares of the tokens; no rate
    is below 1, so none is lost."""
    model = mixing.fit_domains(docs.where(f"NOT {held_out(5, 0)}").select("text", F.col("lang").alias("domain")))
    packed = _packed(docs)
    found = mixing.rates(packed, model, keep=["row", "text"], least=1.0)
    taken = F.greatest(mixing.copies(F.col("rate"), F.coalesce("row.doc_id", F.xxhash64("text"))), F.lit(0).cast("long"))
    rows = found.select("row", "text", F.explode(F.sequence(F.lit(0).cast("long"), taken)).alias("at")).where("at > 0")
    return _unpacked(rows, docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and hashes of them and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # executors that ran the other stages have less room than those that only encode
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, cached=CACHED, block=BLOCK)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = shared_folder(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
