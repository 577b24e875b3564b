"""Search-index tables: building, scanning and guarding them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

_EMPTY = "map<string,string>"


def _metadata_map(text: str):
    return F.coalesce(F.from_json(text, _EMPTY), F.create_map().cast(_EMPTY))


def build_chunk_index(chunks: DataFrame) -> DataFrame:
    """Index rows of all chunks that have a vector, topic ids added to their metadata."""
    topics = F.map_filter(
        F.create_map(
            F.lit("topic_l1_id"), F.col("topic_l1_id").cast("string"), F.lit("topic_l2_id"), F.col("topic_l2_id").cast("string")
        ),
        lambda k, v: v.isNotNull(),
    )
    own = F.map_filter(_metadata_map("metadata"), lambda k, v: ~k.isin("topic_l1_id", "topic_l2_id"))
    return chunks.filter(F.col("embedding").isNotNull()).select(
        F.col("chunk_id").alias("id"),
        F.col("text").alias("document"),
        F.map_concat(own, topics).alias("metadata"),
        F.col("embedding").alias("vector"),
        F.col("topic_l2_id"),
    )


def build_topic_index(topics: DataFrame, level: str) -> DataFrame:
    """Index rows of topic centroids, ids ``l1-<n>`` or ``l2-<n>``."""
    title = F.when(F.coalesce("title", F.lit("")) == "", F.lit(fixed.UNNAMED_TITLE)).otherwise(F.col("title"))
    pairs = [F.lit(f"topic_{level}_id"), F.col("topic_id").cast("string"), F.lit("title"), title, F.lit("chunk_count"), F.col("chunk_count").cast("string")]
    if level == "l1":
        pairs += [F.lit("msg_count"), F.col("msg_count").cast("string")]
    return topics.filter(F.col("center_vec").isNotNull()).select(
        F.concat(F.lit(f"{level}-"), F.col("topic_id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("document"),
        F.create_map(*pairs).alias("metadata"),
        F.col("center_vec").cast("array<float>").alias("vector"),
    )


def write_index(index: DataFrame, path: str) -> None:
    """Rebuild the stored index.  Chunk indexes are laid out by super-topic, so a search
    limited to some of them reads only their files."""
    writer = index.write.mode("overwrite")
    if "topic_l2_id" in index.columns:
        writer = writer.partitionBy("topic_l2_id")
    writer.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_index(index: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All vectors, or those of the given ``id`` rows."""
    rows = index.select("id", "vector")
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def clear(index: DataFrame) -> DataFrame:
    return index.limit(0)


def check_dim(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: the dimensions met on both sides and whether the index must be rebuilt."""
    def dims(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.lit(side).alias("side"), F.size("vector").alias("d"))

    def of(side: str, f):
        return f(F.when(F.col("side") == side, F.col("d")))

    both = dims(index, "index").unionByName(dims(incoming, "incoming"))
    row = both.agg(
        of("index", F.min).alias("index_min"),
        of("index", F.max).alias("index_max"),
        of("incoming", F.min).alias("incoming_min"),
        of("incoming", F.max).alias("incoming_max"),
    )
    differs = (F.col("index_min") != F.col("incoming_min")) | (F.col("index_max") != F.col("incoming_max"))
    return row.withColumn("rebuild", F.coalesce(differs, F.lit(False)))


def sync_index(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The index after a sync: same-dimension rows are replaced by id, a new dimension
    replaces the whole index."""
    if stored is None or check_dim(stored, incoming).first()["rebuild"]:
        return incoming
    kept = stored.join(incoming.select("id"), "id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)
