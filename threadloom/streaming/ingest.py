"""Continuous ingest of dump files into the messages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hydrate import insert_new
from ..schemas import MESSAGES
from ..sources.dumps import to_messages

_LINE = "id string, date string, sender string, content string"


def read_dump_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New dump files (JSON lines or one array a file) as messages."""
    raw = (
        spark.readStream.schema(_LINE)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    rows = raw.select(
        "id",
        F.col("date").cast("timestamp_ntz").alias("ts"),
        F.coalesce("sender", F.lit("Unknown")).alias("sender"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"),
    )
    return to_messages(rows)


def read_written_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New files of what ``write_dump`` or ``write_dump_packed`` writes, as messages."""
    raw = spark.readStream.schema(_LINE + ", dump string").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return to_messages(
        raw.select(
            "id", F.col("date").cast("timestamp_ntz").alias("ts"), F.coalesce("sender", F.lit("Unknown")).alias("sender"),
            F.coalesce("content", F.lit("")).alias("content"), F.col("dump").alias("file_name"),
        )
    )


def append_new(table: str):
    """A ``foreachBatch`` sink that inserts what the table does not hold yet.

    Each batch writes its own folder, so a repeated batch overwrites itself. Repeats are found in
    the batch and in the table, never by event time: archives arrive in any order, and an old
    message is as new to the table as a recent one. The stream keeps no state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _read(spark, table).filter(F.col("batch") != batch_id)
        fresh = insert_new(stored.select("msg_id"), batch)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def _read(spark: SparkSession, table: str) -> DataFrame:
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*MESSAGES.fields]).add("batch", LongType())
    try:
        return spark.read.schema(schema).parquet(table)
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def start(messages: DataFrame, table: str, checkpoint: str):
    """Insert a stream of messages; the query stops when what is present now is done."""
    return messages.writeStream.foreachBatch(append_new(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, files_per_trigger: int = 1):
    """Start the ingest of dump files."""
    return start(read_dump_stream(spark, source, files_per_trigger), table, checkpoint)
