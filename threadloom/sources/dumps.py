"""Readers and writers of message dumps and vector files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import compose_id, strip
from ..schemas import VECTOR_FILE
from . import arrays

#: Messages in a file of many chats, at most.
FILE_ROWS = 4096


def chat_id_of(file_name: Column) -> Column:
    found = F.regexp_extract(file_name, fixed.DUMP_NAME_PATTERN, 1)
    return F.when(found != "", found).otherwise(F.lit(fixed.UNKNOWN_CHAT))


def _name_in(path: Column, part: int) -> Column:
    return F.element_at(F.split(path, "/"), part)


def read_dump(spark: SparkSession, path: str, name_part: int = -1) -> DataFrame:
    """``id, ts, sender, content, file_name`` of JSON-array dumps, each file read by as many tasks as it has ranges.

    ``file_name`` is that part of the path which names the chat: the last one, or -2 where files lie in a folder of their chat.

    Files whose top level is not an array give no rows.  A key that is absent takes its
    default; a malformed date or file fails the read.
    """
    item = "id string, date string, sender string, content string, _bad string"
    options = {"primitivesAsString": "true", "columnNameOfCorruptRecord": "_bad"}
    rows = arrays.read_objects(spark, path).select("path", F.from_json("text", item, options).alias("x"))
    broken = F.raise_error(F.concat(F.lit("not a readable dump: "), F.col("path"))).cast("boolean")
    rows = rows.where(F.when(F.col("x._bad").isNull(), True).otherwise(broken))
    return rows.select(
        F.col("x.id").alias("id"),
        F.col("x.date").cast("timestamp_ntz").alias("ts"),
        F.coalesce("x.sender", F.lit(fixed.UNKNOWN_SENDER)).alias("sender"),
        F.coalesce("x.content", F.lit("")).alias("content"),
        _name_in(F.col("path"), name_part).alias("file_name"),
    )


def read_lines(spark: SparkSession, path: str, ts: str, name_part: int = -1) -> DataFrame:
    """One message per non-blank line; ids count all lines of a file from zero.

    A file is read in byte ranges by many tasks. Lines end at LF, CR or both, also where a range ends
    between the two. A first scan counts the lines of each range, a running sum over the ranges of a file
    gives the number of their first lines; within a range numbers follow from the order of its rows.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("seq"), "value"
    )
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.groupBy("path", "at").agg(F.count("*").alias("n"), F.min("seq").alias("low"))
    shift = counted.select("path", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    content = strip(F.col("value"))
    return (
        lines.withColumn("content", content)
        .filter(F.col("content") != "")
        .join(shift, ["path", "at"])
        .select(
            (F.col("seq") + F.col("shift")).cast("string").alias("id"),
            F.lit(ts).cast("timestamp_ntz").alias("ts"),
            F.lit(fixed.UNKNOWN_SENDER).alias("sender"),
            "content",
            _name_in(F.col("path"), name_part).alias("file_name"),
        )
    )


def to_messages(dump: DataFrame) -> DataFrame:
    """Dump rows in the shape of the messages table, with composite ids."""
    chat = chat_id_of(F.col("file_name"))
    return dump.select(
        compose_id(chat, F.col("id")).alias("msg_id"),
        chat.alias("chat_id"),
        "ts",
        F.col("sender").alias("from_id"),
        F.col("content").alias("text"),
    )


def normalise_export(export: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw export rows to dump rows: newest ``limit`` per chat, then empty texts dropped.

    Expects ``chat_id, id, date, text, first_name, last_name, title``.  The limit is a
    feature of the export (its newest messages); it is pre-limited before the shuffle.
    """
    rows = export
    if limit is not None:
        newest = Window.partitionBy("chat_id").orderBy(F.desc("date"), F.desc("id"))
        rows = rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    person = F.concat_ws(" ", given("first_name"), given("last_name"))
    sender = F.when(given("first_name").isNotNull(), person).otherwise(
        F.coalesce("title", F.lit(fixed.UNKNOWN_SENDER))
    )
    return rows.filter(F.coalesce("text", F.lit("")) != "").select(
        "chat_id", "id", "date", sender.alias("sender"), F.col("text").alias("content")
    )


def write_dump(dump: DataFrame, path: str) -> None:
    """Dump rows as JSON lines, one folder per chat; the chat id keeps its sign.

    A chat may fill several files, so its size is no limit.
    """
    named = dump.withColumn("dump", F.concat(F.lit(fixed.DUMP_NAME_PREFIX), F.col("chat_id").cast("string")))
    (
        named.repartitionByRange("dump", "date", "id")
        .sortWithinPartitions("dump", "date", "id")
        .drop("chat_id")
        .write.mode("overwrite")
        .partitionBy("dump")
        .json(path)
    )


def write_dump_packed(dump: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """Dump rows as JSON lines that name their chat in ``dump``, at most ``rows`` a file.

    Small chats share a file and a large one fills several, so the number of files follows the messages, not the chats.
    """
    named = dump.withColumn("dump", F.concat(F.lit(fixed.DUMP_NAME_PREFIX), F.col("chat_id").cast("string"))).drop("chat_id")
    keys = ["dump", "date", "id"]
    named.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def write_dump_arrays(dump: DataFrame, path: str) -> None:
    """Dump rows as JSON arrays, one or more files in a folder for each chat, every file one array."""
    named = dump.withColumn("dump", F.concat(F.lit(fixed.DUMP_NAME_PREFIX), F.col("chat_id").cast("string")))
    keys = ["dump", "date", "id"]
    sorted_rows = named.repartitionByRange(*keys).sortWithinPartitions(*keys)
    body = F.to_json(F.struct(*(c for c in dump.columns if c != "chat_id")))

    def frame(batches):
        """Puts brackets and commas around the rows of a chat, which follow each other in a task."""
        chat, held = None, None

        def row(text):
            return pa.RecordBatch.from_pydict({"dump": [chat], "value": [text]})

        for batch in batches:
            out = {"dump": [], "value": []}
            for name, text in zip(batch["dump"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if held is not None:
                    out["dump"].append(chat)
                    out["value"].append(held if name == chat else held + "]")
                held = ("," if name == chat else "[") + text
                chat = name
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("dump", pa.string()), ("value", pa.string())]))
        if held is not None:
            yield row(held + "]")

    framed = sorted_rows.select("dump", body.alias("value")).mapInArrow(frame, "dump string, value string")
    framed.write.mode("overwrite").partitionBy("dump").text(path)


def read_written_dump(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_dump`` or ``write_dump_packed`` wrote, in the shape ``to_messages`` takes."""
    rows = spark.read.schema("id string, date string, sender string, content string, dump string").json(path)
    return rows.select(
        "id", F.col("date").cast("timestamp_ntz").alias("ts"), F.coalesce("sender", F.lit(fixed.UNKNOWN_SENDER)).alias("sender"),
        F.coalesce("content", F.lit("")).alias("content"), F.col("dump").alias("file_name"),
    )


def write_vectors(df: DataFrame, path: str, id_col: str = "chunk_id", vec_col: str = "embedding") -> None:
    """``{id, embedding}`` lines; a row without a vector is an error."""
    missing = F.raise_error(F.concat(F.lit("no vector for id "), F.col(id_col).cast("string")))
    df.select(
        F.col(id_col).cast("string").alias("id"),
        F.when(F.col(vec_col).isNull(), missing.cast("array<double>")).otherwise(F.col(vec_col).cast("array<double>")).alias("embedding"),
    ).write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR_FILE).json(path).filter(F.col("id").isNotNull())
