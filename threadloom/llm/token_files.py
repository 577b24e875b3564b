"""Token counts of documents in flat token files, found by scanning for separators.

A token file holds little-endian 16-bit ids and nothing else; an end-of-document id closes each
document. The scan deals blocks of the files to tasks; a block is searched for separators at once and
reports the distances between them, its first and last one. A prefix scan over the blocks of a
file (the last separator before a block, and the number of separators before it) stitches the
documents that cross block boundaries and numbers all of them. A document may span many blocks.

Defined results: null text is the empty text, which has 0 tokens; repeated rows are documents of
their own; ids after the last separator of a file are a document too, unless there are none.
Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import cut

from .blocks import blocks
from .bpe import read_ranks
from .shared_files import Reader, Writer

BLOCK_IDS = 2_000_000
FILE_BYTES = 128_000_000


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, pattern: str, separator: int) -> DataFrame:
    """Writes the texts of ``docs(doc_id, text)`` as token files; returns ``file, number, doc_id, bytes``, stored: the
    document's place in its file, and the bytes written to the file so far."""

    def task(batches):
        import numpy as np
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        out, name, number = Writer(folder, ".u16", FILE_BYTES), None, 0
        for part in blocks(batches, "text"):
            files, numbers, ends = [], [], []
            for text in part["text"].to_pylist():
                data = np.array([*encode(text or ""), separator], "<u2").tobytes()
                file, at = out.add(data)
                if file != name:
                    name, number = file, 0
                files.append(file)
                numbers.append(number)
                ends.append(at + len(data))
                number += 1
            yield pa.RecordBatch.from_pydict({"file": files, "number": pa.array(numbers, pa.int64()), "doc_id": part["doc_id"], "bytes": pa.array(ends, pa.int64())})
        out.close()

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return cut(rows.mapInArrow(task, "file string, number long, doc_id long, bytes long"))


def scan_token_files(spark: SparkSession, files: DataFrame, folder: str, separator: int, block: int = BLOCK_IDS) -> DataFrame:
    """``file, number, n_tokens`` of every document in ``files(file, bytes)``."""

    def task(batches):
        import numpy as np

        reader = Reader(folder)
        for batch in batches:
            for file, at, size in zip(*(batch[c].to_pylist() for c in ("file", "at", "size")), strict=True):
                ids = np.frombuffer(reader.read(file, 2 * at, 2 * size), "<u2")
                place = np.flatnonzero(ids == separator) + at
                n = len(place)
                yield pa.RecordBatch.from_pydict({
                    "file": [file], "at": pa.array([at], pa.int64()), "n": pa.array([n], pa.int64()),
                    "first": pa.array([int(place[0]) if n else None], pa.int64()), "last": pa.array([int(place[-1]) if n else None], pa.int64()),
                    "inner": pa.array([np.diff(place) - 1], pa.list_(pa.int64())),
                })

    ids = files.select("file", F.expr("bytes DIV 2").alias("ids")).where("ids > 0")
    parts = ids.select("file", "ids", F.explode(F.expr(f"sequence(0L, (ids - 1) DIV {block})")).alias("b"))
    parts = parts.select("file", F.expr(f"b * {block}").alias("at"), F.expr(f"least(ids - b * {block}, {block})").alias("size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(parts.repartition(n, "file", "at").mapInArrow(task, "file string, at long, n long, first long, last long, inner array<long>"))
    # a file has FILE_BYTES / 2 / block rows here
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumn("since", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1).cast("long")))
    stitched = stitched.withColumn("number", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    counts = F.concat(F.array(F.expr("first - since - 1")), "inner")
    whole = stitched.where("n > 0").select("file", F.col("number").alias("base"), F.posexplode(counts).alias("k", "n_tokens"))
    whole = whole.select("file", (F.col("base") + F.col("k")).alias("number"), "n_tokens")
    rest = found.groupBy("file").agg(F.max("last").alias("last"), F.sum("n").alias("number")).join(ids, "file")
    rest = rest.select("file", "number", F.expr("ids - coalesce(last, -1L) - 1").alias("n_tokens")).where("n_tokens > 0")
    return whole.union(rest)


def token_counts(docs: DataFrame, folder: str, ranks_path: str, pattern: str, separator: int) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs``: written as token files, then counted by the scan."""
    written = write_token_files(docs, folder, ranks_path, pattern, separator)
    files = cut(written.groupBy("file").agg(F.max("bytes").alias("bytes")))
    found = scan_token_files(docs.sparkSession, files, folder, separator)
    return written.join(cut(found), ["file", "number"]).select("doc_id", "n_tokens")
