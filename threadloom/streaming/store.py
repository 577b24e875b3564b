"""A table of messages in runs, each with a Bloom filter of its ids, so that a batch reads few of them.

Every batch adds a run, a folder of rows. What a batch brings is looked up in the runs' Bloom filters first;
only runs that may hold one of its ids are read, and only their id columns. When ``FAN`` runs of a level
are there, they become one run of the next level, so a table of n batches has about ``FAN`` x log n runs and a row is
written log n times. A filter is ``BITS`` bits an id in pieces of 32768 bits, built by mergeable
aggregates and asked by a join on the pieces that an id points to: no filter is held whole anywhere.

A manifest names the runs that count and is written last: a batch that is lost half way, or comes again, changes nothing. Merged runs stay where they are, unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGES
from ..sources.manifest import Manifest

FAN = 8
BITS, HASHES = 10, 7
PIECE = 32768


def positions(ids: DataFrame, bits) -> DataFrame:
    """``ids`` with ``at``, one row for each of the ``HASHES`` bits of ``msg_id`` in a filter of ``bits`` bits."""
    h1, h2 = F.xxhash64("msg_id"), F.xxhash64("msg_id", F.lit("second")).bitwiseOR(F.lit(1))
    steps = F.sequence(F.lit(0), F.lit(HASHES - 1))
    # sums of remainders, so that nothing overflows
    spot = F.transform(steps, lambda i: F.pmod(F.pmod(h1, bits) + i * F.pmod(h2, bits), bits))
    return ids.withColumn("at", F.explode(spot))


class MessageStore:
    """The messages below ``path``; ``schema`` has a column ``msg_id``."""

    def __init__(self, spark: SparkSession, path: str, schema=MESSAGES):
        self.spark, self.path, self.schema = spark, path, schema
        self.manifest = Manifest(spark, f"{path}/manifest", "run string, level int, n long, bits long")

    def runs(self) -> list[dict]:
        """The runs that count: about FAN x log(batches) rows."""
        return self.manifest.read()

    # --- reading -------------------------------------------------------------------

    def _rows(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/runs/{r['run']}" for r in runs))

    def read(self) -> DataFrame:
        return self._rows(self.runs())

    def suspects(self, ids: DataFrame) -> list[dict]:
        """The runs that may hold one of ``ids(msg_id)``."""
        runs = [r for r in self.runs() if r["n"]]
        if not runs:
            return []
        known = F.array(*(F.struct(F.lit(r["run"]).alias("run"), F.lit(r["bits"]).alias("bits")) for r in runs))  # FAN x log of them
        asked = positions(ids.select("msg_id").distinct().select("msg_id", F.inline(known)), F.col("bits"))
        asked = asked.withColumn("piece", F.expr(f"at DIV {PIECE}")).withColumn("spot", F.expr(f"at % {PIECE}"))
        filters = self.spark.read.parquet(*(f"{self.path}/filters/{r['run']}" for r in runs))
        byte = F.conv(F.hex(F.substring(F.col("word"), F.expr("int(spot DIV 8 + 1)"), F.lit(1))), 16, 10).cast("int")
        found = asked.join(filters, ["run", "piece"]).withColumn("byte", byte)
        found = found.where("(shiftright(byte, int(spot % 8)) & 1) = 1").groupBy("run", "msg_id").agg(F.count("*").alias("k"))
        names = {r["run"] for r in found.where(F.col("k") == HASHES).select("run").distinct().collect()}  # a subset of the runs
        return [r for r in runs if r["run"] in names]

    # --- writing -------------------------------------------------------------------

    def _add_run(self, rows: DataFrame, run: str, level: int) -> dict:
        rows.select(*(f.name for f in self.schema.fields)).write.mode("overwrite").parquet(f"{self.path}/runs/{run}")
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/runs/{run}").select("msg_id")
        n = stored.count()
        bits = max(PIECE, BITS * n)
        spots = positions(stored, F.lit(bits)).selectExpr(f"at DIV {PIECE} AS piece", f"at % {PIECE} AS spot")
        # bitmap_bit_position counts from 1
        words = spots.groupBy("piece").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot + 1))").alias("word"))
        words.select(F.lit(run).alias("run"), "piece", "word").write.mode("overwrite").parquet(f"{self.path}/filters/{run}")
        return {"run": run, "level": level, "n": n, "bits": bits}

    def insert(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Adds the rows of ``batch`` whose ids are new, one of each; gives them back."""
        from ..operators.hydrate import insert_new

        run = f"batch-{batch_id}"
        runs = [r for r in self.runs() if r["run"] != run]
        stored = self._rows([r for r in self.suspects(batch) if r["run"] != run]).select("msg_id")
        added = self._add_run(insert_new(stored, batch), run, 0)
        self.manifest.publish([*runs, added] if added["n"] else runs)
        self.compact(batch_id)
        return self._rows([added])

    def compact(self, batch_id: int) -> None:
        """Merges the runs of a level where ``FAN`` are there."""
        runs, level = self.runs(), 0
        while any(r["level"] >= level for r in runs):
            mine = [r for r in runs if r["level"] == level]
            if len(mine) >= FAN:
                rows = self._rows(mine)
                parts = max(1, -(-sum(r["n"] for r in mine) // 1_000_000))
                merged = self._add_run(rows.coalesce(parts), f"level-{level + 1}-{batch_id}", level + 1)
                runs = [*(r for r in runs if r["level"] != level), merged]
                self.manifest.publish(runs)
            level += 1

    def sink(self):
        """A ``foreachBatch`` sink."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.insert(batch, batch_id)

        return write
