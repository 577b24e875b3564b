"""A small list of what counts in a folder, replaced whole."""

from __future__ import annotations

from pyspark.sql import SparkSession

KEPT = 4


class Manifest:
    """Rows of ``fields`` (SQL types) below ``path``, written in one of ``KEPT`` folders in turn; the newest whole one is
    read, so a write that is lost half way changes nothing."""

    def __init__(self, spark: SparkSession, path: str, fields: str):
        self.spark, self.path = spark, path
        self.names = [f.strip().split(" ")[0] for f in fields.split(",")]
        self.schema = f"version long, rows long, {fields}"

    def _slot(self, slot: int) -> list:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/{slot}").collect()
        except Exception as e:  # never written, or being written now
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _newest(self) -> list:
        best: list = []
        for rows in map(self._slot, range(KEPT)):
            if rows and len(rows) == rows[0]["rows"] and (not best or rows[0]["version"] > best[0]["version"]):
                best = rows
        return best

    @property
    def version(self) -> int:
        rows = self._newest()
        return rows[0]["version"] if rows else 0

    def read(self) -> list[dict]:
        return [{n: r[n] for n in self.names} for r in self._newest() if r[self.names[0]] is not None]

    def publish(self, rows: list[dict]) -> int:
        version = self.version + 1
        out = [(version, max(len(rows), 1), *(r[n] for n in self.names)) for r in rows] or [(version, 1, *(None for _ in self.names))]
        self.spark.createDataFrame(out, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{version % KEPT}")
        return version
