"""A table by key as bucket folders and a manifest: changes rewrite the buckets they touch.

A key's bucket is a hash of it; a bucket's rows are stored sorted by key, in one or more files with Parquet's own
minima, maxima and Bloom filters of the key. ``apply`` reads and rewrites the buckets that hold a key of the delta and
then replaces the manifest, which names the generation of every bucket: files of other buckets keep their
names, readers see the state before or after, and a change that is lost half way is not seen at all.
``lookup`` opens the buckets of the asked keys only, and in them the row groups that may hold one.

Null keys are stored in a bucket of their own and never match. Generations that are no longer named stay, unread.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.manifest import Manifest
from .mutate import apply_delta

#: Keys that are named to the source one by one.
NAMED_KEYS = 1000


class BucketTable:
    """The table at a path; its manifest holds schema, key and number of buckets too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = Manifest(spark, f"{path}/manifest", "bucket long, generation long, key string, buckets long, schema string")
        rows = self.manifest.read()
        if not rows:
            raise FileNotFoundError(path)
        self.key, self.buckets = rows[0]["key"], rows[0]["buckets"]
        self.schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
        self.generations = {r["bucket"]: r["generation"] for r in rows}

    @staticmethod
    def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> BucketTable:
        """Stores ``df`` anew; take a bucket for each million rows or so."""
        rows = [{"bucket": b, "generation": 0, "key": key, "buckets": buckets, "schema": df.schema.json()} for b in range(-1, buckets)]
        _write(df, _bucket(F.col(key), buckets), key, f"{path}/rows/generation=0")
        Manifest(df.sparkSession, f"{path}/manifest", "bucket long, generation long, key string, buckets long, schema string").publish(rows)
        return BucketTable(df.sparkSession, path)

    def _stored(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows of some buckets; the filter is one on folders."""
        wanted: dict[int, list[int]] = {}
        for bucket, generation in self.generations.items():
            if buckets is None or bucket in buckets:
                wanted.setdefault(generation, []).append(bucket)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("generation", T.LongType()), T.StructField("_bucket", T.LongType())]))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        some = F.lit(False)
        for generation, mine in wanted.items():
            some = some | ((F.col("generation") == generation) & F.col("_bucket").isin(mine))
        return rows.parquet(f"{self.path}/rows").where(some).select(*self.schema.names)

    def read(self) -> DataFrame:
        return self._stored()

    def _touched(self, keys: DataFrame) -> set[int]:
        bucket = _bucket(F.col(self.key), self.buckets)
        return {r["b"] for r in keys.where(F.col(self.key).isNotNull()).select(bucket.alias("b")).distinct().collect()}  # at most one for each bucket

    def apply(self, delta: DataFrame, keep_null: bool = False) -> BucketTable:
        """The columns of ``delta`` overwritten where its key matches, as ``mutate.apply_delta`` does."""
        touched = self._touched(delta)
        if touched:
            generation = max(self.generations.values()) + 1
            changed = apply_delta(self._stored(touched), delta, self.key, keep_null)
            _write(changed, _bucket(F.col(self.key), self.buckets), self.key, f"{self.path}/rows/generation={generation}")
            now = {**self.generations, **dict.fromkeys(touched, generation)}
            self.manifest.publish([{"bucket": b, "generation": g, "key": self.key, "buckets": self.buckets, "schema": self.schema.json()} for b, g in now.items()])
        return BucketTable(self.spark, self.path)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of a table of keys."""
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        rows = self._stored(self._touched(asked))
        few = [r[0] for r in asked.limit(NAMED_KEYS + 1).collect()]
        if len(few) <= NAMED_KEYS:  # reaches the files' statistics and Bloom filters
            return rows.where(F.col(self.key).isin(few))
        return rows.join(asked, self.key, "left_semi")


def _bucket(key: Column, buckets: int) -> Column:
    return F.when(key.isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("long")


def _write(df: DataFrame, bucket: Column, key: str, path: str) -> None:
    rows = df.withColumn("_bucket", bucket).repartitionByRange("_bucket", key).sortWithinPartitions("_bucket", key)
    rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("_bucket").parquet(path)
