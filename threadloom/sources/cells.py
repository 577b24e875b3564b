"""A stored index of vectors by cell and distance band, built once and asked for ever.

``path/pivots`` holds at most ``max_pivots`` vectors, ``path/vectors`` every vector in the cell of its nearest
pivot. A cell's vectors are sorted by their distance to the pivot and stored in blocks of about
``block_rows``, a folder each, so a block is a ring around its pivot: its least and greatest distance
are in ``path/manifest``, one row a block. By the triangle inequality no vector of a ring is nearer to
a query at distance d than ``max(d - greatest, least - d)``, and the rings' sizes bound the k-th nearest from
above; files of other rings are not opened. Nothing is written to answer queries.

``add`` stores more vectors around the same pivots as further blocks. What it wrote counts once its manifest
rows are there, so a batch that is lost half way leaves nothing behind that a search can see.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import nearest

#: Blocks whose rings are compared with a query one by one (1.6 billion vectors); of more, whole cells are.
MANIFEST_ROWS = 100_000
#: Blocks that a scan names to the source.
NAMED_BLOCKS = 10_000
_MANIFEST = "batch long, cell long, block long, n long, least double, greatest double"


class CellIndex:
    """The index at a path; ``metric`` is that of its pivots."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow()  # at most max_pivots rows
        facts = json.loads(row["facts"][0].as_py()) if row.num_rows else {"metric": "sq_l2", "block_rows": nearest.BLOCK_ROWS, "id": "string", "element": "float"}
        self.metric, self.block_rows = facts["metric"], facts["block_rows"]
        self.id_type, self.element = facts["id"], facts["element"]
        self.pivots = nearest.stack(row["pivot"])
        self.manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")

    # --- building ------------------------------------------------------------------

    @staticmethod
    def build(vectors: DataFrame, path: str, *, vector_id: str = "chunk_id", vector: str = "embedding", metric: str = "sq_l2", block_rows: int = nearest.BLOCK_ROWS, max_pivots: int = nearest.MAX_PIVOTS) -> CellIndex:
        """Stores ``vectors`` anew; rows without a vector are left out."""
        spark = vectors.sparkSession
        element = "float" if nearest._is_float(vectors, vector) else "double"
        s = vectors.select(F.col(vector_id).alias("vector_id"), F.col(vector).cast(f"array<{element}>").alias("vector")).where("vector IS NOT NULL")
        pivots = nearest._pivots(s, metric, max_pivots)
        facts = json.dumps({"metric": metric, "block_rows": block_rows, "id": s.schema["vector_id"].dataType.simpleString(), "element": element})
        rows = [(i, p.tolist(), facts) for i, p in enumerate(pivots)]
        spark.createDataFrame(rows, "cell long, pivot array<double>, facts string").write.mode("overwrite").parquet(f"{path}/pivots")
        spark.createDataFrame([], _MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
        index = CellIndex(spark, path)
        if len(pivots):
            index._write(s, 0)
        return CellIndex(spark, path)

    def add(self, vectors: DataFrame, *, vector_id: str = "chunk_id", vector: str = "embedding") -> CellIndex:
        """Stores more vectors, whose ids are new to the index; pivots and stored blocks stay as they are."""
        if not len(self.pivots):
            return CellIndex.build(vectors, self.path, vector_id=vector_id, vector=vector, metric=self.metric, block_rows=self.block_rows)
        s = vectors.select(F.col(vector_id).alias("vector_id"), F.col(vector).cast(f"array<{self.element}>").alias("vector")).where("vector IS NOT NULL")
        last = self.manifest.agg(F.max("batch")).first()[0]
        self._write(s, 0 if last is None else last + 1)
        return CellIndex(self.spark, self.path)

    def _write(self, s: DataFrame, batch: int) -> None:
        placed = s.withColumn("_p", nearest._nearest_pivot(self.pivots, nearest_metric(self.metric))("vector"))
        placed = placed.select("vector_id", "vector", F.col("_p.cell").cast("long").alias("cell"), F.col("_p.reach").alias("reach"))
        keys = ["cell", "reach", "vector_id"]
        ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        # rows of a task are numbered in this order: every block_rows of them begin another block
        row = F.monotonically_increasing_id()
        ordered = ordered.withColumn("row", row)
        block = F.expr(f"shiftright(row, 33) * {1 << 20} + (row & {(1 << 33) - 1}) DIV {self.block_rows}")
        folder = f"{self.path}/vectors/batch={batch}"
        ordered.select("vector_id", "vector", "reach", "cell", block.alias("block")).write.mode("overwrite").partitionBy("cell", "block").parquet(folder)
        rings = self._stored().where(F.col("batch") == batch).groupBy("batch", "cell", "block")
        rings = rings.agg(F.count("*").alias("n"), F.min("reach").alias("least"), F.max("reach").alias("greatest"))
        rings.write.mode("append").parquet(f"{self.path}/manifest")

    # --- reading -------------------------------------------------------------------

    def _stored(self) -> DataFrame:
        schema = f"vector_id {self.id_type}, vector array<{self.element}>, reach double, batch long, cell long, block long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def rows(self, ids: DataFrame | None = None) -> DataFrame:
        """All stored vectors, or those of the given ``vector_id`` rows."""
        if not len(self.pivots):
            return self.spark.createDataFrame([], f"vector_id {self.id_type}, vector array<{self.element}>")
        keys = ["batch", "cell", "block"]
        rows = self._stored().join(self.manifest.select(*keys), keys, "left_semi").select("vector_id", "vector")
        return rows if ids is None else rows.join(ids.select("vector_id").distinct(), "vector_id", "left_semi")

    def _rings(self) -> pd.DataFrame:
        """The rings a query is compared with; ``block`` is -1 for a whole cell of all batches."""
        rings = self.manifest
        if rings.count() > MANIFEST_ROWS:
            whole = rings.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
            rings = whole.select(F.lit(-1).cast("long").alias("batch"), "cell", F.lit(-1).cast("long").alias("block"), "n", "least", "greatest")
        return rings.orderBy("batch", "cell", "block").toPandas()

    def hits(self, q: DataFrame, few: pa.Table | None, k: int, metric: str) -> DataFrame:
        """``query_id, vector_id, distance`` of rows among which are the k nearest of every query of
        ``q(query_id, query_vec)``; ``few`` holds all queries where they are few."""
        if nearest_metric(metric) != nearest_metric(self.metric):
            raise ValueError(f"the index is laid out for {self.metric}")
        rings = self._rings() if len(self.pivots) else None
        s = self.rows()
        if rings is None or not len(rings):
            return self.spark.createDataFrame([], nearest._hit_schema(q, s))
        pick = ring_picker(self.pivots, rings, k, nearest_metric(metric))
        stored = self._stored()
        if few is not None:
            asked = nearest.prepare(nearest.stack(few["query_vec"]), metric)
            seen = np.zeros(len(rings), bool)
            for at in range(0, len(asked), 64):
                seen |= pick(asked[at : at + 64]).any(axis=0)
            return nearest._scan(few, q, self._named(stored, rings[seen]).select("vector_id", "vector"), k, metric, False)

        @F.pandas_udf("array<int>")
        def route(v: pd.Series) -> pd.Series:
            x = nearest.prepare(nearest.stack(v), metric)
            return pd.Series([np.flatnonzero(p).astype("int32") for at in range(0, len(x), 64) for p in pick(x[at : at + 64])])

        asked, wanted = nearest._grouped(q, self.pivots, nearest_metric(metric), route.func)
        names = self.spark.createDataFrame(rings.assign(ring=np.arange(len(rings)))[["batch", "cell", "block", "ring"]])
        if rings["block"].iloc[0] < 0:
            rows = self._stored().join(self.manifest.select("batch", "cell", "block"), ["batch", "cell", "block"], "left_semi")
            rows = rows.select("vector_id", "vector", "cell").join(names.select("cell", "ring"), "cell")
        else:
            rows = stored.join(names, ["batch", "cell", "block"])
        return nearest._sweep(asked, rows.select("vector_id", "vector", F.col("ring").alias("cell")), wanted, k, metric, self.block_rows)

    def _named(self, stored: DataFrame, rings: pd.DataFrame) -> DataFrame:
        """The rows of some rings: a filter on the folders, so that files of others are not opened."""
        if rings["block"].iloc[0] < 0 or len(rings) > NAMED_BLOCKS:
            keys = ["batch", "cell", "block"]
            stored = stored.join(self.manifest.select(*keys), keys, "left_semi")
            return stored.where(F.col("cell").isin([int(c) for c in rings["cell"].unique()]))
        some = None
        for batch, part in rings.groupby("batch"):
            names = F.col("block").isin([int(b) for b in part["block"].unique()]) & F.col("cell").isin([int(c) for c in part["cell"].unique()])
            one = (F.col("batch") == int(batch)) & names
            some = one if some is None else some | one
        return stored.where(some)


def nearest_metric(metric: str) -> str:
    """Metrics that share a layout."""
    return "sq_l2" if metric == "l2" else metric


def ring_picker(pivots: np.ndarray, rings: pd.DataFrame, k: int, metric: str):
    """A function from query vectors (prepared) to (query, ring) flags: rings that can hold one of the k nearest."""
    cell, n = rings["cell"].to_numpy(), rings["n"].to_numpy()
    least, greatest = rings["least"].to_numpy(), rings["greatest"].to_numpy()

    def pick(x: np.ndarray) -> np.ndarray:
        d = nearest._plain(nearest.fast_distances(x, pivots, metric), metric)[:, cell]
        most = d + greatest
        order = np.argsort(most, axis=1)
        enough = np.cumsum(n[order], axis=1) >= k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), most.shape[1] - 1)
        bound = np.take_along_axis(most, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
        bound = np.where(enough.any(axis=1), bound, np.inf)
        # slack covers the rounding of the tile arithmetic
        return np.maximum(d - greatest, least - d) <= (bound * (1 + 1e-6) + 1e-5)[:, None]

    return pick
