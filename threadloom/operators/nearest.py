"""Exact batch nearest-vector search.

One job answers a whole frame of queries.  Two plans, chosen by a counted size:

* *scan*: at most ``SCAN_QUERIES`` queries travel to the vectors; every task keeps one
  running top-k per query while it streams its vectors, so vectors are never shuffled.
* *cells*: beyond that queries are dealt to blocks of about ``QUERY_ROWS`` (of more, if k is small) that lie near each
  other around a bounded set of pivots, and the vectors of each cell go to the blocks that
  can need them, by the triangle inequality (the pivot-bound join of Lu et al., VLDB 2012).
  A task keeps one running top-k of its queries while its vectors stream by, so a vector is
  written once a block at most, not once a query, and a query returns k rows, whatever the
  number of cells. Where nothing can be left out, that is the number of blocks times the vectors.

Both return the true k nearest: distances are recomputed in double precision from the
vector difference and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

SCAN_QUERIES = 2048
MAX_PIVOTS = 512
PUSHED_CELLS = 1000
BLOCK_ROWS = 16384
QUERY_ROWS = 16384
#: A block of all cells has up to WIDE times the queries where it keeps no more rows than with k = WIDE_K.
WIDE, WIDE_K = 4, 50
#: Vectors in a row of a shuffle, and at most so many compared with a step of queries at once.
PACK_ROWS, TILE_ROWS = 128, 2048
STEP = 1024
NEAR_ROWS = 256
#: Pairs whose exact distances are taken at once.
PAIR_ROWS = 8192
METRICS = ("sq_l2", "l2", "cosine", "manhattan")


# --- NumPy kernels (run inside tasks) ----------------------------------------------


def stack(column) -> np.ndarray:
    """A list column as a matrix."""
    if isinstance(column, (pa.ChunkedArray, pa.Array)):
        array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if len(array) == 0:
            return np.zeros((0, 0))
        return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)
    return np.array(list(column), dtype=np.float64) if len(column) else np.zeros((0, 0))


def prepare(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine" or not len(x):
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1.0, length)


def fast_distances(q: np.ndarray, s: np.ndarray, metric: str) -> np.ndarray:
    """All distances of a tile, good to rounding error; squared except for manhattan."""
    if metric == "manhattan":
        return np.abs(q[:, None, :] - s[None, :, :]).sum(axis=2)
    out = (q * q).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2.0 * (q @ s.T)
    return np.maximum(out, 0.0, out=out)


def exact_distances(q: np.ndarray, s: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distances of matched rows."""
    if metric == "manhattan":
        return np.abs(q - s).sum(axis=1)
    if metric == "cosine":
        return 1.0 - (q * s).sum(axis=1)
    d = ((q - s) ** 2).sum(axis=1)
    return np.sqrt(d) if metric == "l2" else d


def tile_top_k(q, s, sid, k, metric, allowed=None):
    """``(query row, vector row, distance)`` of the k nearest vectors of every query."""
    step = STEP if metric != "manhattan" else max(1, 2**22 // max(1, s.size))
    rows, cols, dist = [], [], []
    for at in range(0, len(q), step):
        part = q[at : at + step]
        d = fast_distances(part, s, metric)
        if allowed is not None:
            d[~allowed[at : at + step]] = np.inf
        if s.shape[0] > k:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            slack = 1e-9 * (1.0 + np.where(np.isfinite(kth), kth, 0.0))
            r, c = np.nonzero((d <= kth + slack) & np.isfinite(d))
        else:
            r, c = np.nonzero(np.isfinite(d))
        rows.append(r + at)
        cols.append(c)
    if not rows:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0)
    r, c = np.concatenate(rows), np.concatenate(cols)
    for at in range(0, len(r), 65536):
        dist.append(exact_distances(q[r[at : at + 65536]], s[c[at : at + 65536]], metric))
    d = np.concatenate(dist) if dist else np.zeros(0)
    return keep_k(r, c, d, sid[c], k)


def keep_k(r, c, d, ids, k):
    """The k rows with least (distance, id) within each ``r``."""
    order = np.lexsort((ids, d, r)) if ids.dtype != object else np.array(
        pd.DataFrame({"r": r, "d": d, "i": ids}).sort_values(["r", "d", "i"]).index, dtype=np.int64
    )
    r, c, d = r[order], c[order], d[order]
    first = np.r_[0, np.nonzero(np.diff(r))[0] + 1] if len(r) else np.zeros(0, dtype=np.int64)
    start = np.repeat(first, np.diff(np.r_[first, len(r)])) if len(r) else first
    keep = (np.arange(len(r)) - start) < k
    return r[keep], c[keep], d[keep]


def as_ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, (pa.ChunkedArray, pa.Array)) else column.to_numpy()


# --- public operator ---------------------------------------------------------------


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    vector_id: str = "chunk_id",
    vector: str = "embedding",
    metric: str = "sq_l2",
    within: DataFrame | None = None,
    cell: str | None = None,
    plan: str = "auto",
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    index=None,
) -> DataFrame:
    """The ``k`` nearest vectors of every query: ``(query_id, vector_id, distance, rank)``.

    ``index`` is a stored cell index of the same vectors: it is read instead of them, only where a
    neighbour can be (searches limited by ``within`` keep to the vectors). ``within`` holds ``(query_id, cell)`` pairs and limits each query to vectors whose
    ``cell`` column it names; without it every vector is a candidate.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("query_vec"))
    q = q.filter(F.col("query_vec").isNotNull())
    s = vectors.select(
        F.col(vector_id).alias("vector_id"),
        F.col(vector).cast("array<float>" if _is_float(vectors, vector) else "array<double>").alias("vector"),
        *([F.col(cell).cast("long").alias("cell")] if within is not None else []),
    ).filter(F.col("vector").isNotNull())
    if within is not None:
        s = s.filter(F.col("cell").isNotNull())
        pairs = within.select(F.col("query_id"), F.col(cell).cast("long").alias("cell")).distinct()
        q = q.join(pairs.groupBy("query_id").agg(F.collect_set("cell").alias("cells")), "query_id")
    few = None
    if plan in ("auto", "scan"):
        few = q.limit(SCAN_QUERIES + 1).toArrow()  # bounded, and the count that decides
        if few.num_rows > SCAN_QUERIES:
            few = None
    if index is not None and within is None:
        hits = index.hits(q, few, k, metric)
    elif few is not None:
        hits = _scan(few, q, s, k, metric, within is not None)
    elif within is not None:
        hits = _limited(q.withColumn("cell", F.explode("cells")).drop("cells"), s, k, metric, block_rows)
    else:
        hits = _cells(q, s, k, metric, block_rows, max_pivots)
    best = Window.partitionBy("query_id").orderBy("distance", "vector_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(
            "query_id",
            F.col("vector_id").alias(vector_id),
            "distance",
            F.col("rank").cast("long").alias("rank"),
        )
    )


def _is_float(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def _hit_schema(q: DataFrame, s: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("vector_id", s.schema["vector_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


# --- plan 1: queries travel, vectors stay ------------------------------------------


def _scan(table: pa.Table, q: DataFrame, s: DataFrame, k: int, metric: str, limited: bool) -> DataFrame:
    qid = np.array(table.column("query_id").to_pylist(), dtype=object)
    qvec = prepare(stack(table.column("query_vec")), metric)
    known = member = None
    if limited:
        cells = table.column("cells").to_pylist()
        known = np.array(sorted({c for mine in cells for c in mine}), dtype=np.int64)
        member = np.zeros((len(cells), len(known)), dtype=bool)
        for row, mine in enumerate(cells):
            member[row, np.searchsorted(known, mine)] = True
        if len(known) <= PUSHED_CELLS:  # reaches the scan, and prunes an index laid out by cell
            s = s.filter(F.col("cell").isin([int(c) for c in known]))
    schema = _hit_schema(q, s)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not len(batch) or not len(qid):
                continue
            allowed = None
            if limited:
                cell = as_ids(batch.column("cell"))
                asked = np.isin(cell, known)
                if not asked.any():
                    continue
                batch = batch.filter(pa.array(asked))
                allowed = member[:, np.searchsorted(known, cell[asked])]
            svec = prepare(stack(batch.column("vector")), metric)
            sid = as_ids(batch.column("vector_id"))
            r, c, d = tile_top_k(qvec, svec, sid, k, metric, allowed)
            ids = sid[c]
            if best is not None:
                r, d, ids = np.r_[best[0], r], np.r_[best[1], d], np.r_[best[2], ids]
                r, c, d = keep_k(r, np.arange(len(r)), d, ids, k)
                ids = ids[c]
            best = (r, d, ids)
        if best is not None and len(best[0]):
            out = pa.table(
                {
                    names[0]: pa.array(list(qid[best[0]])),
                    names[1]: pa.array(list(best[2])),
                    names[2]: pa.array(best[1]),
                }
            )
            yield from out.to_batches()

    return s.mapInArrow(run, schema)


# --- plan 2: both sides meet in cells ----------------------------------------------


def _pivots(s: DataFrame, metric: str, most: int) -> np.ndarray:
    """A bounded sample of the vectors, the same on every run: at most ``most`` rows."""
    n = s.count()
    wanted = int(min(most, max(1, np.sqrt(n) // 2)))
    rows = s.orderBy(F.xxhash64("vector_id"), "vector_id").limit(wanted).select("vector").toArrow()
    return prepare(stack(rows.column("vector")), metric)


def _plain(d: np.ndarray, metric: str) -> np.ndarray:
    """A true metric from tile distances (cosine works on unit vectors)."""
    return d if metric == "manhattan" else np.sqrt(d)


def _nearest_pivot(pivots: np.ndarray, metric: str):
    @F.pandas_udf("cell int, reach double")
    def assign(v: pd.Series) -> pd.DataFrame:
        cell, reach = [], []
        x = prepare(stack(v), metric)
        for at in range(0, len(x), STEP):
            d = _plain(fast_distances(x[at : at + STEP], pivots, metric), metric)
            best = d.argmin(axis=1)
            cell.append(best)
            reach.append(d[np.arange(len(best)), best])
        return pd.DataFrame({"cell": np.concatenate(cell).astype("int32"), "reach": np.concatenate(reach)})

    return assign


def _route(pivots: np.ndarray, radius: np.ndarray, near: np.ndarray, count: np.ndarray, k: int, metric: str):
    """Cells that can hold one of a query's k nearest.

    ``near[c]`` lists the least member distances of cell c.  The k-th least of
    ``d(query, pivot) + d(pivot, member)`` bounds the k-th neighbour from above; a cell whose
    nearest possible member is farther is skipped.
    """

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        out = []
        x = prepare(stack(v), metric)
        for at in range(0, len(x), 64):
            d = _plain(fast_distances(x[at : at + 64], pivots, metric), metric)
            upper = (d[:, :, None] + near[None, :, :]).reshape(len(d), -1)
            rest = d + radius[None, :]
            if upper.shape[1] >= k and np.isfinite(near).sum() >= k:
                bound = np.partition(upper, k - 1, axis=1)[:, k - 1]
            else:
                order = np.argsort(rest, axis=1)
                reached = np.cumsum(count[order], axis=1) >= k
                at_k = np.where(reached.any(axis=1), reached.argmax(axis=1), rest.shape[1] - 1)
                bound = np.take_along_axis(rest, np.take_along_axis(order, at_k[:, None], 1), 1)[:, 0]
                bound = np.where(reached.any(axis=1), bound, np.inf)
            # slack covers the rounding of the tile arithmetic
            possible = (d - radius[None, :]) <= (bound * (1 + 1e-6) + 1e-5)[:, None]
            out += [np.nonzero(p & (count > 0))[0].astype("int32") for p in possible]
        return pd.Series(out)

    return cells


def _cells(q: DataFrame, s: DataFrame, k: int, metric: str, block_rows: int, most: int) -> DataFrame:
    pivots = _pivots(s, metric, most)
    if not len(pivots):
        return q.sparkSession.createDataFrame([], _hit_schema(q, s))
    placed = cut(
        s.withColumn("_p", _nearest_pivot(pivots, metric)("vector"))
        .select("vector_id", "vector", F.col("_p.cell").cast("long").alias("cell"), F.col("_p.reach").alias("reach"))
    )
    listed = min(k, 64)
    inner = Window.partitionBy("cell").orderBy("reach")
    # at most `listed` members per cell are listed, cells are at most `most`
    near_rows = (
        placed.select("cell", "reach").withColumn("at", F.row_number().over(inner)).filter(F.col("at") <= listed).collect()
    )
    size_rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()
    radius, count = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    near = np.full((len(pivots), listed), np.inf)
    for row in size_rows:
        radius[row["cell"]], count[row["cell"]] = row["radius"], row["n"]
    for row in near_rows:
        near[row["cell"], row["at"] - 1] = row["reach"]
    route = _route(pivots, radius, near, count, k, metric)
    asked, wanted = _grouped(q, pivots, metric, route.func, rows=QUERY_ROWS * max(1, min(WIDE, WIDE_K // k)))
    return _sweep(asked, placed.select("vector_id", "vector", "cell"), wanted, k, metric, block_rows)


def _block_count(n: Column, spark, rows: int | None = None) -> Column:
    """Blocks of about ``rows`` queries (QUERY_ROWS), of fewer where the cores would have none."""
    spread = F.least(F.lit(2 * spark.sparkContext.defaultParallelism), F.ceil(n / STEP))
    return F.greatest(F.ceil(n / (rows or QUERY_ROWS)), spread, F.lit(1)).cast("long")


def _limited(q: DataFrame, s: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    """Each query meets the vectors of its own ``cell`` rows."""
    q = cut(q)
    blocks = q.groupBy("cell").agg(_block_count(F.count("*"), q.sparkSession).alias("blocks"))
    asked = q.join(blocks, "cell").select(
        F.col("cell").alias("group"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("qb"), "query_id", "query_vec"
    )
    wanted = blocks.select("cell", F.col("cell").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("qb"))
    return _sweep(asked, s, wanted, k, metric, block_rows)


def _grouped(q: DataFrame, pivots: np.ndarray, metric: str, route, extra: int = 0, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``group, qb, query_id, query_vec`` with queries of neighbouring pivots in a block, and
    ``cell, group, qb``: the cells that ``route`` names for any query of a block. The last ``extra``
    components of a query are not its vector's."""
    spark = q.sparkSession
    vec = F.expr(f"slice(query_vec, 1, size(query_vec) - {extra})") if extra else F.col("query_vec")
    placed = cut(
        q.withColumn("_p", _nearest_pivot(pivots, metric)(vec)).select("query_id", "query_vec", F.col("_p.cell").cast("long").alias("pivot"))
    )
    size = np.zeros(len(pivots), dtype=np.int64)
    for row in placed.groupBy("pivot").count().collect():  # at most MAX_PIVOTS rows
        size[row["pivot"]] = row["count"]
    total = int(size.sum())
    blocks = spark.range(1).select(_block_count(F.lit(total), spark, rows)).first()[0]
    middle = np.nan_to_num(pivots - pivots.mean(axis=0), posinf=0.0, neginf=0.0)
    along = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable") if pivots.size else np.arange(len(pivots))
    # pivots in line, cut where a block is full; a pivot with more queries has blocks of its own
    first, many, at, full = np.zeros(len(pivots), dtype=np.int64), np.ones(len(pivots), dtype=np.int64), 0, 0.0
    for p in along:
        share = size[p] * blocks / max(1, total)
        if full and full + share > 1.0:
            at, full = at + 1, 0.0
        first[p], many[p] = at, max(1, round(share))
        if many[p] > 1:
            at, full = at + int(many[p]), 0.0
        else:
            full += share
    names = spark.createDataFrame([(p, int(first[p]), int(many[p])) for p in range(len(pivots))], "pivot long, first long, many long")
    asked = placed.join(names, "pivot").select(
        F.lit(0).cast("long").alias("group"), (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("many"))).alias("qb"), "query_id", "query_vec"
    )

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set] = {}
        for batch in batches:
            blocks = batch.column("qb").to_numpy()
            x = stack(batch.column("query_vec"))
            for b in np.unique(blocks):
                mine = x[blocks == b]
                for start in range(0, len(mine), STEP):
                    named = route(pd.Series(list(mine[start : start + STEP])))
                    seen.setdefault(int(b), set()).update(np.unique(np.concatenate(list(named))).tolist())
        for b, cells in seen.items():
            yield pa.record_batch({"cell": pa.array(sorted(cells), pa.int64()), "qb": pa.array([b] * len(cells), pa.int64())})

    wanted = asked.select("qb", "query_vec").mapInArrow(needs, "cell long, qb long").distinct()
    return asked, cut(wanted.select("cell", F.lit(0).cast("long").alias("group"), "qb"))


def _packed(rows: DataFrame, keys: list[str], ids: str, vec: str, kind: type, size: int) -> DataFrame:
    """``keys..., <ids> array, block``: up to ``size`` rows of equal keys as one, vectors as bytes."""
    id_type = rows.schema[ids].dataType
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in keys), T.StructField(ids, T.ArrayType(id_type)), T.StructField("block", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(n).to_numpy() for n in keys])
            order = np.lexsort(key[::-1])
            key, x = key[:, order], stack(batch.column(vec)).astype(kind)[order]
            names = batch.column(ids).take(pa.array(order))
            turn = np.r_[0, np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1, len(order)]
            start = np.concatenate([np.arange(a, z, size) for a, z in zip(turn[:-1], turn[1:])])
            end = np.r_[start[1:], len(order)]
            out = [pa.array(key[i][start], pa.int64()) for i in range(len(keys))]
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[start, len(order)], pa.int32()), names))
            out.append(pa.array([x[a:z].tobytes() for a, z in zip(start, end)], pa.binary()))
            yield pa.record_batch(out, names=[*keys, ids, "block"])

    return rows.select(*keys, ids, vec).mapInArrow(run, schema)


def _sweep(q: DataFrame, s: DataFrame, wanted: DataFrame, k: int, metric: str, block_rows: int, found=None) -> DataFrame:
    """Queries of a block ``(group, qb)`` against the vectors of the cells ``wanted`` for it, which
    stream by; ``block_rows`` vectors are compared at once, TILE_ROWS at most. ``found`` is a schema
    and a block of another kind than that of the k nearest."""
    spark = q.sparkSession
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch_rows) == "10000":
        spark.conf.set(batch_rows, "1000")  # rows hold PACK_ROWS vectors
    kind = np.float32 if _is_float(s, "vector") else np.float64
    hit, (schema, make) = _hit_schema(q, s), found or (_hit_schema(q, s), _Block)
    fields = hit.fieldNames()
    keys, size = ["group", "qb"], max(1, min(block_rows, PACK_ROWS))
    asked = _packed(q, keys, "query_id", "query_vec", np.float64, PACK_ROWS)
    vectors = _packed(s, ["cell"], "vector_id", "vector", kind, size).join(wanted, "cell")
    rows = asked.select(*keys, F.lit(0).alias("side"), "query_id", F.lit(None).cast(T.ArrayType(hit["vector_id"].dataType)).alias("vector_id"), "block").unionByName(
        vectors.select(*keys, F.lit(1).alias("side"), F.lit(None).cast(T.ArrayType(hit["query_id"].dataType)).alias("query_id"), "vector_id", "block")
    )
    tile = max(1, min(block_rows, TILE_ROWS * (4 if metric == "manhattan" else 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            key = list(zip(batch.column("group").to_pylist(), batch.column("qb").to_pylist()))
            side, data = batch.column("side").to_pylist(), batch.column("block")
            for i, here in enumerate(key):
                if here != at:
                    if block is not None:
                        yield from block.hits(fields)
                    block, at = make(k, metric, tile), here
                if side[i] == 0:
                    block.ask(batch.column("query_id")[i].values, np.frombuffer(data[i].as_buffer(), np.float64))
                else:
                    block.meet(batch.column("vector_id")[i].values, np.frombuffer(data[i].as_buffer(), kind))
        if block is not None:
            yield from block.hits(fields)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, schema)


class _Block:
    """The running k nearest of a block of queries."""

    def __init__(self, k: int, metric: str, tile: int):
        self.k, self.metric, self.tile = k, metric, tile
        self.names, self.x, self.ids, self.rows, self.held, self.q = [], [], [], [], 0, None

    def ask(self, ids: pa.Array, x: np.ndarray) -> None:
        self.names.append(ids)
        self.x.append(x.reshape(len(ids), -1))

    def meet(self, ids: pa.Array, x: np.ndarray) -> None:
        if not self.names:
            return
        self.ids.append(ids)
        self.rows.append(x.reshape(len(ids), -1))
        self.held += len(ids)
        if self.held >= self.tile:
            self.step()

    def start(self) -> None:
        self.q = prepare(np.concatenate(self.x), self.metric)
        self.names, self.x = pa.concat_arrays(self.names), None
        self.kth = np.where(np.isfinite(self.q).all(axis=1), np.inf, -np.inf)  # the others find nothing
        self.groups = [_Kept(self.kth[at : at + STEP], self.k) for at in range(0, len(self.q), STEP)]

    def step(self) -> None:
        """Candidates of the vectors held: those not surely beyond a query's k-th distance so far."""
        if self.q is None:
            self.start()
        ids, s = pa.concat_arrays(self.ids), np.concatenate(self.rows).astype(np.float64)
        self.ids, self.rows, self.held = [], [], 0
        s = prepare(s, self.metric)
        whole = np.isfinite(s).all(axis=1)
        if not whole.all():
            s, ids = s[whole], ids.filter(pa.array(whole))
        if not len(s):
            return
        if pa.types.is_integer(ids.type):
            names = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            names = as_ids(ids)
        bound = _Bound(s, self.metric, float(np.abs(self.q[np.isfinite(self.q)]).max(initial=0.0)))
        for first, group in zip(range(0, len(self.q), STEP), self.groups):
            rows = self.q[first : first + STEP]
            for at in range(0, len(rows), bound.step):
                q, kth = rows[at : at + bound.step], group.kth[at : at + bound.step]
                r, c = bound.near(q, kth, self.k)
                for a in range(0, len(r), PAIR_ROWS):
                    i, j = r[a : a + PAIR_ROWS], c[a : a + PAIR_ROWS]
                    d = exact_distances(q[i], s[j], self.metric)
                    keep = (d <= kth[i]) & np.isfinite(d)
                    if keep.any():
                        group.add(i[keep] + at, d[keep], names[j[keep]])
                if group.waiting > max(len(rows) * self.k, 1 << 17):
                    group.merge()
            if group.waiting > len(rows) * self.k // 2 or (group.kth == np.inf).any():
                group.merge()

    def hits(self, fields: list[str]) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.step()
        if self.q is None:
            return
        for first, group in zip(range(0, len(self.q), STEP), self.groups):
            group.merge()
            if group.best is None:
                continue
            (r, d, ids), group.best = group.best, None
            for at in range(0, len(r), 65536):
                names = ids[at : at + 65536]
                found = pa.array(names, mask=names == _NO_ID) if names.dtype == np.int64 else pa.array(list(names))
                asked = self.names.take(pa.array(r[at : at + 65536].astype(np.int64) + first))
                yield pa.record_batch([asked, found, pa.array(d[at : at + 65536])], names=fields)


class _Kept:
    """The k nearest so far of at most STEP queries of a block, and candidates not yet merged with
    them: what sorting needs besides is bounded by the group, not by the block."""

    def __init__(self, kth: np.ndarray, k: int):
        self.kth, self.k, self.best, self.more, self.waiting = kth, k, None, [], 0

    def add(self, r: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        self.more.append((r.astype(np.uint16), d, ids))
        self.waiting += len(r)

    def merge(self) -> None:
        if not self.more:
            return
        parts = self.more if self.best is None else [self.best, *self.more]
        r, d, ids = (np.concatenate(x) for x in zip(*parts))
        self.more, self.waiting = [], 0
        order = _by_distance(r, d, ids)
        r = r[order]
        end = np.cumsum(np.bincount(r, minlength=len(self.kth)))
        start = np.r_[0, end[:-1]]
        keep = np.arange(len(r)) - start[r] < self.k
        order = order[keep]
        self.best = (r[keep], d[order], ids[order])
        full = end - start >= self.k
        end = np.cumsum(np.minimum(end - start, self.k))
        self.kth[full] = self.best[1][end[full] - 1]


def _by_distance(r: np.ndarray, d: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by (r, d, ids), where few distances are equal; ``r`` of 16 bits is sorted by counting."""
    if ids.dtype == object:
        return np.array(pd.DataFrame({"r": r, "d": d, "i": ids}).sort_values(["r", "d", "i"]).index, dtype=np.int64)
    order = np.argsort(d)
    order = order[np.argsort(r[order], kind="stable")]
    same = (np.diff(d[order]) == 0) & (np.diff(r[order]) == 0)
    if same.any():
        at = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        run = np.cumsum(np.r_[True, ~same])[at]
        order[at] = order[at][np.lexsort((ids[order[at]], run))]
    return order


#: Stands for an id that is null, which comes first.
_NO_ID = -(2**63)


class _Bound:
    """A cheap test of queries against a tile: never says no to a distance within the bound."""

    def __init__(self, s: np.ndarray, metric: str, most: float):
        self.metric, self.s = metric, s
        width = max(1, s.shape[1])
        most = max(most, float(np.abs(s).max(initial=0.0)))
        if metric == "manhattan":
            # whole steps of the components: sums of their differences are off by a step a component at most
            self.step = max(1, 2**17 // max(1, len(s)))  # long rows, so that sums stay in the cache
            self.unit = 2.0 * most / (32766 // width - 2) if 0 < most < 1e300 and width < 8000 else 0.0
            self.width = width
            if self.unit:
                self.whole = np.ascontiguousarray(np.rint(s / self.unit).astype(np.int16).T)
            return
        self.step = min(STEP, NEAR_ROWS)  # short rows, so that products stay in the cache
        self.kind = np.float32 if most < 1e15 else np.float64
        self.rest = 2.0 * (width + 8) * float(np.finfo(self.kind).eps)
        self.length = float(np.sqrt((s * s).sum(axis=1).max(initial=0.0)))
        # a last component of one in the queries adds the squares within the product
        self.columns = np.empty((s.shape[1] + 1, len(s)), self.kind)
        self.columns[:-1] = s.astype(self.kind).T
        self.columns[:-1] *= self.kind(-2.0)
        self.columns[-1] = 1.0 if metric == "cosine" else (s * s).sum(axis=1)
        self.room, self.below = np.empty((self.step, len(s)), self.kind), np.empty((self.step, len(s)), bool)

    def near(self, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.metric == "manhattan":
            d, slack = self._steps(q) if self.unit else (fast_distances(q, self.s, "manhattan"), 1e-9)
            limit, slack = (kth / self.unit if self.unit else kth * (1 + 1e-9)), np.full(len(q), float(slack))
        else:
            squares = (q * q).sum(axis=1)
            own = np.ones(len(q)) if self.metric == "cosine" else squares
            wide = np.ones((len(q), len(self.columns)), self.kind)
            wide[:, :-1] = q
            d = np.matmul(wide, self.columns, out=self.room[: len(q)])
            slack = self.rest * (np.sqrt(squares) + max(1.0, self.length)) ** 2 + 1e-30
            limit = (2.0 * kth if self.metric == "cosine" else kth * kth if self.metric == "l2" else kth) * (1 + 1e-9) - own
        open_ = kth == np.inf
        limit = limit + slack
        if open_.any() and d.shape[1] > k:
            limit[open_] = np.partition(d[open_], k - 1, axis=1)[:, k - 1].astype(np.float64) + 2.0 * slack[open_]
        if self.metric != "manhattan":
            limit = np.nextafter(limit, np.inf).astype(self.kind)
        below = np.less_equal(d, limit[:, None], out=None if self.metric == "manhattan" else self.below[: len(q)])
        return np.divmod(np.flatnonzero(below), d.shape[1])

    def _steps(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        whole = np.rint(np.where(np.isfinite(q), q, 0.0) / self.unit).astype(np.int16)
        total = np.zeros((len(q), self.whole.shape[1]), np.int16)
        part = np.empty_like(total)
        for j in range(self.width):
            np.subtract(whole[:, j, None], self.whole[j], out=part)
            np.abs(part, out=part)
            total += part
        return total, self.width + 2


def knn(vectors: DataFrame, k: int, *, metric: str = "sq_l2", vector_id: str = "chunk_id", vector: str = "embedding", plan: str = "cells", **kw) -> DataFrame:
    """Every vector's k nearest *other* vectors: ``(id, neighbour, distance, rank)``."""
    found = top_k(
        vectors.select(F.col(vector_id).alias("query_id"), F.col(vector).alias("query_vec")),
        vectors.select(F.col(vector_id).alias("neighbour"), F.col(vector).alias("embedding")),
        k + 1,
        vector_id="neighbour",
        metric=metric,
        plan=plan,
        **kw,
    ).filter(F.col("query_id") != F.col("neighbour"))
    again = Window.partitionBy("query_id").orderBy("distance", "neighbour")
    return (
        found.withColumn("rank", F.row_number().over(again))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
        .withColumnRenamed("query_id", "id")
    )
