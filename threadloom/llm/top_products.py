"""Exact top-k by integer inner product: norm-sorted candidates and rotated partial sums.

Components become floor(1024 x). Candidates are dealt to blocks by descending length (quantiles of
the lengths; equal lengths are cut by a hash). The ``SEEDS`` longest vectors, a bounded number, give
each query a first lower bound of its k-th score; by Cauchy-Schwarz a query then only goes to blocks
whose greatest length can reach that bound. In a block, rows are rotated by the eigenvectors of the
corpus' Gram matrix (its right singular vectors), so that the first components hold most of the
length; partial sums plus the product of the rests' lengths bound the score from above, longest
candidates first, and what stays below the bound is not computed. All kept scores are exact.

Blocks and query blocks have a fixed size, so a task's memory does not grow; a query meets a block
once, and a block returns at most k rows for each of its queries.

Defined results: vectors that are null, empty or hold null or non-finite components and rows
without ``vec_id`` take no part; missing components of shorter vectors are zero; equal rows are
rows of their own as candidates, and one query; scores outside the range of long are cut to it. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import cut

from .vectors import matrix, usable

K = 10
BLOCK = 8192
QUERY_BLOCK = 2048
SEEDS = 2048
STEP = 1024
#: Components summed before the first bound.
HEAD = 16


def integers(rows: DataFrame) -> DataFrame:
    """``vec_id, x, norm, times``: components floor(1024 x) as doubles, equal rows once with their number."""
    rows = usable(rows).selectExpr("vec_id", "transform(x, c -> floor(1024 * c) + 0D) AS x")
    return rows.where("forall(x, c -> abs(c) < double('Infinity'))").groupBy("vec_id", "x").agg(F.count("*").alias("times")).withColumn("norm", F.expr("sqrt(aggregate(x, 0D, (s, c) -> s + c * c))"))


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of doubles that hold integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(q, q_ids, floor, x, x_ids, turn, k):
    """(scores, places) of the k best rows of ``x``, which come by ascending id, for each query that are not
    certainly below ``floor``."""
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
    x, x_ids = x[order], x_ids[order]
    rq, rx = q @ turn, x @ turn
    rest_q, rest_x = np.linalg.norm(rq[:, HEAD:], axis=1), np.linalg.norm(rx[:, HEAD:], axis=1)
    size_q, size_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    floor = floor.copy()
    held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
    for a in range(0, len(x), STEP):
        b = min(a + STEP, len(x))
        slack = 1e-9 * size_q * size_x[a] + 1e-6
        live = np.flatnonzero(size_q * size_x[a] + slack >= floor)  # lengths only fall from here
        if not len(live):
            break
        bound = rq[live, :HEAD] @ rx[a:b, :HEAD].T
        bound += rest_q[live, None] * rest_x[a:b]
        open_ = bound >= (floor[live] - slack[live])[:, None]
        columns = np.flatnonzero(open_.any(axis=0))
        if not len(columns):
            continue
        scores = exact_products(q[live], x[a:b][columns])
        ids, places = x_ids[a:b][columns], order[a:b][columns]
        for row, i in enumerate(live.tolist()):
            mine = np.flatnonzero((scores[row] >= floor[i]) & (ids != q_ids[i]))
            if len(mine):
                s, n = np.append(held[i][0], scores[row][mine]), np.append(held[i][1], places[mine])
                keep = best(s, n, k)
                held[i] = (s[keep], n[keep])
                if len(keep) == k:
                    floor[i] = max(floor[i], s[keep[-1]])
    return held


def top_products(rows: DataFrame, queries: str, k: int = K, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``rows(vec_id, embedding)`` that the SQL
    condition ``queries`` selects, its k highest inner products with the other rows."""
    data = cut(integers(rows))
    spark = rows.sparkSession
    wide = data.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n")).first()
    width, count = wide["d"] or 1, wide["n"]

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch["x"], width)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": np.arange(width * width), "value": total.ravel()})

    summed = np.zeros(width * width)
    for r in data.select("x").mapInArrow(gram, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # width ** 2 rows
        summed[r["at"]] = r["value"]
    summed = np.nan_to_num(summed.reshape(width, width) / (np.abs(summed).max() or 1))
    turn = np.ascontiguousarray(np.linalg.eigh((summed + summed.T) / 2)[1][:, ::-1])

    parts = max(1, -(-count // block))
    edges = sorted(set(data.agg(F.percentile_approx("norm", [i / parts for i in range(1, parts)], 100 * parts)).first()[0])) if parts > 1 else []
    # one number for each block: 8 bytes for 8192 rows
    at = np.array(edges)

    def rank(batches):
        for batch in batches:
            low = len(at) - np.searchsorted(at, batch["norm"].to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int32())], [*batch.schema.names, "level"])

    levels = cut(data.mapInArrow(rank, "vec_id long, x array<double>, times long, norm double, level int"))
    sizes = {r["level"]: (r["n"], r["longest"]) for r in levels.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    slots = {v: -(-n // block) for v, (n, _) in sizes.items()}

    least = data.agg(F.percentile_approx("norm", max(0.0, 1 - 2 * SEEDS / max(count, 1)), 10_000)).first()[0]
    long = data.where(F.col("norm") >= (least or 0.0))
    seeds = [(r["vec_id"], r["x"]) for r in long.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "x").collect()]  # bounded
    seed_ids = np.array([i for i, _ in seeds], np.int64)
    seed_x = np.array([x + [0.0] * (width - len(x)) for _, x in seeds]).reshape(len(seeds), width)
    longest = np.array([[v, sizes[v][1]] for v in sorted(sizes)]).reshape(len(sizes), 2)

    def first_bounds(batches):
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                q, ids = matrix(part["x"], width), part["vec_id"].to_numpy()
                scores = exact_products(q, seed_x)
                floor = np.full(len(ids), -(2**63), np.int64)
                for i in range(len(ids)):
                    mine = scores[i][seed_ids != ids[i]]
                    if len(mine) >= k:
                        floor[i] = np.partition(mine, len(mine) - k)[len(mine) - k]
                reach = part["norm"].to_numpy()[:, None] * longest[:, 1] * (1 + 1e-9) + 1e-6 >= floor[:, None]
                go = [longest[r, 0].astype(np.int32) for r in reach]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["x"], pa.array(floor), pa.array(go, pa.list_(pa.int32()))], ["vec_id", "x", "floor", "go"])

    asked = cut(data.where(queries).mapInArrow(first_bounds, "vec_id long, x array<double>, floor long, go array<int>"))
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    slot = spark.createDataFrame(list(slots.items()) or [(0, 1)], "level int, slots int")
    c = levels.join(F.broadcast(slot), "level").select("level", F.expr("int(pmod(xxhash64(vec_id), slots))").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(None).cast("long").alias("floor"), "vec_id", "x", "times")
    q = asked.select("vec_id", "x", "floor", F.expr(f"int(pmod(xxhash64(vec_id), {groups}))").alias("g"), F.explode("go").alias("level")).join(F.broadcast(slot), "level")
    q = q.select("level", F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), "g", "floor", "vec_id", "x", F.lit(1).cast("long").alias("times"))

    def task(table: pa.Table) -> pa.Table:
        ask = table["floor"].is_valid().to_numpy()
        ids, x = table["vec_id"].to_numpy(), matrix(table["x"], width)
        floor = table["floor"].fill_null(0).to_numpy()[ask]
        q_ids = ids[ask]
        row = np.flatnonzero(~ask)
        row = row[np.lexsort((*x[row].T[::-1], ids[row]))]  # of one id, by the vector
        times = table["times"].to_numpy()[row]
        held = search_block(x[ask], q_ids, floor, x[row], ids[row], turn, k) if ask.any() and len(row) else []
        place = np.concatenate([n for _, n in held]) if held else np.empty(0, np.int64)
        return pa.table({
            "query_id": pa.array(np.repeat(q_ids, [len(s) for s, _ in held]) if held else [], pa.int64()),
            "vec_id": pa.array(ids[row][place], pa.int64()),
            "score": pa.array(np.concatenate([s for s, _ in held]) if held else [], pa.int64()),
            "times": pa.array(times[place], pa.int64()),
        })

    found = c.union(q).groupBy("level", "slot", "g").applyInArrow(task, "query_id long, vec_id long, score long, times long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
