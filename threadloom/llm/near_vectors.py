"""Near-duplicate vectors: int8 tile products with an error bound for each vector.

Equal vectors are one class. Classes are dealt to cells around at most ``CELLS`` of their number
and cut into blocks of about ``BLOCK`` rows; every pair of blocks is a tile, unless the angles
between the cells rule out a link. In a tile unit vectors x are a = s q with q of int8 and the
error e = |x - a| known for each vector; a.b differs from the cosine by at most
e_x + (1 + e_x) e_y. Pairs that the bound puts above the threshold are linked, those that it
leaves open are computed again in double precision from the given components, the rest cannot be
linked. So the result is exact. The work is that of all pairs that the cells do not rule out; a
vector is sent to a tile for each block, and no pair leaves its tile: a tile returns counts for
each class and a spanning forest of its links.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing; missing components of shorter vectors are zero; rows without ``vec_id`` link with
nothing and have no component; repeated rows are linked copies. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

from .components import components
from .vectors import matrix, usable

THRESHOLD = 0.95
BLOCK = 8192
CELLS = 256
SLAB = 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and errors of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) + 1e-12
    return codes, scale, error


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Yields (row of x, row of y) of the linked pairs, some at a time; of pairs within x when
    ``y`` is None, each once."""
    own = y is None
    y = x if own else y
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantise(x / nx[:, None])
    qy, sy, ey = (qx, sx, ex) if own else quantise(y / ny[:, None])
    kind = np.float32 if x.shape[1] <= 1000 else np.float64  # sums of products of int8 are exact
    right, scale_y = np.ascontiguousarray(qy.astype(kind).T), sy.astype(np.float32)
    slack = 1e-6  # of scaling in single precision
    for a in range(0, len(x), SLAB):
        b = min(a + SLAB, len(x))
        first = a if own else 0
        if first >= len(y):
            continue
        near = qx[a:b].astype(kind) @ right[:, first:]
        near *= scale_y[first:]
        e = ex[a:b]
        i, j = np.nonzero(near >= ((threshold - e - (1 + e) * ey.max() - slack) / sx[a:b])[:, None].astype(np.float32))
        about = near[i, j].astype(np.float64) * sx[a + i]
        i, j = i + a, j + first
        bound = ex[i] + (1 + ex[i]) * ey[j] + slack
        keep = about + bound >= threshold
        if own:
            keep &= i < j
        i, j, sure = i[keep], j[keep], (about - bound >= threshold)[keep]
        open_ = np.flatnonzero(~sure)
        for k in range(0, len(open_), 100_000):
            o = open_[k : k + 100_000]
            p, q = i[o], j[o]
            sure[o] = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
        if sure.any():
            yield i[sure], j[sure]


def _tile(threshold: float):
    def task(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        table, cut_at = table.take(pa.array(order)), int((side == 0).sum())
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        values = matrix(table["x"])
        values /= np.abs(values).max(axis=1, keepdims=True)
        own = cut_at == len(rep)
        x, y = values[:cut_at], None if own else values[cut_at:]
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in tile_links(x, y, threshold) if cut_at else ():
            j = j if own else j + cut_at
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while True:
                low = np.minimum(label[i], label[j])
                if (label[i] == low).all() and (label[j] == low).all():
                    break
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while (label[label] != label).any():
                    label = label[label]
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some], "near": rep[label[some]]})

    return task


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows(vec_id, embedding)``."""
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    every = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).select("vec_id", "embedding", *hashes))
    good = usable(every.select("vec_id", "embedding")).where("exists(x, c -> c <> 0)")
    good = good.select("vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    classes = cut(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")))
    count = classes.count()
    # centres: at most CELLS rows
    few = min(CELLS, -(-count // block)) if count else 0
    centres = [r["x"] for r in classes.orderBy(F.xxhash64("rep"), "rep").select("x").limit(few).collect()]
    width = max(map(len, centres), default=1)
    middle = np.array([c + [0.0] * (width - len(c)) for c in centres]).reshape(len(centres), width)
    if len(centres):
        middle /= np.abs(middle).max(axis=1, keepdims=True)
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)

    def place(batches):
        for batch in batches:
            x = matrix(batch["x"], width)
            c = np.zeros((len(middle), x.shape[1]))
            c[:, :width] = middle
            x /= np.abs(x).max(axis=1, keepdims=True)
            cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ c.T
            cell = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    placed = cut(classes.select("rep", "copies", "x").mapInArrow(place, "rep long, copies long, x array<double>, cell int, angle double"))
    cells = {r["cell"]: (r["n"], r["wide"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("wide")).collect()}  # at most CELLS rows
    parts = {c: -(-n // block) for c, (n, _) in cells.items()}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    reach = float(np.arccos(threshold)) + 1e-6
    plan = []
    for c in cells:
        for d in cells:
            apart = float(np.arccos(np.clip(middle[c] @ middle[d], -1, 1)))
            if c == d or apart - cells[c][1] - cells[d][1] <= reach:
                plan.append((c, first[d], first[d] + parts[d] - 1))
    spark = rows.sparkSession
    base = spark.createDataFrame([(c, first[c], parts[c]) for c in cells], "cell int, at int, parts int")
    plan = spark.createDataFrame(plan, "cell int, lo int, hi int")
    blocked = placed.join(F.broadcast(base), "cell").withColumn("block", F.expr("at + pmod(xxhash64(rep), parts)"))
    sent = blocked.join(F.broadcast(plan), "cell").withColumn("other", F.explode(F.sequence("lo", "hi")))
    sent = sent.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("int(block > other)").alias("side"), "rep", "copies", "x")
    found = cut(sent.groupBy("i", "j").applyInArrow(_tile(threshold), "rep long, links long, near long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.selectExpr("rep AS u", "near AS v")).withColumnRenamed("node", "rep")
    many = cut(classes.select("h1", "h2", "rep", "copies").join(linked, "rep", "left").join(roots, "rep", "left").where("copies > 1 OR links > 0"))
    out = every.select("vec_id", "h1", "h2").join(many, ["h1", "h2"], "left")
    out = out.withColumn("rep", F.when(F.col("vec_id").isNotNull(), F.col("rep")))
    n = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    out = out.select("vec_id", n.alias("n_links"), F.when(F.col("rep").isNotNull(), F.coalesce("root", "rep")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
