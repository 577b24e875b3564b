"""Hard negatives of anchors: STR-packed R-trees, searched best box first inside a window of scores.

Components become floor(scale x). The rows are packed in the order of sort-tile-recursive trees: Spark deals them by
ranges of (label, slab of the widest coordinate, second coordinate), a tile of ``REGION`` rows is sorted and
cut again by the widest coordinate of each part into leaves of ``LEAF`` rows, ``FAN`` boxes make the next box.
The bounding box of a node gives an interval for every q_i x_i and so for the inner product. A query takes the
box with the highest possible score in its window first, and leaves out boxes whose interval misses the
window, whose labels cannot do, or whose best is strictly below the k-th score held (equal ones may hold a
smaller id).

An anchor's positives come from one search (its label, no window), its negatives from a second one with a window
for each positive score. A task holds ``SHELF`` trees and reads the anchors block by block from files of the shared
folder, so neither side is copied for each pair of blocks; it returns at most k rows for an anchor's
window. Trees are searched in waves, each four times as large as the one before; a wave starts with the
k-th scores of those before it, so what waves return grows with anchors x log(trees).

Equal vectors of a label differ by id alone: of them the ids that can be among the first k stay (the least k + 1),
which loses no result and leaves no group of copies to one task.

Defined results: rows with a null label, a null or empty vector, a null or non-finite component, or without
``vec_id`` take no part; missing components of shorter vectors are zero; rows with an anchor's own id are never its
positives; repeated rows are rows of their own as positives and negatives, and one anchor; scores outside the
range of long are cut to it. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import cut

from .blocks import shared_folder
from .shared_files import Reader, Writer
from .top_products import exact_products
from .vectors import matrix

REGION = 4096
LEAF = 128
FAN = 8
SHELF = 32
QUERY_BLOCK = 1024
FIRST_WAVE = 16
SLABS = 64
NONE = -(2**63)
MOST = 2**63 - 1
EXACT = 2.0**53


def pack(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Sort-tile-recursive order of the rows of ``x``, and where each leaf begins (and the last one ends)."""
    order, starts = np.arange(len(x)), []
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        leaves = -(-(b - a) // leaf)
        if leaves <= 1:
            starts.append(a)
            continue
        rows = x[order[a:b]]
        widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
        order[a:b] = order[a:b][np.argsort(rows[:, widest], kind="stable")]
        tiles = max(2, round(leaves**0.5))
        step = -(-leaves // tiles) * leaf  # whole leaves
        todo += [(s, min(s + step, b)) for s in range(a, b, step)][::-1]
    return order, np.array([*starts, len(x)])


@dataclass
class Tree:
    """Rows in packed order, and the boxes of all nodes: leaves first, then each level above."""

    ids: np.ndarray
    times: np.ndarray
    label: np.ndarray
    x: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    labels: np.ndarray  # least and greatest label of a node
    children: list[range]

    @staticmethod
    def build(ids, times, label, x) -> Tree:
        order, starts = pack(x)
        ids, times, label, x = ids[order], times[order], label[order], x[order]
        at = starts[:-1]
        low, high = [np.minimum.reduceat(x, at)], [np.maximum.reduceat(x, at)]
        labels = [np.stack([np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)], axis=1)]
        children, base = [range(0)] * len(at), 0
        while len(low[-1]) > 1:
            n = len(low[-1])
            at = np.arange(0, n, FAN)
            children += [range(base + a, base + min(a + FAN, n)) for a in at.tolist()]
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
            labels.append(np.stack([np.minimum.reduceat(labels[-1][:, 0], at), np.maximum.reduceat(labels[-1][:, 1], at)], axis=1))
            base += n
        return Tree(ids, times, label, x, starts, np.concatenate(low), np.concatenate(high), np.concatenate(labels), children)


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with a point of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    span = float(np.abs(q).max(initial=0)) * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * q.shape[1]
    if span >= EXACT:  # whole numbers are no longer exact
        slack = 1e-9 * span
        least, most = least - slack, most + slack
    return least, most


class Held:
    """The first k rows of a window so far."""

    __slots__ = ("low", "high", "floor", "k", "score", "ids", "times")

    def __init__(self, low: int, high: int, floor: int, k: int):
        self.low, self.high, self.floor, self.k = low, high, max(floor, low), k
        self.score = self.ids = self.times = np.empty(0, np.int64)

    def open(self, least: float, most: float) -> bool:
        return most >= self.floor and least <= self.high

    def add(self, score, ids, times) -> None:
        some = (score >= self.floor) & (score <= self.high)
        if not some.any():
            return
        score, ids, times = (np.append(a, b[some]) for a, b in ((self.score, score), (self.ids, ids), (self.times, times)))
        first = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids, self.times = score[first], ids[first], times[first]
        if len(first) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def search(trees: list[Tree], bounds, at: int, q: np.ndarray, q_id: int, q_label: int, windows: list[Held], same: bool, width: int) -> None:
    """Fills the windows of one query from the trees, best box first. ``bounds`` are those of each tree for
    the block of queries, ``at`` is the query's row in them."""

    def offer(t: int, node: int) -> None:
        a, b = trees[t].labels[node]
        if (not a <= q_label <= b) if same else a == b == q_label:
            return
        least, most = bounds[t][0][at, node], bounds[t][1][at, node]
        best = max((min(most, w.high) for w in windows if w.open(least, most)), default=None)
        if best is not None:
            heapq.heappush(queue, (-best, t, node))

    queue: list[tuple[float, int, int]] = []
    for t, tree in enumerate(trees):
        offer(t, len(tree.children) - 1)
    while queue:
        best, t, node = heapq.heappop(queue)
        if -best < min(w.floor for w in windows):
            return  # nothing left reaches any window's k-th score
        tree = trees[t]
        least, most = bounds[t][0][at, node], bounds[t][1][at, node]
        live = [w for w in windows if w.open(least, most)]
        if not live:
            continue
        if len(tree.children[node]):
            for child in tree.children[node]:
                offer(t, child)
            continue
        a, b = tree.starts[node], tree.starts[node + 1]
        scores = exact_products(q[None], tree.x[a:b])[0]
        mine = (tree.label[a:b] == q_label) & (tree.ids[a:b] != q_id) if same else tree.label[a:b] != q_label
        for w in live:
            w.add(scores[mine], tree.ids[a:b][mine], tree.times[a:b][mine])


def whole(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, x, times``: rows that take part, with components floor(scale x) as doubles, equal ones once."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = "size(x) > 0 AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    x = x.where(f"vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND {finite}")
    x = x.selectExpr("vec_id", "label", f"transform(x, c -> floor({scale} * c) + 0D) AS x")
    return x.groupBy("vec_id", "label", "x").agg(F.count("*").alias("times"))


def plant(data: DataFrame, width: int, count: int) -> DataFrame:
    """The trees of ``data(vec_id, label, x, times)``, one a row, numbered from 0."""
    spread = data.select([F.var_pop(F.get("x", F.lit(i))).alias(f"v{i}") for i in range(width)]).first()
    first, second = (sorted(range(width), key=lambda i: -(spread[i] or 0.0)) * 2)[:2]
    regions = max(1, -(-count // REGION))
    slabs = min(SLABS, max(1, round(regions**0.5)))
    edges = data.agg(F.percentile_approx(F.get("x", F.lit(first)), [i / slabs for i in range(1, slabs)], 1000)).first()[0] if slabs > 1 else []
    slab = sum((F.coalesce(F.get("x", F.lit(first)), F.lit(0.0)) >= e).cast("int") for e in sorted(edges or [])) if edges else F.lit(0)
    keys = ["label", "slab", "second", "vec_id"]
    dealt = data.withColumns({"slab": slab, "second": F.coalesce(F.get("x", F.lit(second)), F.lit(0.0))})
    dealt = dealt.repartitionByRange(regions, *keys).sortWithinPartitions(*keys)

    def grow(batches):
        from pyspark import TaskContext

        number, waiting, rows = TaskContext.get().partitionId() << 20, [], 0

        def tile(parts):
            t = pa.Table.from_batches(parts)
            tree = Tree.build(t["vec_id"].to_numpy(), t["times"].to_numpy(), t["label"].to_numpy(), matrix(t["x"], width))
            small = np.abs(tree.x).max(initial=0) < 2**31
            x = tree.x.astype(np.int32 if small else np.float64)
            values = {"number": number, "small": bool(small), "ids": tree.ids.tobytes(), "times": tree.times.tobytes(), "label": tree.label.tobytes(), "x": x.tobytes()}
            return pa.RecordBatch.from_pylist([values], schema=pa.schema([("number", pa.int64()), ("small", pa.bool_()), *((c, pa.binary()) for c in ("ids", "times", "label", "x"))]))

        for batch in batches:
            while len(batch):
                part, batch = batch.slice(0, REGION - rows), batch.slice(REGION - rows)
                waiting.append(part)
                rows += len(part)
                if rows == REGION:
                    yield tile(waiting)
                    number, waiting, rows = number + 1, [], 0
        if waiting:
            yield tile(waiting)

    stored = "number long, small boolean, ids binary, times binary, label binary, x binary"
    return cut(dealt.select("vec_id", "times", "label", "x").mapInArrow(grow, stored))


def read_tree(row: dict, width: int) -> Tree:
    ids, times, label = (np.frombuffer(row[c], np.int64) for c in ("ids", "times", "label"))
    x = np.frombuffer(row["x"], np.int32 if row["small"] else np.float64).reshape(len(ids), width).astype(np.float64)
    return Tree.build(ids, times, label, x)


def _write_queries(queries: DataFrame, folder: str) -> list[tuple[str, int, int]]:
    """Queries as files of blocks; (file, offset, length) of each block."""

    def task(batches):
        writer, waiting, rows = Writer(folder, ".queries", 64_000_000), [], 0

        def block(parts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as out:
                for p in parts:
                    out.write_batch(p)
            data = sink.getvalue().to_pybytes()
            name, at = writer.add(data)
            return pa.RecordBatch.from_pydict({"name": [name], "at": [at], "length": [len(data)]})

        for batch in batches:
            while len(batch):
                part, batch = batch.slice(0, QUERY_BLOCK - rows), batch.slice(QUERY_BLOCK - rows)
                waiting.append(part)
                rows += len(part)
                if rows == QUERY_BLOCK:
                    yield block(waiting)
                    waiting, rows = [], 0
        if waiting:
            yield block(waiting)
        writer.close()

    return [tuple(r) for r in queries.mapInArrow(task, "name string, at long, length long").collect()]  # one row for 1024 anchors


FOUND = "anchor_id long, q long, aim long, vec_id long, score long, times long"


def _find(trees: DataFrame, queries: DataFrame, k: int, same: bool, low: int, high: int, width: int, first_wave: int) -> DataFrame:
    """The first ``k`` rows of each window of ``queries(anchor_id, q, label, x, aims)``: for same-label searches all scores,
    else those from ``low`` to ``high`` percent of the aim. Columns as ``FOUND``."""
    spark = trees.sparkSession
    numbers = sorted(r["number"] for r in trees.select("number").collect())  # one for each 4096 rows
    found = spark.createDataFrame([], FOUND)
    begin, size = 0, first_wave
    first = Window.partitionBy("anchor_id", "q", "aim").orderBy(F.desc("score"), "vec_id")
    while begin < len(numbers):
        wave = trees.where(F.col("number").between(numbers[begin], numbers[min(begin + size, len(numbers)) - 1]))
        asked = queries
        if begin:
            kth = found.groupBy("anchor_id", "q", "aim").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            kth = kth.groupBy("anchor_id", "q").agg(F.map_from_entries(F.collect_list(F.struct("aim", "least"))).alias("kth"))
            asked = queries.join(kth, ["anchor_id", "q"], "left").withColumn("floors", F.expr("transform(aims, a -> kth[a])")).drop("kth")
        else:
            asked = queries.withColumn("floors", F.expr("transform(aims, a -> CAST(NULL AS BIGINT))"))
        folder = shared_folder(spark, "anchors")
        files = _write_queries(asked.select("anchor_id", "q", "label", "x", "aims", "floors"), folder)

        def task(batches, folder=folder, files=files):
            reader = Reader(folder)

            def shelf(trees):
                for name, at, length in files:
                    block = pa.ipc.open_stream(reader.read(name, at, length)).read_all()
                    q = matrix(block["x"], width)
                    bounds = [intervals(q, t.low, t.high) for t in trees]
                    ids, hashes, labels = (block[c].to_pylist() for c in ("anchor_id", "q", "label"))
                    out = [[] for _ in range(6)]
                    for i, (aims, floors) in enumerate(zip(block["aims"].to_pylist(), block["floors"].to_pylist(), strict=True)):
                        windows = []
                        for aim, floor in zip(aims, floors, strict=True):
                            a, b = (NONE, MOST) if same else (-(-low * aim // 100), high * aim // 100)
                            windows.append((aim, Held(a, b, NONE if floor is None else floor, k)))
                        live = [w for _, w in windows if w.low <= w.high]
                        if live:
                            search(trees, bounds, i, q[i], ids[i], labels[i], live, same, width)
                        for aim, w in windows:
                            n = len(w.ids)
                            for column, values in zip(out, ([ids[i]] * n, [hashes[i]] * n, [aim] * n, w.ids.tolist(), w.score.tolist(), w.times.tolist()), strict=True):
                                column.extend(values)
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], [x.split()[0] for x in FOUND.split(", ")])

            held = []
            for batch in batches:
                for row in range(len(batch)):
                    held.append(read_tree(batch.slice(row, 1).to_pylist()[0], width))
                    if len(held) == SHELF:
                        yield from shelf(held)
                        held = []
            if held:
                yield from shelf(held)

        more = wave.mapInArrow(task, FOUND)
        best = found.union(more).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")
        found = cut(best)
        begin, size = begin + size, size * 4
    return found


def hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, first_wave: int = FIRST_WAVE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row of
    ``rows(vec_id, label, embedding)`` that the SQL condition ``anchors`` selects and each of its ``positives`` best other
    rows of the same label, the first ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive."""
    data = cut(whole(rows, scale))
    size = data.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n")).first()
    width = size["d"] or 1
    # of equal vectors of a label only the least ids can be among the first k
    place = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
    some = cut(data.withColumn("place", place).where(F.col("place") <= max(positives, negatives) + 1).drop("place"))
    trees = plant(some, width, some.count())
    asked = cut(data.where(anchors).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "x").alias("q"), "label", "x"))

    near = _find(trees, asked.withColumn("aims", F.array(F.lit(0).cast("long"))), positives, True, low, high, width, first_wave)
    each = near.select("anchor_id", "q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.explode(F.sequence(F.lit(1), F.least("times", F.lit(positives)))).alias("copy"))
    first = Window.partitionBy("anchor_id", "q").orderBy(F.desc("positive_score"), "positive_id", "copy")
    each = cut(each.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives))

    aims = each.groupBy("anchor_id", "q").agg(F.sort_array(F.collect_set("positive_score")).alias("aims"))
    far = _find(trees, asked.join(aims, ["anchor_id", "q"]), negatives, False, low, high, width, first_wave)
    far = far.select("anchor_id", "q", F.col("aim").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.explode(F.sequence(F.lit(1), F.least("times", F.lit(negatives)))).alias("again"))
    pairs = each.drop("copy").join(far, ["anchor_id", "q", "positive_score"])
    first = Window.partitionBy("anchor_id", "q", "place").orderBy(F.desc("negative_score"), "negative_id", "again")
    ranked = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
