"""The stored cell index against all distances."""

import os

import numpy as np
import pytest

from threadloom.operators import nearest
from threadloom.sources import cells
from threadloom.sources.cells import CellIndex


@pytest.fixture(scope="module")
def points(spark):
    pick = np.random.default_rng(11)
    centre = pick.normal(size=(12, 8)) * 4
    x = centre[pick.integers(0, 12, 900)] + pick.normal(size=(900, 8))
    x[10:20] = x[5]  # ties
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (5000, None)], "chunk_id long, embedding array<float>")
    return np.array([v for _, v in rows]), frame


def want(x, q, ids, k, metric):
    if metric == "cosine":
        d = 1 - (q / np.linalg.norm(q)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    else:
        d = ((x - q) ** 2).sum(axis=1)
        d = np.sqrt(d) if metric == "l2" else d
    order = sorted(range(len(x)), key=lambda i: (round(d[i], 9), ids[i]))[:k]
    return [ids[i] for i in order]


def answers(frame, queries, k, index, **kw):
    asked = queries.selectExpr("chunk_id AS query_id", "embedding AS query_vec")
    out = {}
    for r in nearest.top_k(asked, frame, k, index=index, **kw).collect():
        out.setdefault(r.query_id, {})[r.rank] = r.chunk_id
    return {q: [m[i] for i in sorted(m)] for q, m in out.items()}


def files(path):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.mark.parametrize("metric,asked", [("sq_l2", "sq_l2"), ("sq_l2", "l2"), ("cosine", "cosine")])
def test_equal_to_all_distances(spark, points, tmp_path, metric, asked):
    x, frame = points
    index = CellIndex.build(frame.where("chunk_id < 600 OR chunk_id = 5000"), str(tmp_path / "i"), metric=metric, block_rows=20)
    queries = frame.where("chunk_id % 9 = 0 AND embedding IS NOT NULL")
    stored = files(tmp_path)
    for ids in (range(600), range(900)):
        for plan in ("scan", "cells"):
            got = answers(frame, queries, 7, index, metric=asked, plan=plan)
            assert got == {i: want(x[: len(ids)], x[i], list(ids), 7, asked) for i in range(0, 900, 9)}
        if len(ids) == 600:
            assert files(tmp_path) == stored  # queries write nothing
            index = CellIndex(spark, str(tmp_path / "i")).add(frame.where("chunk_id >= 600 AND chunk_id < 900"))
            assert stored.items() <= files(tmp_path).items()  # what was stored stays as it is


def test_few_files_are_read(spark, tmp_path):
    pick = np.random.default_rng(12)
    x = (pick.normal(size=(10, 8)) * 4)[pick.integers(0, 10, 900)] + pick.normal(size=(900, 8)) * 0.05
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    index = CellIndex.build(frame, str(tmp_path / "i"), block_rows=20)
    rings = index._rings()
    pick = cells.ring_picker(index.pivots, rings, 3, "sq_l2")
    part = pick(x).mean(axis=1)
    assert np.median(part) < 0.34  # of the rings
    seen = pick(x[[int(part.argmin())]])[0]
    assert 0 < seen.sum() < len(rings) / 4
    named = index._named(index._stored(), rings[seen])
    assert len(named.inputFiles()) == len(rings)  # the table's files, before the plan prunes them
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.n for r in named.groupBy("batch", "cell", "block").count().withColumnRenamed("count", "n").collect()} <= set(rings[seen]["n"])


def test_rings_hold_their_vectors(spark, points, tmp_path):
    x, frame = points
    index = CellIndex.build(frame, str(tmp_path / "i"), block_rows=20)
    rings = index._rings()
    assert rings["n"].sum() == 900 and rings["n"].max() <= 20
    # rings of a cell follow each other outwards
    for _, part in rings.groupby("cell"):
        part = part.sort_values("least")
        assert (part["least"].to_numpy()[1:] >= part["greatest"].to_numpy()[:-1]).all()


def test_cells_beyond_the_manifest_bound(points, tmp_path, monkeypatch):
    x, frame = points
    monkeypatch.setattr(cells, "MANIFEST_ROWS", 5)
    index = CellIndex.build(frame, str(tmp_path / "i"), block_rows=20)
    queries = frame.where("chunk_id % 50 = 0 AND embedding IS NOT NULL")
    for plan in ("scan", "cells"):
        assert answers(frame, queries, 4, index, plan=plan) == {i: want(x, x[i], list(range(900)), 4, "sq_l2") for i in range(0, 900, 50)}


def test_unfinished_batches_are_not_seen(spark, points, tmp_path):
    _, frame = points
    index = CellIndex.build(frame.where("chunk_id < 100"), str(tmp_path / "i"), block_rows=20)
    left = frame.where("chunk_id BETWEEN 100 AND 150").selectExpr("chunk_id AS vector_id", "embedding AS vector", "0D AS reach", "0L AS cell", "77L AS block")
    left.write.partitionBy("cell", "block").parquet(str(tmp_path / "i/vectors/batch=1"))
    again = CellIndex(spark, str(tmp_path / "i"))
    assert again.rows().count() == 100
    queries = frame.where("chunk_id = 120")
    assert all(i < 100 for i in answers(frame, queries, 3, again)[120])
    assert again.add(frame.where("chunk_id BETWEEN 100 AND 119")).rows().count() == 120
    assert again.rows(spark.createDataFrame([(3,), (4,), (700,)], "vector_id long")).count() == 2


def test_empty_index(spark, points, tmp_path):
    _, frame = points
    index = CellIndex.build(frame.limit(0), str(tmp_path / "i"))
    assert index.rows().count() == 0 and answers(frame, frame.where("chunk_id = 1"), 3, index) == {}
    with pytest.raises(ValueError):
        CellIndex.build(frame, str(tmp_path / "j"), metric="cosine").hits(frame, None, 1, "sq_l2")
