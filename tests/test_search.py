"""Exact search plans against brute force, including crowded cells and ties."""

import numpy as np
import pytest

from threadloom.operators import nearest


def frame(spark, x, names):
    return spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], names)


def brute(q, s, k, metric):
    if metric == "cosine":
        q, s = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, s))
        d = 1 - q @ s.T
    elif metric == "manhattan":
        d = np.abs(q[:, None] - s[None]).sum(2)
    else:
        d = ((q[:, None] - s[None]) ** 2).sum(2)
        d = np.sqrt(d) if metric == "l2" else d
    out = []
    for i, row in enumerate(d):
        order = sorted(range(len(row)), key=lambda j: (round(row[j], 9), j))[:k]
        out += [(i, j, n + 1) for n, j in enumerate(order)]
    return out


@pytest.mark.parametrize("metric", nearest.METRICS)
@pytest.mark.parametrize("plan", ["scan", "cells"])
def test_plans_agree_with_brute_force(spark, metric, plan):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 6))
    # a third of all vectors sit in one spot
    s = np.vstack([centers[rng.integers(0, 5, 200)] + rng.normal(size=(200, 6)) * 0.1, centers[0] + rng.normal(size=(100, 6)) * 0.01])
    q = centers[rng.integers(0, 5, 40)] + rng.normal(size=(40, 6)) * 0.2
    hits = nearest.top_k(
        frame(spark, q, "query_id long, query_vec array<double>"), frame(spark, s, "chunk_id long, embedding array<double>"),
        7, metric=metric, plan=plan, block_rows=32,
    )
    got = sorted((r.query_id, r.chunk_id, r["rank"]) for r in hits.collect())
    assert got == sorted(brute(q, s, 7, metric))


def test_ties_go_to_the_smaller_id_and_k_may_exceed_the_rows(spark):
    s = np.ones((5, 3))
    hits = nearest.top_k(frame(spark, s[:1], "query_id long, query_vec array<double>"), frame(spark, s, "chunk_id long, embedding array<double>"), 3)
    assert sorted((r["rank"], r.chunk_id) for r in hits.collect()) == [(1, 0), (2, 1), (3, 2)]
    every = nearest.top_k(frame(spark, s[:1], "query_id long, query_vec array<double>"), frame(spark, s, "chunk_id long, embedding array<double>"), 9, plan="cells")
    assert every.count() == 5


def test_empty_index_gives_nothing(spark):
    q = frame(spark, np.ones((2, 3)), "query_id long, query_vec array<double>")
    s = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    for plan in ("scan", "cells"):
        assert nearest.top_k(q, s, 3, plan=plan).count() == 0


def test_cells_do_not_visit_what_cannot_matter(spark):
    """Far groups are pruned: with well separated groups a query meets about its own."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 4)) * 50
    s = np.repeat(centers, 50, axis=0) + rng.normal(size=(400, 4)) * 0.1
    pivots = centers.copy()
    d = np.sqrt(((s[:, None] - pivots[None]) ** 2).sum(2))
    cell = d.argmin(1)
    radius = np.array([d[cell == c, c].max() for c in range(8)])
    near = np.array([np.sort(d[cell == c, c])[:5] for c in range(8)])
    import pandas as pd

    route = nearest._route(pivots, radius, near, np.full(8, 50), 5, "l2").func
    assert all(len(c) == 1 for c in route(pd.Series(list(s[::20]))))


def test_score_rules(spark):
    from pyspark.sql import functions as F

    from threadloom.functions import vectors as v

    rows = spark.createDataFrame([(d,) for d in (0.99, 1.0, 1.01, 2.0, 2.5)], "d double").select(
        F.round(v.score(F.col("d")), 6).alias("s"), v.score(F.col("d"), "cosine").alias("c")
    ).collect()
    assert [r.s for r in rows] == [0.01, 0.0, 0.495, 0.0, 0.0]
    assert [r.c for r in rows] == sorted((r.c for r in rows), reverse=True)
    pair = spark.sql("select array(1d, 0d) a, array(0d, 1d) b, array(0d, 0d) z, array(1d, 0d, 5d) l").select(
        v.cosine(F.col("a"), F.col("a")).alias("same"), v.cosine(F.col("a"), F.col("b")).alias("right"),
        v.cosine(F.col("a"), F.col("z")).alias("zero"), v.cosine(F.col("a"), F.col("l")).alias("cut"), v.l2_normalise(F.col("z")).alias("n"),
    ).first()
    assert (pair.same, pair.right, pair.zero, pair.cut, pair.n) == (1.0, 0.0, 0.0, 1.0, [0.0, 0.0])


def test_a_query_returns_k_rows_whatever_the_blocks(spark):
    """Small blocks once returned k rows each, and wrote every query once a block."""
    x = np.random.default_rng(5).normal(size=(300, 16))
    q = frame(spark, x, "query_id long, query_vec array<double>")
    s = frame(spark, x, "vector_id long, vector array<double>")
    assert nearest._cells(q, s, 3, "sq_l2", 8, 512).count() == 900


def test_topic_limited_search_returns_k_rows_whatever_the_blocks(spark, monkeypatch):
    """A cell's queries go to blocks of a bounded number, and come back once with k rows."""
    x = np.random.default_rng(8).normal(size=(300, 16))
    q = frame(spark, x, "query_id long, query_vec array<double>").selectExpr("*", "4L AS cell")
    s = frame(spark, x, "vector_id long, vector array<double>").selectExpr("*", "4L AS cell")
    asked = []
    monkeypatch.setattr(nearest, "QUERY_ROWS", 32, raising=False)
    sweep = getattr(nearest, "_sweep", None)
    if sweep:
        monkeypatch.setattr(nearest, "_sweep", lambda rows, *rest: asked.append(rows) or sweep(rows, *rest))
    assert nearest._limited(q, s, 3, "sq_l2", 8).count() == 900
    blocks = asked[0].groupBy("group", "qb").count().collect()
    assert sum(r["count"] for r in blocks) == 300 and len(blocks) > 5 and max(r["count"] for r in blocks) < 64


@pytest.mark.parametrize("k, most", [(3, 5), (60, 13)])
def test_blocks_are_wide_where_few_rows_a_query_are_kept(spark, monkeypatch, k, most):
    """Vectors are written once a block; blocks of 32 queries each wrote them ten times for any k."""
    x = np.random.default_rng(9).normal(size=(300, 16))
    q = frame(spark, x, "query_id long, query_vec array<double>")
    s = frame(spark, x, "vector_id long, vector array<double>")
    asked, sweep = [], nearest._sweep
    monkeypatch.setattr(nearest, "QUERY_ROWS", 32)
    monkeypatch.setattr(nearest, "_sweep", lambda rows, *rest: asked.append(rows) or sweep(rows, *rest))
    got = nearest._cells(q, s, k, "sq_l2", 8, 512).collect()
    assert sorted((r.query_id, r.vector_id) for r in got) == sorted((i, j) for i, j, _ in brute(x, x, k, "sq_l2"))
    blocks = asked[0].groupBy("group", "qb").count().count()
    assert blocks <= most and (k == 3 or blocks > 5)


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_many_blocks_with_copies_and_odd_rows(spark, metric, monkeypatch):
    """Blocks of a few queries, tiles of a few vectors: the same rows as all distances."""
    for name, value in {"QUERY_ROWS": 16, "PACK_ROWS": 4, "TILE_ROWS": 8, "STEP": 8}.items():
        monkeypatch.setattr(nearest, name, value)
    x = np.random.default_rng(6).normal(size=(150, 5)).astype(np.float32).astype(float)
    x[40:90] = x[3]  # many equal distances
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    odd = [(500, None), (501, [float("nan")] * 5)]
    q = spark.createDataFrame(rows + odd, "query_id long, query_vec array<double>")
    s = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<float>")
    want = sorted(brute(x, x, 6, metric))
    got = nearest.top_k(q, s, 6, metric=metric, plan="cells").collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == want
    # limited to one of three cells
    of = s.selectExpr("*", "chunk_id % 3 AS c")
    pairs = q.selectExpr("query_id", "query_id % 3 AS c")
    got = nearest.top_k(q, of, 6, metric=metric, plan="cells", within=pairs, cell="c").collect()
    want = [(i, j * 3 + i % 3, n) for a in range(3) for i, j, n in ((i * 3 + a, j, n) for i, j, n in brute(x[a::3], x[a::3], 6, metric))]
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == sorted(want)


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6, 1e18])
@pytest.mark.parametrize("metric", nearest.METRICS)
def test_running_top_k_of_near_equal_distances(metric, scale):
    """Distances closer than single precision tells apart keep their order."""
    import pyarrow as pa

    pick = np.random.default_rng(7)
    s = (np.ones((400, 8)) + pick.normal(size=(400, 8)) * 1e-5) * scale
    q = (np.ones((30, 8)) + pick.normal(size=(30, 8)) * 1e-5) * scale
    block = nearest._Block(5, metric, 64)
    block.ask(pa.array(range(30)), q.ravel())
    for a in range(0, 400, 40):
        block.meet(pa.array(range(a, a + 40)), s[a : a + 40].ravel())
    got = {}
    for batch in block.hits(["q", "v", "d"]):
        for row in batch.to_pylist():
            got.setdefault(row["q"], []).append(row["v"])
    x, y = nearest.prepare(q, metric), nearest.prepare(s, metric)
    for i in range(30):
        d = nearest.exact_distances(np.repeat(x[i : i + 1], 400, axis=0), y, metric)
        assert got[i] == np.lexsort((np.arange(400), d))[:5].tolist()


def test_a_block_sorts_a_group_of_queries_at_a_time():
    """What a block takes besides its k rows a query was several times those rows: all were sorted at once."""
    import tracemalloc

    import pyarrow as pa

    pick = np.random.default_rng(10)
    q, s = pick.normal(size=(8192, 4)), pick.normal(size=(6000, 4))
    s[3000:3600] = s[0]  # many equal distances
    block = nearest._Block(50, "sq_l2", 2048)
    block.ask(pa.array(range(8192)), q.ravel())
    tracemalloc.start()
    for a in range(0, 6000, 100):
        block.meet(pa.array(range(a, a + 100)), s[a : a + 100].ravel())
    got = {}
    for batch in block.hits(["q", "v", "d"]):
        for row, v in zip(batch[0].to_numpy(), batch[1].to_numpy()):
            if row % 512 == 1:
                got.setdefault(int(row), []).append(int(v))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 16
    for i, found in got.items():
        d = nearest.exact_distances(np.repeat(q[i : i + 1], 6000, axis=0), s, "sq_l2")
        assert found == np.lexsort((np.arange(6000), d))[:50].tolist()
    assert peak < 3 * 8192 * 50 * 24


def test_find_totals_of_late_minutes_and_long_texts(spark):
    """As many parts, characters and chunks as ``find`` gives, also after minute 35 of an hour."""
    from pyspark.sql import functions as F

    from threadloom.operators import search

    x = np.random.default_rng(8).normal(size=(12, 4)) * 0.3
    chunks = frame(spark, x, "chunk_id long, embedding array<double>").selectExpr(
        "*", "'7' AS chat_id", "concat('7_', chunk_id * 5) AS msg_id_start", "concat('7_', chunk_id * 5 + chunk_id % 3) AS msg_id_end"
    )
    messages = spark.range(60).selectExpr(
        "concat('7_', id) AS msg_id", "'7' AS chat_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id), 0) AS ts",
        "'u' AS from_id", "if(id % 4 = 0, repeat('word ', 2000), 'short') AS text",
    )
    queries = chunks.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    rows = search.find(queries, chunks, messages, 0.8, 6).groupBy("query_id").agg(
        F.count("*").alias("parts"), F.sum(F.char_length("content")).alias("chars"), F.count_distinct("chunk_id").alias("chunks")
    )
    want = sorted(tuple(r) for r in rows.collect())
    got = search.find_totals(queries, chunks, messages, 0.8, 6).select("query_id", "parts", "chars", "chunks")
    assert len(want) == 12 and sorted(tuple(r) for r in got.collect()) == want
