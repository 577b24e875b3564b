"""Density clustering against brute force; small and distributed paths."""

import brute
import numpy as np
import pytest

from threadloom.operators import density, graph


def blobs(seed, n, dim, k, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, dim))
    return centers[rng.integers(0, k, n)] + rng.normal(size=(n, dim)) * spread


def frame(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")


@pytest.mark.parametrize(
    "size,samples,metric,method,epsilon",
    [(5, 1, "euclidean", "eom", 0.0), (4, 3, "euclidean", "leaf", 0.0), (3, 1, "euclidean", "eom", 0.35), (4, 2, "manhattan", "eom", 0.0), (2, 1, "cosine", "eom", 0.0)],
)
def test_labels(spark, size, samples, metric, method, epsilon):
    x = blobs(size, 130, 4, 6, 0.3)
    got = density.cluster(frame(spark, x), min_cluster_size=size, min_samples=samples, metric=metric, method=method, epsilon=epsilon)
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    want = brute.labels(y, size, method, epsilon, samples, "manhattan" if metric == "manhattan" else "l2")
    assert [r.label for r in got.orderBy("chunk_id").collect()] == want


def test_distributed_tree_equals_prim(spark):
    x = blobs(7, 60, 3, 4, 0.2)
    points = density._points(frame(spark, x), "chunk_id", "embedding")
    got = density.spanning_tree(points, "l2", 2, 4, task_points=1).collect()
    want = brute.prim(x, 2)
    assert len(got) == 59
    assert np.allclose(sorted(r.w for r in got), [w for w, _, _ in want])


def test_tied_points_have_one_tree_and_one_labelling(spark):
    """Coordinates of one decimal and min_samples above 1: most weights are tied."""
    x = np.round(blobs(11, 120, 2, 5, 0.3), 1)
    points = density._points(frame(spark, x), "chunk_id", "embedding")
    edges = lambda n: sorted(tuple(r) for r in density.spanning_tree(points, "l2", 4, 6, task_points=n).select("a", "b", "w").collect())
    assert edges(2048) == edges(1)
    labels = lambda **kw: [r.label for r in density.cluster(frame(spark, x), min_cluster_size=4, min_samples=4, metric="euclidean", **kw).orderBy("chunk_id").collect()]
    assert labels() == labels(task_points=1)


def test_dendrogram_runs_equal_one_run(spark):
    rng = np.random.default_rng(4)
    edges = [(int(rng.integers(0, i)) + 1, i + 1, float(rng.random())) for i in range(1, 50)]
    tree = spark.createDataFrame(edges, "a long, b long, w double")
    sizes = lambda df: sorted((r.r, round(r.w, 9), tuple(sorted((r.l_size, r.r_size)))) for r in df.collect())
    assert sizes(density.dendrogram(tree)) == sizes(density.dendrogram(tree, run_edges=13, task_rows=0))


def test_winners_round_by_round_equal_one_task(spark):
    rng = np.random.default_rng(6)
    rows = [(40, None, 0.0, 1.0)] + [(c, int(rng.integers(c + 1, 41)), 0.0, float(rng.random())) for c in range(1, 40)]
    df = spark.createDataFrame(rows, "c long, parent long, birth double, stability double")
    wins = lambda n: sorted((r.c, r.wins) for r in density._winners(df, n).collect())
    assert wins(1000) == wins(2)


def test_components_and_climb_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a long, b long")
    for rows in (10**6, 0):
        got = {(r.node, r.root) for r in graph.components(chain, rows).collect()}
        assert got == {(i, 1) for i in range(1, 31)} | {(100, 100), (101, 100)}
    ptr = spark.createDataFrame([(i, max(i - 1, 1)) for i in range(1, 20)], "node long, ptr long")
    for rows in (10**6, 0):
        assert {r.ptr for r in graph.climb(ptr, rows).collect()} == {1}


def test_guards(spark):
    x = frame(spark, blobs(1, 6, 3, 2, 0.1))
    with pytest.raises(ValueError):
        density.cluster(x, min_cluster_size=1)
    with pytest.raises(ValueError):
        density.cluster(x, metric="nope")
    assert density.checked_size(10, 50) == 5 and density.checked_size(3, 9) == 2
    assert density.cluster(x.limit(0)).count() == 0
    assert [r.label for r in density.cluster(x.limit(1)).collect()] == [-1]


def test_separated_groups(spark):
    x = np.vstack([np.eye(10)[0] + 0.01 * blobs(1, 5, 10, 1, 1), np.eye(10)[1] + 0.01 * blobs(2, 5, 10, 1, 1), np.eye(10)[2:3]])
    got = [r.label for r in density.cluster(frame(spark, x), min_cluster_size=3).orderBy("chunk_id").collect()]
    assert got == [0] * 5 + [1] * 5 + [-1]


def test_least_edges_to_other_components_while_points_stream_by():
    """One row a component whatever the number of tiles, equal weights by the lower ends."""
    import numpy as np
    import pyarrow as pa

    from threadloom.operators import density

    pick = np.random.default_rng(9)
    x = pick.integers(0, 3, size=(90, 3)).astype(float)  # many equal distances
    c = np.arange(90) % 4
    core = pick.integers(0, 2, 90).astype(float)
    block = density._Outside(1, "l2", 16)
    block.ask(pa.array(range(90)), np.c_[x, core, c, np.full(90, np.inf)].ravel())
    for a in range(0, 90, 15):
        block.meet(pa.array(range(a, a + 15)), np.c_[x, core, c][a : a + 15].ravel())
    got = {r["c"]: (r["w"], min(r["a"], r["b"]), max(r["a"], r["b"])) for batch in block.hits(None) for r in batch.to_pylist()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    w = density._weight(np.maximum(np.maximum(d, core[:, None]), core[None]))
    for k in range(4):
        assert got[k] == min((w[i, j], min(i, j), max(i, j)) for i in range(90) for j in range(90) if c[i] == k != c[j])
