import numpy as np
import pytest
from pyspark.sql import types as T

from threadloom.llm import hard_negatives as hn

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType()), T.StructField("aim", T.StringType())])


def plain(rows, positives=5, negatives=10, low=30, high=90, scale=256, every=10):
    """All scores of all anchors, one by one."""
    good = [(i, lab, [int(np.floor(scale * float(np.float32(c)))) for c in x]) for i, x, lab in rows if i is not None and lab is not None and x and None not in x and np.isfinite(x).all()]
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, lab, x in dict.fromkeys((i, lab, tuple(x)) for i, lab, x in good if i % every == 0):
        all_ = [(-score(x, y), j, m) for j, m, y in good]
        same = sorted((s, j) for s, j, m in all_ if m == lab and j != i)[:positives]
        for s, j in same:
            far = sorted((t, k) for t, k, m in all_ if m != lab and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(far)]
    return sorted(out)


def around(seed, n=400, d=6, labels=4):
    pick = np.random.default_rng(seed)
    centre = pick.normal(size=(labels, d))
    at = pick.integers(0, labels, n)
    x = centre[at] + pick.normal(scale=0.7, size=(n, d))
    return [(i, [float(np.float32(c)) for c in v], int(a)) for i, (v, a) in enumerate(zip(x, at, strict=True))]


ODD = [
    (10_000, None, 1), (10_010, [], 1), (10_020, [1.0, None], 1), (10_030, [float("nan")] * 6, 1), (10_040, [float("inf"), 1.0], 1),
    (None, [1.0] * 6, 1), (10_050, [1.0] * 6, None), (10_060, [0.0] * 6, 2), (10_070, [1.0, 2.0], 0),
]


def listed(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, x, lab, "a", "b") for i, x, lab in rows], SCHEMA)


def test_equal_to_all_scores(frame, monkeypatch):
    copies = [(2000 + i, [1.0, 2.0, -1.0, 0.5, 0.0, 1.0], 1) for i in range(120)] + [(2500 + i, [1.0, 2.0, -1.0, 0.5, 0.0, 1.0], 3) for i in range(60)]
    rows = around(1) + copies + [(5, rows_x, 2) for rows_x in ([0.5] * 6,)] + [around(1)[7]] * 3 + ODD
    want = plain(rows)
    assert len(want) > 1000 and any(r[2] == 10 for r in want)
    monkeypatch.setattr(hn, "REGION", 64)
    monkeypatch.setattr(hn, "SHELF", 2)
    monkeypatch.setattr(hn, "QUERY_BLOCK", 16)
    monkeypatch.setattr(hn, "pack", lambda x, leaf=8, pack=hn.pack: pack(x, leaf))
    for wave in (1, 100):
        assert listed(hn.hard_negatives(frame(rows), "vec_id % 10 = 0", first_wave=wave)) == want


def test_no_rows(frame):
    assert hn.hard_negatives(frame([]).limit(0), "vec_id % 10 = 0").count() == 0
    assert hn.hard_negatives(frame(ODD), "vec_id % 10 = 0").count() == len(plain(ODD))
    assert hn.hard_negatives(frame(around(2, 30)), "vec_id < 0").count() == 0


def test_leaves_are_full_tiles():
    x = np.random.default_rng(3).normal(size=(1000, 4))
    order, starts = hn.pack(x, 32)
    assert sorted(order.tolist()) == list(range(1000)) and starts[0] == 0 and starts[-1] == 1000
    sizes = np.diff(starts)
    assert sizes.max() <= 32 and (sizes == 32).sum() >= len(sizes) - 1
    assert len(hn.pack(np.zeros((100, 2)), 32)[1]) == 5  # equal rows too


def test_boxes_hold_their_rows_and_scores():
    pick = np.random.default_rng(4)
    x, q = np.floor(256 * pick.normal(size=(700, 5))), np.floor(256 * pick.normal(size=(9, 5)))
    tree = hn.Tree.build(np.arange(700), np.ones(700, np.int64), pick.integers(0, 3, 700), x)
    least, most = hn.intervals(q, tree.low, tree.high)

    def rows(node):
        if not len(tree.children[node]):
            return list(range(tree.starts[node], tree.starts[node + 1]))
        return [r for c in tree.children[node] for r in rows(c)]

    assert sorted(rows(len(tree.children) - 1)) == list(range(700))
    for node in range(len(tree.children)):
        scores = q @ tree.x[rows(node)].T
        assert (least[:, node] <= scores.min(axis=1)).all() and (most[:, node] >= scores.max(axis=1)).all()
        assert tuple(tree.labels[node]) == (tree.label[rows(node)].min(), tree.label[rows(node)].max())


def test_boxes_are_pruned(monkeypatch):
    """Far clusters are not opened, equal scores are."""
    pick = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([pick.normal(size=(2000, 3)) * 0.1 + c for c in ([9, 0, 0], [0, 9, 0], [0, 0, 9])]))
    tree = hn.Tree.build(np.arange(6000), np.ones(6000, np.int64), np.zeros(6000, np.int64), x)
    opened = []
    monkeypatch.setattr(hn, "exact_products", lambda q, y, f=hn.exact_products: opened.append(len(y)) or f(q, y))
    q = np.array([[2000.0, 10.0, 10.0]])
    held = hn.Held(hn.NONE, hn.MOST, hn.NONE, 10)
    hn.search([tree], [hn.intervals(q, tree.low, tree.high)], 0, q[0], -1, 1, [held], False, 3)
    scores = (x @ q[0]).astype(int)
    want = sorted(range(6000), key=lambda i: (-scores[i], i))[:10]
    assert held.ids.tolist() == want and sum(opened) < 1500


def test_large_components(frame):
    rows = [(i, [2.0e12 * (i + 1), -3.0e11 * (i % 7)], i % 3) for i in range(60)]
    assert listed(hn.hard_negatives(frame(rows), "vec_id % 10 = 0", low=1, high=200)) == [r for r in plain(rows, low=1, high=200) if abs(r[4]) < 2**63]
