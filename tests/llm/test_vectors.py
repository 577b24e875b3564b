import numpy as np

from threadloom.llm import near_vectors, top_products


def near_brute(rows):
    good = [(i, np.array(x, np.float64)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    width = max(len(x) for _, x in good)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in good])
    norm = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / np.outer(norm, norm) >= 0.95
    np.fill_diagonal(link, False)
    label = np.array([i for i, _ in good])
    while True:
        low = np.array([min([label[k], *label[link[k]]]) for k in range(len(good))])
        if (low == label).all():
            break
        label = low
    return {i: (int(n), int(c)) for (i, _), n, c in zip(good, link.sum(axis=1), label, strict=True)}


def vectors_around(seed, n=300, d=8):
    pick = np.random.default_rng(seed)
    centre = pick.normal(size=(6, d))
    x = centre[pick.integers(0, 6, n)] + pick.normal(scale=0.25, size=(n, d))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


ODD = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0, None]), (1004, [float("nan")] * 8), (1005, [float("inf"), 1.0]), (None, [1.0] * 8)]


def test_near_vectors_equal_all_pairs(vectors):
    rows = vectors_around(1) + [(500 + i, [3.0] * 8) for i in range(5)] + [(600, [6.0] * 8), (601, [1.0, 1.0])]
    frame = vectors(rows + ODD)
    for block in (8192, 40):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(frame, block=block).collect()}
        want = near_brute(rows)
        assert {i: got[i][:2] for i in want} == want
        assert all(got[i] == ((0, i, True)) for i, _ in ODD if i is not None) and got[None] == (0, None, True)
        assert len(got) == len(rows) + len(ODD)


def test_error_bound_holds():
    x = np.random.default_rng(2).normal(size=(200, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = near_vectors.quantise(unit)
    about = (codes.astype(np.int64) @ codes.astype(np.int64).T) * np.outer(scale, scale)
    bound = error[:, None] + (1 + error)[:, None] * error
    assert (np.abs(about - unit @ unit.T) <= bound).all()


def products_brute(rows, k=10):
    good = [(i, tuple(int(np.floor(1024 * c)) for c in x)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()]
    out = []
    for q, a in sorted(set(good)):
        if q % 100:
            continue
        found = sorted((-sum(s * t for s, t in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


def test_top_products_equal_all_pairs(vectors):
    rows = vectors_around(3, 450) + [(700 + i, [2.0] * 8) for i in range(30)] + [(901, [1.5, -1.0]), (300, [1e4] * 8)]
    rows += [(705, [2.0] * 8)] * 3 + [rows[400]] * 2 + [(706, [3.0] * 8)] + [rows[7]] * 20  # repeated rows and ids
    frame = vectors(rows + ODD)
    for block in (8192, 32):
        got = top_products.top_products(frame.where("NOT (vec_id = 300 AND embedding[0] < 1000)"), "vec_id % 100 = 0", block=block).collect()
        want = products_brute([r for r in rows if r[0] != 300 or r[1][0] > 1000])
        assert sorted(map(tuple, got)) == sorted(want)


def test_few_and_no_rows(vectors):
    some = vectors([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])])
    assert [tuple(r) for r in top_products.top_products(some, "vec_id % 100 = 0").orderBy("rank").collect()] == [(0, 1, 1, 5 * 1024**2), (0, 2, 2, 0)]
    empty = vectors([]).limit(0)
    assert top_products.top_products(empty, "vec_id % 100 = 0").count() == 0
    assert near_vectors.near_duplicates(empty).count() == 0
    bad = vectors(ODD)
    assert top_products.top_products(bad.where("vec_id IS NOT NULL"), "vec_id % 100 = 0").count() == 0
    assert near_vectors.near_duplicates(bad).where("n_links > 0").count() == 0


def test_scores_beyond_double_precision(vectors):
    rows = [(0, [3e8, 7e8]), (1, [5e8, 1e8]), (2, [5e8, 1e8]), (3, [1e8, 9e8])]
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in rows]
    got = {(r.vec_id, r.score) for r in top_products.top_products(vectors(rows), "vec_id % 100 = 0").collect()}
    top = 2**63 - 1
    assert got == {(i, min(top, s)) for _, _, i, s in products_brute(rows)}
