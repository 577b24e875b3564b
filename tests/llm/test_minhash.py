import random

import brute_dedup
import pytest

from threadloom.llm import minhash
from threadloom.llm.components import components


def answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_families_of_copies(documents):
    """A tree of copies around the threshold, exact copies, and a passage that many share."""
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(150):
        kind = i % 3
        if kind == 0:  # mutated copies of one text
            text = [w if pick.random() > i / 3000 else word() for w in base]
        elif kind == 1:  # shared passage, own rest
            text = passage + [word() for _ in range(pick.choice([10, 20, 60]))]
        else:
            text = base if i % 2 else [w.upper() for w in base]
        rows.append((i * 7 % 151, " ".join(text), "en"))
    got = answers(minhash.near_duplicates(documents(rows)))
    assert got == brute_dedup.components([r[:2] for r in rows])


def test_repeated_rows_keep_their_links(documents):
    """Pairs around the threshold whose rows are repeated, and ids with two texts."""
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(90):
        rows += [(i, " ".join(passage + [word() for _ in range(8 + i % 5)]), "en")] * (1 + i % 4)
    for i in range(100, 130, 3):  # i + 2 has a text near that of i and one near that of i + 1
        a, b = ([word() for _ in range(104)] for _ in range(2))
        a2, b2 = ([*x[:40], word(), *x[41:60], word(), *x[61:]] for x in (a, b))
        rows += [(i + 2, " ".join(a2), "de"), (i + 2, " ".join(b2), "de"), (i, " ".join(a), "de"), (i + 1, " ".join(b), "de")] * 3
    found = minhash.near_duplicates(documents(rows)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in brute_dedup.components([r[:2] for r in rows]).items()}


def test_one_set_of_each_class(documents, monkeypatch):
    """What is confirmed and what the prefix filter ranks has one row for each distinct set."""
    seen = []
    plain = minhash._confirm
    monkeypatch.setattr(minhash, "_confirm", lambda pairs, sets: seen.append(sets) or plain(pairs, sets))
    words = [f"w{i}" for i in range(104)]
    near = [*words[:40], "x", *words[41:]]
    minhash.near_duplicates(documents([(1, " ".join(words), None)] * 5 + [(2, " ".join(near), None)] * 5 + [(2, " ".join(words[:-1]), None)])).collect()
    assert seen and {(r.n, r.d) for s in seen for r in s.selectExpr("count(*) AS n", "count(DISTINCT rep) AS d").collect()} == {(3, 3)}


def test_odd_rows(odd, none, documents):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (6, 1, 6, True)} <= rows
    assert any(r[0] is None and r[2] is None and r[3] for r in rows)
    assert minhash.near_duplicates(odd).count() == odd.count()
    assert minhash.near_duplicates(none).count() == 0
    # a repeated id with two texts joins both
    a, b = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    got = minhash.near_duplicates(documents([(9, a, None), (9, b, None), (3, a, None), (4, b, None)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(9, 3), (3, 3), (4, 3)}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(1, 60)], [(0, i) for i in range(1, 30)], [(5, 5)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
