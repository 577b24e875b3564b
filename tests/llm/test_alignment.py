import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from threadloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def plain(rows, aligner):
    """Groups and links from byte spans, two tokens at a time."""
    texts = []
    for doc, text in rows:
        a, b = aligner.encode([text]) if text else ([[]], [[]])
        if not aligner.spell(a[0], b[0], (" " + (text or "")).encode()):
            a, b = [[]], [[]]
        x, y = spans(a[0], aligner.a_bytes), spans(b[0], aligner.b_bytes)
        links, j = [], 0
        for s, e, i in x:
            while j < len(y) and y[j][1] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][0] < e:
                links.append((i, y[k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for _, e, i in x if low < e <= c) + "|" + ",".join(str(i) for _, e, i in y if low < e <= c))
            low = c
        texts.append((doc, len(x), len(y), links, groups))
    count = Counter(p for *_, links, _ in texts for p in set(links))
    highest = {}
    for (i, _), n in count.items():
        highest[i] = max(highest.get(i, 0), n)
    out = []
    for doc, n_a, n_b, links, groups in texts:
        name = ";".join(groups)
        best = sum(count[p] == highest[p[0]] for p in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(name.encode()).hexdigest() if name else ""))
    return out, count


TEXTS = [
    "hello  world", "a\nb", "▁x <s> <|endoftext|>", " lead", "日本 ​", "\x00a", "a b", "ﬁ é é", "\t\ttab", "xxx     ",
    None, "", " ", "banana bananas ananas anana", "ab ab abab aabb " * 50, "Straße und über", "\U0001f600\U0001f601 ok", "x" * 3000, "wordswithoutanyblank" * 200,
]


def listed(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_equal_to_byte_spans(documents, aligner, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[0]), (900, TEXTS[13]), (901, TEXTS[13])]
    want, count = plain(rows, aligner)
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    assert any(r[1] == 0 and r[0] == 2 for r in want)  # the text has a U+2581 of its own
    frame = documents([(i, t, "en") for i, t in rows])
    for size, parts, cached in ((2_000_000, 1, 1000), (60, 3, 5)):
        monkeypatch.setattr(alignment, "BLOCK", size)
        monkeypatch.setattr(alignment, "CACHED", cached)
        monkeypatch.setattr(alignment, "TOGETHER", cached)
        found = alignment.align(frame.repartition(parts), A, B, keep_groups=True)
        assert listed(found.documents) == want
        assert {(r.a_id, r.b_id): r.n_docs for r in found.pairs.collect()} == dict(count)
    for r in found.documents.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_whole_table(spark, aligner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    want, _ = plain([(r.doc_id, r.text) for r in docs.collect()], aligner)
    assert listed(alignment.align(docs, A, B).documents) == sorted(want)


def test_pairs_of_same_bytes_off_their_place(aligner):
    """A link of ids with the same bytes whose tokens do not cover the same place counts with the others of its kind."""
    a_size, b_size = np.array([1, 2, 1]), np.array([1, 2, 1])
    # bytes xyxy: A cuts x|yx|y, B cuts xy|xy
    links = alignment.link(np.array([3]), np.array([0, 1, 2]), np.array([2]), np.array([1, 1]), a_size, b_size)
    assert list(zip(links.a.tolist(), links.b.tolist(), strict=True)) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert (links.n_groups.tolist(), links.n_links.tolist()) == ([1], [4])
    assert alignment.group_strings(links, aligner.names[:6] + [f"{i}{e}" for i in range(3) for e in ",;\n"]) == ["0,1,2|1,1"]


def test_cut_texts_are_encoded_as_whole_ones(aligner):
    texts = [t for t in TEXTS if t] + [" a  b \n c\x1cd\x85e f", "x\u00a0y z  ", "\n\n a", "don't 'll we've  's", "1 2 33 444", "a \u2581 b"]
    assert aligner.cuts
    for text in texts:
        a, b = aligner.encode([text])
        if aligner.spell(a[0], b[0], (" " + text).encode()):
            x, y = aligner.encode(aligner.cut(text))
            assert a[0] == [i for p in x for i in p] and b[0] == [i for p in y for i in p]


def test_whole_texts_where_cuts_are_not_safe(documents, monkeypatch):
    monkeypatch.setattr(alignment.Aligner, "forget", lambda self, forget=alignment.Aligner.forget: (setattr(self, "cuts", False), forget(self)) and None)
    whole = alignment.Aligner(A, B)
    assert whole.cut("a b c") == ["a b c"]
    counts, names, doc, pair = whole.block(["a b c", None, "a b c"])
    monkeypatch.undo()
    again = alignment.Aligner(A, B).block(["a b c", None, "a b c"])
    assert (counts == again[0]).all() and names == again[1] and (doc == again[2]).all() and (pair == again[3]).all()


def test_identity_map():
    same = alignment.identity_map([b"a", b"bc", b"d"], [b"bc", b"a", b"x", b"a"], [False, True, False, False])
    assert same.tolist() == [3, 0, -1]


def test_byte_letters(aligner):
    letters = alignment.byte_letters()
    assert sorted(letters.values()) == list(range(256))
    assert b"".join(aligner.a_bytes[i] for i in aligner.a.encode("é \n\x00", add_special_tokens=False).ids) == "é \n\x00".encode()


def test_packed_arrays():
    arrays = [np.array([3, 1]), np.array([], np.int64), np.array([2**31 - 1])]
    assert all((x == y).all() for x, y in zip(alignment.unpack(alignment.pack(*arrays), 3), arrays, strict=True))


def test_odd_rows(odd, none):
    assert alignment.align(odd, A, B).documents.count() == odd.count()
    assert alignment.align(none, A, B).documents.count() == 0


def test_long_run(documents):
    run = "".join(chr(97 + i * i * 7 % 26) for i in range(200_000))
    (r,) = alignment.align(documents([(1, run, "en")]), A, B).documents.collect()
    assert r.n_a > 20_000 and r.n_groups > 0
