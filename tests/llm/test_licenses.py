import re

import pytest

from threadloom.llm import licenses
from threadloom.llm.licenses import evaluate, to_postfix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda c: c.group().lower(), text or "")


def plain_places(text, phrases):
    """(first word, phrase) of every place, word by word."""
    words = WORD.findall(lower(text))
    return len(words), sorted((i, p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def plain_notices(text, notices):
    """Places of the longest notices, left to right, none inside another."""
    found = plain_places(text, notices)[1]
    longest = {}
    for i, p in found:
        if len(p.split()) > len(longest.get(i, "").split()):
            longest[i] = p
    out, reach = [], -1
    for i in sorted(longest):
        if i + len(longest[i].split()) > reach:
            out.append((i, longest[i]))
            reach = i + len(longest[i].split())
    return out


TEXTS = [
    "Released UNDER the MIT-License; under the mit license. Apache License, Version 2.0!",
    "apache license version 2 cc by nc cc-by-nc cc by cc by nc",
    "under the mit licenses under themit license üunder the mit license",
    "Creative Commons Attribution-NonCommercial, creative commons attribution and GNU General Public License version 3",
    "under the mit license ß cc\tby\nnc",
    "permission is hereby granted free of charge to any person obtaining a copy all rights reserved",
    None, "", " \n\t", "?!", "x" * 200_000, "cc by nc " * 20_000, "under the mit " * 10_000 + "license",
]


def test_places_equal_a_plain_search(documents):
    rows = documents([(i, t, "en") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en"), (None, TEXTS[0], "en")])
    got = {}
    for r in licenses.places(rows).collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.first_word, r.label, r.n_words))
    found = licenses.scan(rows).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = TEXTS[r.doc_id or 0]
        n, base = plain_places(text, licenses.BASE)
        notices = plain_notices(text, licenses.NOTICES)
        times = 2 if r.doc_id == 0 else 1
        want = [("base", i, licenses.BASE[p], len(p.split())) for i, p in base] + [("notice", i, licenses.NOTICES[p], len(p.split())) for i, p in notices]
        assert sorted(got.get(r.doc_id, [])) == sorted(want * times)
        labels = sorted({licenses.BASE[p] for _, p in base} | {licenses.NOTICES[p] for _, p in notices})
        first, last = (base[0][0], base[-1][0]) if base else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), first, last)
        assert r.base_labels == ",".join(sorted({licenses.BASE[p] for _, p in base})) and r.labels == ",".join(labels)
        assert r.score == min((licenses.FREEDOM[x] for x in labels), default=0.0)


def test_whole_tables(spark):
    """Every document of the small tables against the plain search."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in rows.collect()}
    for r in licenses.scan(rows).collect():
        n, base = plain_places(text[r.doc_id], licenses.BASE)
        assert (r.n_words, r.n_base) == (n, len(base))
        assert r.base_labels == ",".join(sorted({licenses.BASE[p] for _, p in base}))


#: Expression, postfix, labels named, labels that bind, freedom.
EXPRESSIONS = [
    ("mit", "mit", "mit", "mit", 1.0),
    ("mit or gpl-3.0-only and isc", "mit gpl-3.0-only isc and or", "gpl-3 isc mit", "mit", 1.0),
    ("(mit or gpl-2.0) and isc", "mit gpl-2.0 or isc and", "gpl-2 isc mit", "isc mit", 1.0),
    ("gpl-2.0+ with classpath-exception-2.0 and agpl-3.0", "gpl-2.0+ classpath-exception-2.0 with agpl-3.0 and", "agpl-3 gpl-2", "agpl-3 gpl-2", 0.3),
    ("gpl-2.0 with classpath-exception-2.0", "gpl-2.0 classpath-exception-2.0 with", "gpl-2", "gpl-2", licenses.LIFT),
    ("isc or mit", "isc mit or", "isc mit", "isc", 1.0),
    ("cc-by-nc-4.0 and cc0-1.0", "cc-by-nc-4.0 cc0-1.0 and", "cc-by-nc cc0", "cc-by-nc cc0", 0.15),
    ("bsd-3-clause and bsd-2-clause", "bsd-3-clause bsd-2-clause and", "bsd", "bsd", 1.0),
    ("mit or", "mit", "mit", "mit", 1.0),
    ("mit and (", "mit", "mit", "mit", 1.0),
    ("((mit) or (apache-2.0", "mit apache-2.0 or", "apache-2 mit", "mit", 1.0),
    ("mit) and gpl-3.0", "mit", "mit", "mit", 1.0),
    ("mit gpl-3.0", "mit", "mit", "mit", 1.0),
    ("mit, gpl-3.0", "mit", "mit", "mit", 1.0),
    ("mit and\ngpl-3.0", "mit", "mit", "mit", 1.0),
    ("licenseref-own", "licenseref-own", "licenseref-own", "licenseref-own", licenses.UNKNOWN),
]


@pytest.mark.parametrize("text,postfix,named,bind,freedom", EXPRESSIONS)
def test_expressions(text, postfix, named, bind, freedom):
    assert to_postfix(text) == postfix.split()
    value = evaluate(text)
    assert (sorted(value.named), sorted(value.bind), value.freedom) == (named.split(), bind.split(), freedom)


@pytest.mark.parametrize("text", ["", "and mit", "or", "()", ")", "-- mit", "\nmit"])
def test_no_expression(text):
    assert evaluate(text) is None


def test_precedence_against_brackets():
    """Random trees, written with the fewest brackets, come back as the same postfix order."""
    import random

    pick = random.Random(5)

    def tree(depth):
        if depth == 0 or pick.random() < 0.3:
            return pick.choice(["mit", "isc", "gpl-3.0", "agpl-3.0"])
        return (pick.choice(["and", "or"]), tree(depth - 1), tree(depth - 1))

    def write(t, right=False, above=0):
        if isinstance(t, str):
            return t
        level = licenses._BINDS[t[0]]
        text = f"{write(t[1], False, level)} {t[0]} {write(t[2], True, level)}"
        return f"({text})" if level < above or level == above and right else text

    def postfix(t):
        return [t] if isinstance(t, str) else [*postfix(t[1]), *postfix(t[2]), t[0]]

    for _ in range(500):
        t = tree(4)
        assert to_postfix(write(t)) == postfix(t)


def test_tags_are_read(documents):
    rows = documents([
        (1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC */\nnext line OR AGPL-3.0", "en"),
        (2, "License-Expression: Apache-2.0 WITH LLVM-exception\r\nx", "en"),
        (3, "SPDX-License-Identifier:\nMIT", "en"),
        (4, "spdx-license-identifier: cc-by-nc-4.0 " * 30_000, "en"),
        (5, "a spdx-license-identifier é mit", "en"),
    ])
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert (got[1].labels, got[1].binding, got[1].score, got[1].base_labels) == ("gpl-2,isc,mit", "isc,mit", 1.0, "")
    assert (got[2].labels, got[2].score) == ("apache-2", 0.95)
    assert (got[3].labels, got[3].score) == ("", 0.0)
    assert (got[4].labels, got[4].n_base) == ("cc-by-nc", 30_000)
    assert got[5].labels == ""
    spans = licenses.places(rows).where("kind = 'tag' AND doc_id = 1").collect()
    assert [(s.label, s.first_word, s.n_words, s.binds) for s in spans] == [("gpl-2,isc,mit", 0, 3, ["isc", "mit"])]


def test_odd_rows(odd, none):
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(none).count() == 0 and licenses.places(none).count() == 0
