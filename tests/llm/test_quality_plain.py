"""The quality score against statistics and rules worked out one text at a time."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import quality

TEXTS = [
    "The quick brown fox, the lazy dog! Ünder ÄÖ 12|34", "", None, "   \n\n ", "a a a b b A", "# $ ~~ <x> | y |\nline two.\r\nÉtude é",
    "x" * 100_000, "wort " * 20_000, "漢字 かな one\ttwo; three: four? five!!!", "1234567890", "ß ẞ ÿ Ÿ",
]


def plain(text):
    data = (text or "").encode()
    n, some = len(data), max(len(data), 1)
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    count = lambda chars: sum(data.count(c.encode()) for c in chars) / some
    upper = sum(65 <= b <= 90 for b in data) + sum(data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E for i in range(1, n))
    w = max(len(words), 1)
    return [
        n, len(words), sum(map(len, words)) / w, upper / some, count("0123456789"), count(" \t\n\r"), count(".,;:?"),
        count("#$%&*@+=<>/\\^_~`{}[]()\"'-"), count("!"), count("|"), n / (data.count(b"\n") + 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, len(set(words)) / w, max(map(len, words), default=0),
    ]


def test_statistics():
    got = quality.measure(pa.array(TEXTS, pa.string()))
    for text, row in zip(TEXTS, got, strict=True):
        assert np.allclose(row, plain(text), rtol=1e-12), (text or "")[:40]


def test_scores_are_the_rules_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs.join(labels, "doc_id").selectExpr("text", "CAST(quality AS INT) AS label"))
    assert model.rules
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    text = {r.doc_id: r.text for r in rows.collect()}
    for r in quality.score(rows, model, ["doc_id"]).collect():
        values = dict(zip(quality.STATISTICS, plain(text[r.doc_id]), strict=True))
        held = [w for rule, w in model.rules if all(values[n] <= b if sign == "<=" else values[n] > b for n, sign, b in rule.bounds)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.base + sum(held)))), rel=1e-9)


def test_rules_are_the_paths_of_the_trees():
    printed = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 10.0)
     If (feature 1 > 2.5)
      Predict: 1.0
     Else (feature 1 <= 2.5)
      Predict: 0.0
    Else (feature 0 > 10.0)
     If (feature 0 > 20.0)
      Predict: 0.0
"""
    found = [r.bounds for r in quality.tree_rules(printed)]
    assert found == [
        (("bytes", "<=", 10.0),), (("bytes", "<=", 10.0), ("words", ">", 2.5)), (("bytes", "<=", 10.0), ("words", "<=", 2.5)),
        (("bytes", ">", 10.0),), (("bytes", ">", 20.0),),
    ]
