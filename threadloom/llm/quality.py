"""Quality by a sparse ensemble of rules over text statistics.

Trees are grown on labelled rows; every path from a root becomes a rule, a conjunction of bounds on
statistics. A logistic regression with lasso penalty chooses rules and their weights, and what it
keeps is one Spark column expression over the statistics, so scoring runs no model code.

The statistics of a text are counted byte by byte over the whole text. At most ``FIT_ROWS`` labelled
rows are learned from.

Defined results: null text is the empty text, whose statistics are all 0; without labels of both
kinds every score is the only label (0.5 without any). Repeated rows are scored one by one; rows without
``doc_id`` are scored, never learned from. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import cut

from .blocks import blocks, extended
from .text_bytes import Words, lower_bytes, raw_bytes, sums
from .toxicity import labelled_rows  # noqa: F401  the same bounded choice of rows

FIT_ROWS = 20_000
TREES, DEPTH = 24, 3
LASSO = 0.001

STATISTICS = [
    "bytes", "words", "word_length", "upper", "digits", "spaces", "stops", "signs", "exclaims", "bars", "line_length",
    "repeats", "distinct", "longest",
]

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 10, 13]] = 3
_KIND[[ord(c) for c in ".,;:?"]] = 4
_KIND[[ord(c) for c in "#$%&*@+=<>/\\^_~`{}[]()\"'-"]] = 5
_KIND[ord("!")] = 6
_KIND[ord("|")] = 7


def measure(texts: pa.Array) -> np.ndarray:
    """The statistics of each text, in the order of ``STATISTICS``."""
    data, offsets = raw_bytes(texts)
    n = np.diff(offsets).astype(np.float64)
    kind = _KIND[data]
    share = {k: sums((kind == k).astype(np.uint8), offsets) / np.maximum(n, 1) for k in range(1, 8)}
    accented = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E)
    upper = share[1] + sums(accented.astype(np.uint8), offsets) / np.maximum(n, 1)
    lines = sums((data == 10).astype(np.uint8), offsets) + 1
    low, bounds = lower_bytes(texts)
    words = Words(low, bounds)
    _, h = words.hashes()
    size, doc = words.ends - words.starts, words.doc
    count = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    again = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))[: len(doc)]
    longest = np.zeros(len(texts))
    np.maximum.at(longest, doc, size)
    order = np.lexsort((h, doc))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(doc)]
    some = np.maximum(count, 1)
    return np.column_stack((
        n, count, np.bincount(doc, size, len(texts)) / some, upper, share[2], share[3], share[4], share[5], share[6], share[7], n / lines,
        np.bincount(doc, again, len(texts)) / some, np.bincount(doc[order], new, len(texts)) / some, longest,
    ))


def statistics(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` with the statistics of the column ``text``."""
    columns = list(keep)
    fields = extended(docs.select(*columns).schema, [(x, T.DoubleType()) for x in STATISTICS])

    def task(batches):
        for part in blocks(batches, "text", 2_000_000):
            found = measure(part["text"])
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), *map(pa.array, found.T.copy())], [*columns, *STATISTICS])

    return docs.select(*columns, "text").mapInArrow(task, fields)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, "<=" or ">", bound)."""

    bounds: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, bound in self.bounds:
            out = out & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
        return out.cast("double")


def tree_rules(text: str) -> list[Rule]:
    """The rules of all paths in a printed tree ensemble, each once."""
    found, path = {}, []
    for line in text.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            level = len(m[1])
            path = [p for p in path if p[0] < level] + [(level, STATISTICS[int(m[2])], m[3], float(m[4]))]
            narrow: dict = {}
            for _, name, sign, bound in path:  # the tightest bound of each kind
                old = narrow.get((name, sign))
                narrow[name, sign] = bound if old is None else (min if sign == "<=" else max)(old, bound)
            found[Rule(tuple(sorted((n, s, b) for (n, s), b in narrow.items())))] = None
        elif "Tree" in line:
            path = []
    return list(found)


@dataclass
class QualityModel:
    rules: list[tuple[Rule, float]]
    base: float

    def score(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + rule.column() * weight
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> QualityModel:
    """The model of labelled ``rows(text, label)``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = cut(statistics(rows, ["label"]).withColumn("label", F.col("label").cast("double")).repartition(4, *STATISTICS[:4]))
    share = data.agg(F.avg("label")).first()[0]
    if share in (None, 0.0, 1.0):
        return QualityModel([], {None: 0.0, 0.0: -30.0, 1.0: 30.0}[share])
    data = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(data).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, subsamplingRate=0.7, seed=1).fit(data)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return QualityModel([], float(np.log(share / (1 - share))))
    names = [f"rule{i}" for i in range(len(rules))]
    table = data.select("label", *(r.column().alias(n) for n, r in zip(names, rules, strict=True)))
    table = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("label", "features")
    found = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(table)
    data.unpersist()
    weights = found.coefficients.toArray()
    return QualityModel([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], float(found.intercept))


def score(docs: DataFrame, model: QualityModel, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` with the ``score`` of the column ``text``."""
    return statistics(docs, keep).select(*keep, model.score().alias("score"))
