"""Language identification by error-correcting output codes.

Each language has a codeword. For every bit a binary classifier tells the languages with 1 from those
with 0 by byte trigrams (log-odds of the two groups, hashed to ``BUCKETS``); a text's bit margins
are then compared with all codewords, each bit weighted by how well it separates that language
(loss-weighted decoding), and the codeword of least loss is the answer. Texts for which the two best
codewords are almost as near, or that are far from all, are flagged as ambiguous.

Up to ``EXHAUSTIVE`` languages the code has every split into two groups; for more it is the best
of 64 seeded random codes by least distance. The counts cover all learned texts; only a table of
languages x buckets comes to the driver and goes to the tasks.

Defined results: null texts and texts without a letter are ``und`` with score 1; so is everything, with
score 0, when there is nothing to learn from. Repeated rows are answered one by one; rows without
``doc_id`` are answered but never learned from; an empty table gives no rows. More than ``LANGUAGES``
languages are an error. A very long text, or one unbroken run of letters, takes time and memory in proportion
to its length. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, extended, small_batches, tidy
from .text_bytes import lower_bytes, sums

BUCKETS = 1 << 15
EXHAUSTIVE = 5
LANGUAGES = 1000
MARGIN = 12.0
AMBIGUOUS = 0.02
#: Trigrams that count against a text's own: short texts have small margins.
PRIOR = 10
#: Texts x languages x bits that are compared at once.
SLICE = 4_000_000

#: Digits, punctuation and control characters count as spaces.
_SPACED = np.arange(256, dtype=np.uint32)
_SPACED[[b for b in range(128) if not 97 <= b <= 122]] = 32


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte of the texts (of the spaces after it for the last two), and
    where each text begins and ends. Bucket 0 is that of spaces only."""
    data, offsets = lower_bytes(texts)
    if not len(data):
        return np.empty(0, np.int32), offsets
    b = _SPACED[data]
    second, third = np.append(b[1:], np.uint32(32)), np.append(b[2:], [np.uint32(32)] * min(2, len(b)))
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    second[ends - 1] = third[ends - 1] = 32
    third[(ends - 2)[ends >= 2]] = 32
    code = (b << 16) | (second << 8) | third
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    bucket[code == 0x202020] = 0
    return bucket, offsets


def code_book(n: int) -> np.ndarray:
    """Codewords (rows of +1 and -1) for n languages."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        return np.array([[1 if i == 0 or not split >> (i - 1) & 1 else -1 for split in range(1, 2 ** (n - 1))] for i in range(n)])
    found, far = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1, 1], (n, int(np.ceil(15 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[i + 1 :] != code[i]).sum(axis=1).min()) for i in range(n - 1))
        if apart > far:
            found, far = code, apart
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # buckets x bits, log-odds
    weight: np.ndarray  # languages x bits, rows sum to 1

    def answers(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        none = ~pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        bucket, offsets = grams(texts)
        margin = np.zeros((len(texts), self.code.shape[1]))
        for b in range(margin.shape[1]):
            margin[:, b] = sums(self.odds[:, b][bucket], offsets)
        counted = sums((bucket != 0).astype(np.int64), offsets)
        margin *= (MARGIN / (counted + PRIOR))[:, None]
        loss = np.empty((len(texts), len(self.languages)))
        rows = max(1, SLICE // max(1, self.code.size))
        for a in range(0, len(texts), rows):  # texts x languages x bits at once would grow with the model
            loss[a : a + rows] = (np.logaddexp(0, -margin[a : a + rows, None, :] * self.code) * self.weight).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        near = np.take_along_axis(loss, order[:, :2], axis=1)
        share = np.exp(-8 * (loss - near[:, :1]))
        score = 1 / share.sum(axis=1)
        ambiguous = (near[:, 1] - near[:, 0] < AMBIGUOUS) if len(self.languages) > 1 else np.zeros(len(texts), bool)
        best = [self.languages[i] for i in order[:, 0]]
        return ["und" if n else x for n, x in zip(none, best, strict=True)], np.where(none, 1.0, score), ambiguous & ~none


def fit(rows: DataFrame) -> LanguageModel:
    """The model of ``rows(text, lang)``; rows without language are left out."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for part in blocks(batches, "text"):
            bucket, offsets = grams(part["text"])
            own = np.array([number[x] for x in part["lang"].to_pylist()], np.int64)
            total += np.bincount(np.repeat(own, np.diff(offsets)) * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    counts = np.zeros(len(languages) * BUCKETS)
    for r in rows.mapInArrow(tidy(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["at"]] = r["n"]
    counts = counts.reshape(len(languages), BUCKETS)
    counts[:, 0] = 0  # spaces
    code = code_book(len(languages))
    share = (counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * BUCKETS)
    odds = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        odds[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    odds[0] = 0
    # what a text of the language is expected to have as margin of the bit
    clear = np.maximum((share @ odds) * code, 1e-6)
    return LanguageModel(languages, code, odds, clear / np.maximum(clear.sum(axis=1, keepdims=True), 1e-12))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred, score, ambiguous`` of the column ``text``."""
    small_batches(docs.sparkSession)
    columns = list(keep)
    fields = extended(docs.select(*columns).schema, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())])

    def task(batches):
        for part in blocks(batches, "text", 1_000_000):
            language, score, ambiguous = model.answers(part["text"])
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(language, pa.string()), pa.array(score), pa.array(ambiguous)], [*columns, "lang_pred", "score", "ambiguous"])

    return docs.select(*(columns if "text" in columns else [*columns, "text"])).mapInArrow(tidy(task), fields)
