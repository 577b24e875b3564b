"""Toxicity of texts whose words may be disguised: noisy-channel decoding, then word evidence.

1. A character language model (trigrams of letters, all texts counted) tells which letter
   sequences are likely.
2. Spans that may be disguised, found character by character in whole texts (tokens with a letter and a
   sign or with a doubled letter; three or more single letters with one to three separators between),
   become lattices: a sign may stand for letters, a separator or a repeated letter for nothing.
   Viterbi finds the restored text of least channel cost minus log-probability under the model.
3. Words and word beginnings that are much more frequent in toxic texts than in others are the
   evidence; a text's score is a logistic function of its strongest words and of their number, plain
   and restored.

Counting is distributed; to the driver and to the tasks go the model's table (``SYMBOLS ** 3``
numbers), the hashes of the words of evidence, which are bounded by the words of ``FIT_ROWS`` texts, and
at most ``FIT_ROWS`` rows of three numbers for the logistic fit.

Defined results: null and empty texts have no evidence and get the score of such texts; without
labels of both kinds every score is the share of toxic labels (0 without any). Repeated rows are scored
one by one; rows without ``doc_id`` are scored, never learned from; an empty table gives no rows. A very long text, or
one unbroken run of letters, takes time and memory in proportion to its length (Viterbi is linear). Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import cut

from .blocks import blocks, extended, small_batches, tidy
from .text_bytes import Words, lower_bytes

FIT_ROWS = 20_000
PREFIXES = (4, 5, 6)
#: A word of evidence occurs in this share of the toxic texts and in three of them at least.
LEAST_SHARE = 0.002
LEAST_ODDS = 2.5
#: And is as surprising there as three or four texts of a kind that has a twelfth of the labels (G squared).
LEAST_SURPRISE = 15.0

#: Letters that a sign commonly stands for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*,/~'\""
#: Signs that end or begin a word as punctuation, too.
MARKS = "!¡(<|"

#: Symbols of the model: 0 a word's edge, 1-26 the letters, then other letters by code.
SYMBOLS = 48
#: Channel costs (negative log-probabilities).
READ_SIGN, DROP_SIGN, DROP_REPEAT, DROP_DOUBLE, DROP_SEPARATOR, KEEP_SEPARATOR, OTHER = 0.5, 8.0, 0.3, 4.0, 0.3, 3.0, 4.0


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (SYMBOLS - 27) if c.isalpha() else 0


def _symbol_table() -> np.ndarray:
    return np.array([symbol(chr(i).lower()[:1]) for i in range(0x250)], np.uint8)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts of ``docs(text)``; runs of other characters are one edge."""

    def task(batches):
        table = _symbol_table()
        total = np.zeros(SYMBOLS**3, np.int64)
        for part in blocks(batches, "text", 1_000_000):
            chars = np.frombuffer("\n".join(x for x in part["text"].to_pylist() if x).encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.where(chars < len(table), table[np.minimum(chars, len(table) - 1)], 27 + chars % (SYMBOLS - 27)).astype(np.int32)
            s = np.concatenate(([0, 0], s[(s != 0) | np.append(True, s[:-1] != 0)], [0])) if len(s) else s
            if len(s):
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    out = np.zeros(SYMBOLS**3)
    for r in docs.select("text").mapInArrow(tidy(task), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a symbol after two others, interpolated with shorter contexts."""
    one = counts.sum(axis=(0, 1)) + 1
    two = counts.sum(axis=0) + 20 * one / one.sum()
    two /= two.sum(axis=1, keepdims=True)
    three = counts + 20 * two
    return np.log(three / three.sum(axis=2, keepdims=True)).astype(np.float32)


def choices(text: str, at: int) -> list[tuple[str, float]]:
    """What the character at a place may stand for, with costs; text is in lower case."""
    c = text[at]
    if c.isalpha():
        if at == 0 or text[at - 1] != c:
            return [(c, 0.0)]
        run = text[at : at + 1] == text[at + 1 : at + 2] or at > 1 and text[at - 2] == c
        return [(c, 0.0), ("", DROP_REPEAT if run else DROP_DOUBLE)]
    out = [(x, READ_SIGN) for x in SIGNS.get(c, "")]
    if c in SEPARATORS:
        return [*out, ("", DROP_SEPARATOR), (" ", KEEP_SEPARATOR)]
    if c in MARKS and any(not x or x in MARKS or x in SEPARATORS for x in (text[max(at - 1, 0) : at], text[at + 1 : at + 2])):
        return [*out, ("", DROP_SIGN), (" ", KEEP_SEPARATOR)]
    return [*out, ("", DROP_SIGN if out else OTHER), (" ", DROP_SIGN if out else OTHER)]


def restore(text: str, model: np.ndarray) -> str:
    """The likeliest text behind a span: Viterbi over its lattice, states are the last two symbols."""
    text = text.lower()
    states = {(0, 0): (0.0, None)}  # cost and a chain of characters, last first
    for at in range(len(text)):
        nxt: dict = {}
        for char, price in choices(text, at):
            s = symbol(char) if char else -1
            for (a, b), (cost, chain) in states.items():
                if s < 0:
                    key, c, tail = (a, b), cost + price, chain
                elif s == 0 and b == 0:
                    key, c, tail = (a, b), cost + price, (char, chain)
                else:
                    key, c, tail = (b, s), cost + price - float(model[a, b, s]), (char, chain)
                if key not in nxt or c < nxt[key][0]:
                    nxt[key] = (c, tail)
        states = nxt
    chain = min((cost - float(model[a, b, 0]), n, chain) for n, ((a, b), (cost, chain)) in enumerate(states.items()))[2]
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return "".join(reversed(out))


_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
_SIGN, _BREAK = np.zeros(0x10000, bool), np.zeros(0x10000, bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_BREAK[[ord(c) for c in SEPARATORS]] = True
#: A chain of single letters has so many of them at least, with so many separators between two at most.
CHAIN, GAP = 3, 3


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes begins, and its code; those beyond the basic plane are letters
    but for pictures (0x1F000 to 0x1FFFF), which have the code 0."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    more = np.flatnonzero(code >= 128)
    if len(more):
        tail = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        b, x, y, z = code[more], *(tail[at[more] + k] & 63 for k in (1, 2, 3))
        far = (b & 7) << 18 | x << 12 | y << 6 | z
        code[more] = np.where(b < 0xE0, (b & 31) << 6 | x, np.where(b < 0xF0, (b & 15) << 12 | x << 6 | y, np.where((far >= 0x1F000) & (far < 0x20000), 0, far)))
    return at, code


def disguised(texts: pa.Array) -> list[tuple[int, str]]:
    """(text number, span in lower case) of the spans that may be disguised words: tokens with a letter and
    a sign or with a doubled letter, and chains of single letters."""
    data, offsets = lower_bytes(texts)
    if len(data) < 2:
        return []
    at, code = _characters(data)
    n, offsets = len(at), np.searchsorted(at, offsets)
    near = np.minimum(code, 0xFFFF)
    letter, sign, gap = _LETTER[near] | (code > 0xFFFF), _SIGN[near], _BREAK[near]
    word = ~((code == 32) | ((code >= 9) & (code <= 13)))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    double = letter & ~first[:-1]
    double[1:] &= code[1:] == code[:-1]
    double[0] = False

    def before(x):
        return np.append(np.int64(0), np.cumsum(x))

    starts = np.flatnonzero(word & (first[:-1] | ~np.append(False, word[:-1])))
    ends = np.flatnonzero(word & (first[1:] | ~np.append(word[1:], False))) + 1
    letters, signs, doubles = (x[ends] - x[starts] > 0 for x in map(before, (letter, sign, double)))
    some = np.flatnonzero(letters & signs | doubles)
    begins, stops = starts[some], ends[some]
    # a letter or sign with none beside it, 1 to GAP separators, another one, ...
    single = letter | sign
    alone = np.flatnonzero(single & (first[:-1] | ~np.append(False, single[:-1])) & (first[1:] | ~np.append(single[1:], False)))
    if len(alone) >= CHAIN:
        x, y, gaps, texts_before = alone[:-1], alone[1:], before(gap), before(first[:-1])
        linked = (y - x <= GAP + 1) & (gaps[y] - gaps[x + 1] == y - x - 1) & (texts_before[y + 1] == texts_before[x + 1])
        head = np.flatnonzero(np.append(True, ~linked))
        last = np.append(head[1:], len(alone)) - 1
        long = last - head + 1 >= CHAIN
        begins, stops = np.append(begins, alone[head[long]]), np.append(stops, alone[last[long]] + 1)
    doc = np.searchsorted(offsets, begins, side="right") - 1
    raw, at = data.tobytes(), np.append(at, len(data))
    return [(d, raw[a:b].decode("utf-8", "ignore")) for d, a, b in zip(doc.tolist(), at[begins].tolist(), at[stops].tolist(), strict=True)]


@dataclass
class ToxicityModel:
    model: np.ndarray
    hashes: np.ndarray  # sorted
    odds: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    cache: dict = field(default_factory=dict)

    def restored(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Spans of the texts that are restored to something else, and of which text each is."""
        if len(self.cache) > 100_000:
            self.cache.clear()
        of, out = [], []
        for d, span in disguised(texts):
            if span not in self.cache:
                found = restore(span, self.model)
                self.cache[span] = None if found == span else found
            if self.cache[span] is not None:
                of.append(d)
                out.append(self.cache[span])
        return np.array(of, np.int64), pa.array(out, pa.string())

    def _hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, word hash and odds of each word with evidence, the word's strongest."""
        words = Words(*lower_bytes(texts))
        best = np.zeros(len(words.starts))
        name = np.zeros(len(words.starts), np.uint64)
        for length in (None, *PREFIXES):
            at, h = words.hashes(length)
            place = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
            good = self.hashes[place] == h if len(self.hashes) else np.zeros(len(h), bool)
            at, value = at[good], self.odds[place[good]]
            better = value > best[at]
            best[at[better]], name[at[better]] = value[better], h[good][better]
        some = np.flatnonzero(best)
        return words.doc[some], name[some], best[some]

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For each text the strongest odds, the sum of the three strongest, and the log-number of
        distinct words with evidence, those of restored spans included."""
        doc, name, odds = self._hits(texts)
        of, spans = self.restored(texts)
        if len(spans):
            d, m, o = self._hits(spans)
            doc, name, odds = np.append(doc, of[d]), np.append(name, m), np.append(odds, o)
        out = np.zeros((len(texts), 3))
        if len(doc):
            order = np.lexsort((name, doc))
            doc, name, odds = doc[order], name[order], odds[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]))
            doc, odds = doc[new], odds[new]
            order = np.lexsort((-odds, doc))
            doc, odds = doc[order], odds[order]
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            np.add.at(out[:, 1], doc[place < 3], odds[place < 3])
            out[doc[place == 0], 0] = odds[place == 0]
            out[:, 2] = np.log1p(np.bincount(doc, minlength=len(texts)))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = np.column_stack((np.ones(len(evidence)), evidence / self.scale)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(batches):
    """Counts in how many texts each word and beginning occurs."""
    hashes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for part in blocks(batches, "text", 1_000_000):
        words = Words(*lower_bytes(part["text"]))
        doc, h = [], []
        for length in (None, *PREFIXES):
            at, x = words.hashes(length)
            doc.append(words.doc[at])
            h.append(x)
        doc, h = np.concatenate(doc), np.concatenate(h)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(doc)]
        hashes, where = np.unique(np.append(hashes, h[new]), return_inverse=True)
        counts = np.bincount(where, np.append(counts, np.ones(int(new.sum())))).astype(np.int64)
        if len(hashes) > 1_000_000:
            yield pa.RecordBatch.from_pydict({"h": hashes.view(np.int64), "n": counts})
            hashes, counts = hashes[:0], counts[:0]
    yield pa.RecordBatch.from_pydict({"h": hashes.view(np.int64), "n": counts})


def _evidence(rows: DataFrame, bad: int, good: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and odds of all words and beginnings that pass, of ``bad`` and ``good`` labelled texts."""

    def counted(label, name):
        found = rows.where(F.col("label") == label).select("text").mapInArrow(tidy(_features), "h long, n long")
        return found.groupBy("h").agg(F.sum("n").alias(name))

    def surprise(k, m):  # k of m texts where the share is expected
        k = F.greatest(F.lit(1e-9), F.least(F.col(k).cast("double"), F.lit(m - 1e-9)))
        return k * F.log(k / (F.col("share") * m)) + (m - k) * F.log((m - k) / F.greatest((1 - F.col("share")) * m, F.lit(1e-9)))

    least = max(3, int(np.ceil(LEAST_SHARE * bad)))
    both = counted(1, "t").where(F.col("t") >= least).join(counted(0, "c"), "h", "left").fillna(0, ["c"])
    both = both.withColumn("odds", F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1)))
    both = both.where(F.col("odds") >= LEAST_ODDS).withColumn("share", (F.col("t") + F.col("c")) / (bad + good))
    found = both.where(2 * (surprise("t", bad) + surprise("c", good)) >= LEAST_SURPRISE).select("h", "odds").toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found["odds"].to_numpy()[order]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """``text, label`` of at most ``most`` labelled documents, the same for the same tables: those
    whose ids have the least hashes. Each id and each text counts once."""
    some = labels.where(f"{column} IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(column).alias("label"))
    # what is sorted is bounded too: about 1.2 x most ids pass by hash
    share = min(1.0, 1.2 * most / max(some.count(), 1))
    some = some.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], int(r["label"])) for r in some.collect()], "doc_id long, label int")  # at most ``most`` rows
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    return cut(found.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label"))


def fit(docs: DataFrame, rows: DataFrame) -> ToxicityModel:
    """The model from all texts of ``docs(text)`` and from the labelled ``rows(text, label)``."""
    model = log_model(count_trigrams(docs))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    empty = np.empty(0)
    if not bad or not good:
        z = 30.0 if bad else -30.0
        return ToxicityModel(model, np.empty(0, np.uint64), empty, np.array([z, 0, 0, 0]), np.ones(3))

    found = ToxicityModel(model, *_evidence(rows, bad, good), np.zeros(4), np.ones(3))

    def evidence(batches):
        for part in blocks(batches, "text", 1_000_000):
            e = found.evidence(part["text"])
            yield pa.RecordBatch.from_pydict({"a": e[:, 0], "b": e[:, 1], "c": e[:, 2], "label": part["label"]})

    table = rows.mapInArrow(evidence, "a double, b double, c double, label int").toPandas()  # at most FIT_ROWS rows
    e = table[["a", "b", "c"]].to_numpy()
    found.scale = np.maximum(e.std(axis=0), 1e-9)
    found.weights = logistic(np.column_stack((np.ones(len(e)), e / found.scale)), table["label"].to_numpy(np.float64))
    return found


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` with the ``score`` of the column ``text``."""
    small_batches(docs.sparkSession)
    columns = list(keep)
    fields = extended(docs.select(*columns).schema, [("score", T.DoubleType())])

    def task(batches):
        for part in blocks(batches, "text", 1_000_000):
            found = model.score(model.evidence(part["text"]))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(found)], [*columns, "score"])

    return docs.select(*(columns if "text" in columns else [*columns, "text"])).mapInArrow(tidy(task), fields)
