"""Alignment of two tokenizers' tokens by bytes, with an identity map for what both cut alike.

Both tokenizations of a text cover the same bytes, so their ends are places on one line. Ends that both
share cut the tokens into groups; every end of either one closes exactly one overlap of an A token with a
B token, so the links of a text are the union of the ends, found by a merge of two sorted arrays.

Texts are cut at single blanks, over which neither side has a token, and the links of a piece are found once
for as long as a task remembers it. A vocabulary-length array gives each A id the B id of the same bytes. Links of that kind, all exact
one-to-one groups among them, are counted in vectors of vocabulary length, one a task, that Spark adds up.
Only the other pairs are shuffled: a block of texts (2 MB, or one longer text) sends each of its distinct
pairs once, with the number of its documents that hold it; sums by pair go back to the blocks by a join. A
pair has at most one row for each block, a block thousands of pairs, so no pair is hot. What a second
look needs of a block (its pairs and how often a document holds each) is stored once, compressed. The
driver gets two vectors of vocabulary length: documents of the same-bytes pairs, and the highest count of each A id.

Defined results: null and empty texts, and those whose tokens of either side do not spell a space and the
text, have no tokens: zeros and ''; rows that repeat are documents of their own, rows without id too; where
several B ids have the bytes of an A id, the one that is no byte piece, then the least, is its same. Strings of
special tokens in a text are plain text. An empty table gives no rows; other columns are ignored. A very long
text, and one unbroken run of letters, is a block of its own and takes memory in proportion to its length (some
200 bytes a byte, in the tokenizers).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

from .blocks import blocks, small_batches, tidy

BLOCK = 2_000_000
#: Pieces that a task knows at once.
CACHED = 400_000
#: Pieces that are encoded as one text.
TOGETHER = 500
#: Pairs are numbered a * WIDE + b.
WIDE = 1 << 31


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return out


def a_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer."""
    letters = byte_letters()
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, at in tokenizer.get_vocab(with_added_tokens=True).items():
        out[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def b_bytes(pieces) -> tuple[list[bytes], list[bool]]:
    """The bytes of every id of a piece model, and whether it is a byte piece."""
    out, single = [], []
    for at in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(at)
        single.append(pieces.is_byte(at))
        out.append(bytes([int(piece[3:5], 16)]) if single[-1] else piece.replace("▁", " ").encode())
    return out, single


def identity_map(a: list[bytes], b: list[bytes], single: list[bool]) -> np.ndarray:
    """For each A id the B id of the same bytes, or -1."""
    best: dict[bytes, int] = {}
    for at in sorted(range(len(b)), key=lambda i: (single[i], i)):
        best.setdefault(b[at], at)
    return np.array([best.get(x, -1) for x in a], np.int32)


#: A blank between two other characters: no token of either side reaches over it (see ``Aligner.cut``).
_BLANK = re.compile(r"(?<=\S) (?=\S)")


class Aligner:
    """Two tokenizers, the tables of their ids, and the links of the pieces met so far.

    Of a byte-level pattern such as A's, a single blank between other characters always begins a match. B's model
    never joins over it either, unless some piece has a blank behind another character. So texts are cut
    there, and a piece that comes again is not encoded or aligned again; else a text is one piece."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = a_bytes(self.a)
        self.b_bytes, single = b_bytes(self.b)
        self.same = identity_map(self.a_bytes, self.b_bytes, single)
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.names = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;\n"]
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.strings: list[str] = []
        self.sound = np.empty(0, bool)
        self.counts = np.empty((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.starts = np.zeros(1, np.int64)
        self.codes = np.empty(0, np.int64)

    def cut(self, text: str | None) -> list[str]:
        """The pieces of a text; each stands behind a blank, the first too."""
        if not text:
            return []
        return _BLANK.split(text) if self.cuts else [text]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for each text behind a blank."""
        left = self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False) if texts else []
        return [x.ids for x in left], self.b.encode(texts, num_threads=1) if texts else []

    def spell(self, a: list[int], b: list[int], whole: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole

    def learn(self, pieces: list[str]) -> None:
        """Encodes and aligns pieces. Those with no blank at either end are encoded ``TOGETHER`` as one text: it is cut
        where they meet. What does not spell its text is encoded again alone."""
        ends = [x[0].isspace() or x[-1].isspace() for x in pieces]
        alone = [x for x, e in zip(pieces, ends, strict=True) if e or not self.cuts]
        joined = [x for x, e in zip(pieces, ends, strict=True) if not e] if self.cuts else []
        runs = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for group in (runs, [[x] for x in alone]):
            again = self._add(group)
            if again:
                self._add([[x] for run in again for x in run])

    def _add(self, runs: list[list[str]]) -> list[list[str]]:
        """Adds runs of pieces; returns longer ones that do not spell their text."""
        texts = [" ".join(run) for run in runs]
        a, b = self.encode(texts)
        sound = [self.spell(x, y, (" " + t).encode()) for x, y, t in zip(a, b, texts, strict=True)]
        again = [run for run, good in zip(runs, sound, strict=True) if not good and len(run) > 1]
        for run, good in zip(runs, sound, strict=True):
            if not good and len(run) == 1:  # no links
                self._store(run, False, np.zeros((1, 4), np.int64), np.empty(0, np.int64), [""])
        pieces = [x for run, good in zip(runs, sound, strict=True) if good for x in run]
        if not pieces:
            return again
        ids_a, ids_b = (_flat([x for x, good in zip(side, sound, strict=True) if good]) for side in (a, b))
        stops = np.cumsum([1 + len(x.encode()) for x in pieces])
        n_a, n_b = (np.diff(np.searchsorted(np.cumsum(size[ids]), stops, side="right"), prepend=0) for ids, size in ((ids_a, self.a_size), (ids_b, self.b_size)))
        links = link(n_a, ids_a, n_b, ids_b, self.a_size, self.b_size)
        counts = np.stack([links.n_a, links.n_b, links.n_groups, links.n_links], axis=1)
        self._store(pieces, True, counts, links.a * WIDE + links.b, group_strings(links, self.names))
        return again

    def _store(self, pieces: list[str], sound: bool, counts: np.ndarray, codes: np.ndarray, strings: list[str]) -> None:
        self.number.update(zip(pieces, range(len(self.strings), len(self.strings) + len(pieces)), strict=True))
        self.strings += strings
        self.sound = np.append(self.sound, np.full(len(pieces), sound))
        self.counts = np.concatenate([self.counts, counts])
        self.codes = np.append(self.codes, codes)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(counts[:, 3]))

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text its four counts and its group string; for each link its text and pair."""
        parts = [self.cut(t) for t in texts]
        if len(self.strings) > CACHED or len(self.codes) > 10 * CACHED:
            self.forget()
        if new := list(set().union(*parts) - self.number.keys()):
            self.learn(new)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        piece = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
        doc = np.repeat(np.arange(len(texts)), lengths)
        good = np.bincount(doc[~self.sound[piece]], minlength=len(texts)) == 0
        piece, doc = piece[good[doc]], doc[good[doc]]
        counts = np.stack([np.bincount(doc, self.counts[piece, j], len(texts)).astype(np.int64) for j in range(4)], axis=1)
        ends = np.searchsorted(doc, np.arange(len(texts)), side="right").tolist()
        numbers = piece.tolist()
        names = [";".join(map(self.strings.__getitem__, numbers[i:j])) for i, j in zip([0, *ends], ends, strict=False)]
        n = self.counts[piece, 3]
        at = np.arange(int(n.sum())) + np.repeat(self.starts[piece] - (np.cumsum(n) - n), n)
        return counts, names, np.repeat(doc, n), self.codes[at]


@dataclass
class Links:
    """Links of texts: arrays by text, and one entry for each link or piece of a group string."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    a: np.ndarray
    b: np.ndarray
    pieces: np.ndarray


def _flat(rows: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(rows), np.int64, sum(map(len, rows)))


def link(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Links:
    """Groups and links of texts that follow each other on one line of bytes: ``n_a`` and ``n_b`` ids each, of ``a`` and
    ``b``, which cover the same bytes. No text is without ids."""
    ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    stop = ends_a[np.cumsum(n_a) - 1]  # where each text ends
    every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs
    twice = np.append(every[1:] == every[:-1], False)
    shared = every[twice]
    every = every[~twice]
    per = lambda ends: np.diff(np.searchsorted(ends, stop, side="right"), prepend=0)
    # group strings: A ids of a group, then its B ids
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    b_before = np.searchsorted(group_b, np.arange(len(shared)))
    a_until = np.searchsorted(group_a, np.arange(len(shared)), side="right")
    pieces = np.empty(len(a) + len(b), np.int64)
    pieces[np.arange(len(a)) + b_before[group_a]] = 2 * a + (shared[group_a] == ends_a)
    last = np.zeros(len(b), np.int64)
    last[np.cumsum(n_b) - 1] = 1
    pieces[np.arange(len(b)) + a_until[group_b]] = 2 * len(a_size) + 3 * b + (shared[group_b] == ends_b) + last
    return Links(n_a, n_b, per(shared), per(every), a[np.searchsorted(ends_a, every)], b[np.searchsorted(ends_b, every)], pieces)


def group_strings(links: Links, names: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text; ``names`` has every A id before , and | and every B id before , and ; and a new line."""
    return "".join(map(names.__getitem__, links.pieces.tolist())).split("\n")[:-1]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of ints below 2^31, compressed."""
    flat = np.concatenate([np.array([len(x) for x in arrays], np.int64), *arrays]).astype("<i4")
    raw = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    return np.split(flat[n:], np.cumsum(flat[:n])[:-1])


STORED = "block long, doc_id array<long>, sizes binary, groups array<string>, held binary, pair array<long>, docs array<long>, vector array<long>"
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Alignment:
    """``documents``: one row for each text, ``pairs(a_id, b_id, n_docs)``: every linked pair of ids."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> Alignment:
    """Aligns the tokens of ``docs(doc_id, text)``; ``keep_groups`` adds the group strings to the documents.

    Both files are read by every task, so they must exist on every machine."""
    spark = docs.sparkSession
    small_batches(spark)

    def first(batches):
        import hashlib

        from pyspark import TaskContext

        aligner, held = Aligner(a_path, b_path), None
        number = TaskContext.get().partitionId() << 33
        fields = ["block", "doc_id", "sizes", "groups", "held", "pair", "docs", "vector"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], fields)

        vector = np.zeros(len(aligner.same), np.int64)
        for part in blocks(batches, "text", BLOCK):
            counts, names, doc, pair = aligner.block(part["text"].to_pylist())
            if not keep_groups:
                names = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in names]
            alike = aligner.same[pair // WIDE] == pair % WIDE
            # distinct same-bytes ids, and distinct other pairs, of each text
            mine, times = np.unique(doc[alike] * WIDE + pair[alike] // WIDE, return_counts=True)
            vector += np.bincount(mine % WIDE, minlength=len(vector))
            codes, at = np.unique(pair[~alike], return_inverse=True)
            other, often = np.unique(doc[~alike] * WIDE + at, return_counts=True)
            texts = len(part)
            held = pack(np.bincount(mine // WIDE, minlength=texts), mine % WIDE, times, np.bincount(other // WIDE, minlength=texts), other % WIDE, often)
            sizes = pack(*counts.T)
            yield row(number, part["doc_id"].to_pylist(), sizes, names, held, codes, np.bincount(other % WIDE, minlength=len(codes)), None)
            number += 1
        if number & ((1 << 33) - 1):
            yield row(None, None, None, None, None, None, None, vector)

    stored = cut(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(tidy(first), STORED))
    vectors = stored.where("block IS NULL").select(F.posexplode("vector").alias("a", "n"))
    alike = vectors.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    sent = stored.where("block IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x"))
    sent = sent.select("block", "at", "x.pair", "x.docs")
    counts = cut(sent.groupBy("pair").agg(F.sum("docs").alias("n")))
    pair_a = F.expr(f"pair DIV {WIDE}")

    aligner = Aligner(a_path, b_path)
    same = aligner.same
    same_docs, highest = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    for r in alike.collect():  # at most one row for each A id
        same_docs[r["a"]] = r["n"]
    for r in counts.groupBy(pair_a.alias("a")).agg(F.max("n").alias("n")).collect():  # the same
        highest[r["a"]] = r["n"]
    highest = np.maximum(highest, same_docs)
    back = sent.select("block", "at", "pair").join(counts, "pair").groupBy("block")
    back = back.agg(F.collect_list(F.struct("at", "pair", "n")).alias("found"))  # at most the distinct pairs of a block

    def second(batches):
        import hashlib

        for batch in batches:
            for part in (batch.slice(i, 1) for i in range(len(batch))):
                n_a, n_b, n_groups, n_links = unpack(part["sizes"][0].as_py(), 4)
                per, mine, times, per_other, other, often = unpack(part["held"][0].as_py(), 6)
                found = part["found"].flatten()
                at = found.field("at").to_numpy()
                codes, counted = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                codes[at], counted[at] = found.field("pair").to_numpy(), found.field("n").to_numpy()
                texts = len(n_a)
                doc, doc_other = np.repeat(np.arange(texts), per), np.repeat(np.arange(texts), per_other)
                best, sums = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
                for d, n, count, a in ((doc, times, same_docs[mine], mine), (doc_other, often, counted[other], codes[other] // WIDE)):
                    np.add.at(best, d, n * (count == highest[a]))
                    np.add.at(sums, d, n * count)
                names = part["groups"].flatten()
                out = [part["doc_id"].flatten(), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links, best, sums))]
                if keep_groups:
                    out += [pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in names.to_pylist()], pa.string()), names]
                else:
                    out.append(names)
                yield pa.RecordBatch.from_arrays(out, list(shape))

    fields = DOCUMENT + ", groups string" * keep_groups
    shape = [x.split()[0] for x in fields.split(", ")]
    looked = stored.where("block IS NOT NULL").select("block", "doc_id", "sizes", "groups", "held").join(back, "block", "left")
    looked = looked.withColumn("found", F.coalesce("found", F.expr("CAST(array() AS ARRAY<STRUCT<at: INT, pair: BIGINT, n: BIGINT>>)")))
    documents = looked.select("doc_id", "sizes", "groups", "held", "found").mapInArrow(tidy(second), fields)
    named = spark.createDataFrame([(i, int(b)) for i, b in enumerate(same.tolist()) if same_docs[i] > 0], "a int, b long")
    pairs = alike.join(named, "a").select(F.col("a").cast("long").alias("a_id"), F.col("b").alias("b_id"), F.col("n").alias("n_docs"))
    return Alignment(documents, pairs.union(counts.select(pair_a, F.expr(f"pair % {WIDE}"), "n")))
