"""Byte-level BPE: recursive DuckDB queries over token-position rows, per partition.

A text is cut by the vocabulary's pattern. (A single space between other characters always
begins a match of such patterns, so texts are cut there first and equal parts are matched once.) Each distinct piece of a block becomes one row per
byte (word, position, token, next token); a recursive query joins those rows with the merge
table and contracts in every word the leftmost pair of least rank until no pair is left. Words
longer than ``LONG`` bytes contract all their pairs of the least rank in one step where that is
the same (see ``unsafe`` in ``merge_table``). Decoding joins ids with the vocabulary and
concatenates in order. A recursive query keeps the rows of all its steps, so it is ended after
``STEPS_A_QUERY`` steps and begun again with the words that are not at their fixpoint.

No row leaves its partition: texts are never shuffled, and a task holds one block of texts
(4 MB, or one longer text), the vocabulary and at most ``CACHED`` encoded words.

Defined results: null text is the empty text, which has no ids and decodes to no bytes; every
input row gives one output row, repeated rows too; other columns of the input are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import blocks, small_batches, tidy

LONG = 48
CACHED = 400_000
BLOCK = 2_000_000
WORDS_A_QUERY, BYTES_A_QUERY = 20_000, 200_000
STEPS_A_QUERY = 12


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[list[tuple[int, int, int]], set[int]]:
    """(left, right, rank) for every pair of tokens that joins to a token, and the unsafe
    ranks: tokens that can be part of a pair of lower rank than their own. After contracting an
    unsafe pair a better pair may appear, so only its leftmost occurrence may be contracted."""
    rows, unsafe = [], set()
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.append((left, right, rank))
                unsafe.update(x for x, part in ((left, token[:i]), (right, token[i:])) if len(part) > 1 and x > rank)
    return rows, unsafe


CONTRACT = """
WITH RECURSIVE step(it, w, p, tok, nxt) AS (
    SELECT 0, w, p, tok, nxt FROM bytes_in
  UNION ALL
    SELECT r.it + 1, r.w, CASE WHEN r.p > b.p THEN r.p - 1 ELSE r.p END,
           CASE WHEN r.p = b.p + 1 THEN b.rank ELSE r.tok END,
           CASE WHEN r.p + 1 = b.p THEN b.rank ELSE r.nxt END
    FROM step r JOIN (
        SELECT w, (best & 65535)::INTEGER AS p, (best >> 16)::INTEGER AS rank
        FROM (SELECT s.w, min((m.rank::BIGINT << 16) | s.p) AS best
              FROM step s JOIN merges m ON m.pair = (s.tok::BIGINT << 20) | s.nxt GROUP BY s.w)
    ) b ON b.w = r.w
    WHERE r.p <> b.p AND r.it < $steps
)
SELECT it, w, p, tok FROM step
"""

CONTRACT_LONG = """
WITH RECURSIVE step(it, w, p, tok) AS (
    SELECT 0, w, p, tok FROM bytes_in
  UNION ALL
    SELECT it + 1, w, p, CASE WHEN hit THEN best ELSE tok END FROM (
        SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM (
            SELECT *, match AND CASE WHEN best IN (SELECT rank FROM unsafe) THEN p = min(p) FILTER (match) OVER (PARTITION BY w)
                                ELSE (n - coalesce(max(n) FILTER (NOT match) OVER (PARTITION BY w ORDER BY p), 0)) % 2 = 1 END AS hit
            FROM (SELECT *, coalesce(rank = best, false) AS match, row_number() OVER (PARTITION BY w ORDER BY p) AS n
                  FROM (SELECT *, min(rank) OVER (PARTITION BY w) AS best
                        FROM (SELECT x.*, m.rank
                              FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY p) AS nxt FROM step) x
                              LEFT JOIN merges m ON m.pair = x.tok::BIGINT * 1048576 + x.nxt))
                  WHERE best IS NOT NULL)))
    WHERE NOT gone AND it < $steps
)
SELECT it, w, p, tok FROM step
"""

DECODE = "SELECT d, string_agg(piece, '' ORDER BY p) AS text FROM ids_in JOIN vocabulary USING (tok) GROUP BY d"


class Codec:
    """One task's connection with the vocabulary as tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED):
        import duckdb
        import regex

        self.ranks, self.split, self.spaces = ranks, regex.compile(pattern).findall, regex.compile(r"\s\s").search
        merges, unsafe = merge_table(ranks)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        left, right, rank = zip(*merges, strict=True) if merges else ((), (), ())
        put = {
            "merges": pa.table({"pair": pa.array([a * 1048576 + b for a, b in zip(left, right, strict=True)], pa.int64()), "rank": pa.array(rank, pa.int32())}),
            "unsafe": pa.table({"rank": pa.array(sorted(unsafe), pa.int32())}),
            # a byte is the character of that code, so that pieces of characters are text too
            "vocabulary": pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())}),
        }
        for name, table in put.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.known: dict[str, str] = {}
        self.cached = cached

    def _contract(self, words: list[bytes], query: str) -> list[str]:
        import numpy as np

        out = [""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        left = np.arange(len(words), dtype=np.int32)
        tok = np.asarray(self.first, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        while len(left):
            ends = lengths.cumsum()
            nxt = np.append(tok[1:], np.int32(-1))
            nxt[ends - 1] = -1
            p = (np.arange(len(tok)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
            self.db.register("bytes_in", pa.table({"w": np.repeat(left, lengths), "p": p, "tok": tok, "nxt": nxt}))
            found = self.db.sql(query, params={"steps": STEPS_A_QUERY}).to_arrow_table()
            self.db.unregister("bytes_in")
            it, w, p, tok = (found[c].to_numpy() for c in ("it", "w", "p", "tok"))
            last = np.zeros(len(words), np.int32)
            np.maximum.at(last, w, it)
            end = it == last[w]
            w, p, tok = w[end], p[end], tok[end]
            order = np.lexsort((p, w))
            w, tok = w[order], tok[order]
            begin = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            left, lengths = w[begin], np.diff(np.append(begin, len(w)))
            flat = list(map(str, tok.tolist()))
            for i, x, y in zip(left.tolist(), begin.tolist(), (begin + lengths).tolist(), strict=True):
                out[i] = ",".join(flat[x:y])
            more = last[left] == STEPS_A_QUERY
            tok = tok[np.repeat(more, lengths)]
            left, lengths = left[more], lengths[more]
        return out

    def learn(self, words) -> None:
        """Encodes the words not known yet."""
        known, short, long = self.known, [], []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:  # a whole token needs no merges
                known[word] = str(rank)
            else:
                (short if len(raw) <= LONG else long).append((word, raw))
        for group, query in ((short, CONTRACT), (long, CONTRACT_LONG)):
            start = 0
            while start < len(group):
                stop, size = start, 0
                while stop < len(group) and (stop == start or stop - start < WORDS_A_QUERY and size < BYTES_A_QUERY):
                    size += len(group[stop][1])
                    stop += 1
                for (word, _), ids in zip(group[start:stop], self._contract([raw for _, raw in group[start:stop]], query), strict=True):
                    known[word] = ids
                start = stop

    def _parts(self, text: str) -> list[str]:
        if self.spaces(text):  # white space of more than one character
            return self.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def encode(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """For each text its ids as decimals joined by commas, and their number."""
        texts = [self._parts(t) for t in texts]
        if len(self.known) > self.cached:
            self.known = {}
        known = self.known
        new = set().union(*texts) - known.keys()
        # a word of letters only is one match already
        pieces = {x: [x] if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) else self.split(x) for x in new}
        self.learn(set().union(*pieces.values()) - known.keys())
        for x, found in pieces.items():
            if len(found) > 1:
                known[x] = ",".join([known[y] for y in found])
        ids = [",".join([known[x] for x in parts]) for parts in texts]
        return ids, [x.count(",") + 1 if x else 0 for x in ids]

    def decode(self, parts) -> list[bytes]:
        """The bytes of each array of ids."""
        import numpy as np

        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        d = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        self.db.register("ids_in", pa.table({"d": d, "p": np.arange(len(flat), dtype=np.int64), "tok": flat}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids_in")
        out = [b""] * len(parts)
        for i, text in zip(found["d"].to_pylist(), found["text"].to_pylist(), strict=True):
            out[i] = text.encode("latin-1")
        return out


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True, keep_decoded: bool = False, cached: int = CACHED, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs(doc_id, text)``, with
    ``ids`` (array) and ``decoded`` (the bytes the ids decode to) when asked for.

    A task remembers ``cached`` words and holds ``block`` bytes of text at once: about 230 bytes a word and 50 a byte.
    ``ranks_path`` is read by every task, so it must exist on every machine."""
    small_batches(docs.sparkSession)
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>" * keep_ids + ", decoded binary" * keep_decoded

    def task(batches):
        import gc
        import hashlib

        import numpy as np

        gc.disable()  # millions of live strings, no cycles
        codec = Codec(read_ranks(ranks_path), pattern, cached)
        for part in blocks(batches, "text", block):
            ids, counts = codec.encode([x or "" for x in part["text"].to_pylist()])
            parts = [np.fromstring(x, np.int32, sep=",") if x else np.empty(0, np.int32) for x in ids]
            decoded = codec.decode(parts)
            out = {
                "doc_id": part["doc_id"],
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            }
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), np.concatenate(parts))
            if keep_decoded:
                out["decoded"] = pa.array(decoded, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(tidy(task), fields)
