"""License scans: an Aho-Corasick automaton over word sequences, and a shunting-yard parser of expressions.

A text in lower case (A-Z only) is the sequence of its words, runs of digits, letters a-z and
characters beyond ASCII. One automaton over those words, joined by single blanks, finds every place of
every phrase in one pass: ``BASE`` phrases, ``NOTICES`` (the longest of those that begin at a word and
contain each other) and ``TAGS``, which announce an expression. An expression is read from the text
behind a tag up to the end of its line; a shunting-yard parser (``with`` binds before ``and``, that
before ``or``) evaluates it to the licenses named, the ones that bind under the freest choice, and how free
that choice is: ``and`` takes the least free side, ``or`` the freest, ``with`` lifts its license to ``LIFT``
at least. What stands before the first token that cannot continue is the expression; an operator
without a right side is dropped, an open bracket closes at the end.

``score`` is how free a document's statements leave it: of all base phrases, notices and expressions
the least free one (1: only conditions of attribution; 0: nothing found).

Defined results: null, empty and word-less texts have no words and no labels, score 0 and no first or
last word; every input row gives one row, repeated rows and rows without id too; equal labels count once,
ties between equally free choices go to the left side. A very long text, and one unbroken run of letters,
takes time and memory in proportion to its length, its places included. Other columns are ignored; an
empty table gives no rows. No row leaves its partition.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import blocks
from .text_bytes import raw_bytes

#: Phrases that are always reported, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: More phrases of notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "public domain dedication": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "reserved",
}
#: What announces an expression.
TAGS = ("spdx license identifier", "license expression", "spdx license expression")
#: Labels and how free each leaves its user, from 0 to 1.
FREEDOM = {
    "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "zlib": 1.0, "bsl": 1.0, "apache": 0.95, "apache-2": 0.95,
    "cc-by": 0.9, "artistic-2": 0.8, "mpl": 0.7, "mpl-2": 0.7, "epl": 0.65, "epl-2": 0.65, "cddl-1": 0.65, "lgpl": 0.6, "lgpl-2": 0.6, "lgpl-3": 0.6,
    "cc-by-sa": 0.5, "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "agpl-3": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.15, "reserved": 0.05,
}
#: Labels this table does not name.
UNKNOWN = 0.25
LIFT = 0.6

_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
#: What may stand between a tag and its expression.
_LEAD = re.compile(r"[ \t:=\"'`*]*")
_BINDS = {"with": 3, "and": 2, "or": 1}
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def label_of(name: str) -> str:
    """The label of an identifier in lower case: version parts of zero, "-only", "-or-later" and "+" go, and
    the clauses of BSD."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name)
    name = re.sub(r"-clause.*$", "", name)
    name = re.sub(r"^bsd-\d$", "bsd", name)
    if re.match(r"cc-by(-|$)|cc0", name):
        return re.sub(r"-\d[\d.]*(-[a-z]+)?$", "", name)
    return re.sub(r"^([a-z0-9-]+?-\d+)(\.\d+)+$", r"\1", name)


class Choice:
    """A value of the evaluation: all labels named, those that bind under the freest choice, its freedom."""

    __slots__ = ("named", "bind", "freedom")

    def __init__(self, named: frozenset, bind: frozenset, freedom: float):
        self.named, self.bind, self.freedom = named, bind, freedom

    @staticmethod
    def of(name: str) -> Choice:
        label = label_of(name)
        return Choice(frozenset([label]), frozenset([label]), FREEDOM.get(label, UNKNOWN))

    def join(self, operator: str, other: Choice) -> Choice:
        named = self.named | other.named
        if operator == "with":  # the right side is an exception, no license
            return Choice(self.named, self.bind, max(self.freedom, LIFT))
        if operator == "and":
            return Choice(named, self.bind | other.bind, min(self.freedom, other.freedom))
        best = other if other.freedom > self.freedom else self
        return Choice(named, best.bind, best.freedom)


def to_postfix(text: str, at: int = 0) -> list[str]:
    """The expression in ``text`` (lower case) from place ``at`` on, in postfix order."""
    out, waiting, operand = [], [], False

    def settle(least: int) -> None:
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= least:
            out.append(waiting.pop())

    while found := _TOKEN.search(text, at):
        if text[at : found.start()].strip(" \t"):  # another sign or the end of the line
            break
        token, at = found.group(), found.end()
        if token in _BINDS:
            if not operand:
                break
            settle(_BINDS[token])
            waiting.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            waiting.append(token)
        elif token == ")":
            if not operand or "(" not in waiting:
                break
            settle(0)
            waiting.pop()
        elif operand:
            break
        else:
            out.append(token)
            operand = True
    # operators and brackets behind the last operand have nothing on their right
    while not operand and waiting:
        operand = waiting.pop() != "("
    waiting[:] = [x for x in waiting if x != "("] if out else []
    # brackets left open close here, so what waits is settled from the right
    return out + waiting[::-1]


def evaluate(text: str, at: int = 0) -> Choice | None:
    """The value of the expression in a text in lower case from place ``at`` on, None if there is none."""
    stack: list[Choice] = []
    for token in to_postfix(text, at):
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(left.join(token, right))
        else:
            stack.append(Choice.of(token.rstrip(".:-")))
    return stack[0] if stack else None


class Scanner:
    """The automaton of the phrases."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS):
        import ahocorasick

        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
            for phrase, label in phrases.items():
                # bytes as characters, as in the texts
                kinds.setdefault(" " + phrase.encode().decode("latin-1") + " ", []).append((kind, label))
        self.automaton = ahocorasick.Automaton()
        for key, found in kinds.items():
            self.automaton.add_word(key, (len(key), key.count(" ") - 1, found))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple]]:
        """(words, places); a place is (kind, label, first word, words, value or None). ``raw`` is in lower case."""
        codes = np.frombuffer(raw, np.uint8)
        word = _WORD[codes]
        words = np.where(word, codes, 32).astype(np.uint8).tobytes().split()
        line = b" ".join([b"", *words, b""]).decode("latin-1")
        hits = list(self.automaton.iter(line)) if words else []
        if not hits:
            return len(words), []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        first = np.searchsorted(blanks, [end + 1 - size for end, (size, _, _) in hits]).tolist()
        places, longest, ends, text = [], {}, None, ""
        for at, (_, (_, n, found)) in zip(first, hits, strict=True):
            for kind, label in found:
                if kind == "notice":
                    if longest.get(at, (0,))[0] < n:
                        longest[at] = (n, label)
                elif kind == "base":
                    places.append((kind, label, at, n, None))
                else:
                    if ends is None:
                        ends, text = np.flatnonzero(word & ~np.append(word[1:], False)) + 1, raw.decode("latin-1")
                    value = evaluate(text, _LEAD.match(text, ends[at + n - 1]).end())
                    if value is not None:
                        places.append((kind, ",".join(sorted(value.named)), at, n, value))
        reach = -1
        for at in sorted(longest):  # a notice inside one that began earlier is part of it
            n, label = longest[at]
            if at + n > reach:
                places.append(("notice", label, at, n, None))
                reach = at + n
        return len(words), places


def _lower(texts: pa.Array) -> list[bytes]:
    data, offsets = raw_bytes(texts)
    data = _LOWER[data].tobytes()
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def places(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """``doc_id, kind, label, first_word, n_words, binds``: one row for each place of ``docs(doc_id, text)``;
    ``binds`` are the labels that bind under the freest choice of an expression."""

    def task(batches):
        scanner = Scanner(base, notices, tags)
        for part in blocks(batches, "text"):
            rows = {name: [] for name in ("doc_id", "kind", "label", "first_word", "n_words", "binds")}
            for doc, raw in zip(part["doc_id"].to_pylist(), _lower(part["text"]), strict=True):
                for kind, label, at, n, value in scanner.scan(raw)[1]:
                    for name, x in zip(rows, (doc, kind, label, at, n, sorted(value.bind) if value else None), strict=True):
                        rows[name].append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    fields = "doc_id long, kind string, label string, first_word long, n_words long, binds array<string>"
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(task, fields)


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, binding`` for each row of
    ``docs(doc_id, text)``; ``binding`` are the labels that bind under the freest choices."""

    def task(batches):
        scanner = Scanner(base, notices, tags)
        for part in blocks(batches, "text"):
            out = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "binding")}
            for raw in _lower(part["text"]):
                n, found = scanner.scan(raw)
                starts = [at for kind, _, at, _, _ in found if kind == "base"]
                own = {label for kind, label, *_ in found if kind == "base"}
                bind = own.union(*([label] if value is None else value.bind for _, label, _, _, value in found))
                named = own.union(*([label] if value is None else value.named for _, label, _, _, value in found))
                free = [FREEDOM.get(label, UNKNOWN) if value is None else value.freedom for _, label, _, _, value in found]
                row = (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(named)), float(min(free, default=0.0)), ",".join(sorted(bind)))
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    fields = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, binding string"
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(task, fields)
