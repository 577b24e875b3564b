"""Texts of an Arrow column as one array of lower-case UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x):
    """A 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, in lower case, and where each begins and ends."""
    return raw_bytes(pc.utf8_lower(texts.fill_null("")))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets * 0
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values (rows) between neighbouring offsets, 0 between equal ones."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


#: Letters: a-z and every byte of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


class Words:
    """The letter runs of texts, with hashes of the whole and of their first bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter = LETTER[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        self.starts = np.flatnonzero(letter & (first[:-1] | ~np.append(False, letter[:-1]))) if len(data) else np.empty(0, np.int64)
        self.ends = np.flatnonzero(letter & (first[1:] | ~np.append(letter[1:], False))) + 1 if len(data) else np.empty(0, np.int64)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        power = np.cumprod(np.full(len(data), _BASE))
        self._total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power))
        self._back = np.cumprod(np.full(len(data), _BACK))

    def hashes(self, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, hashes) of whole words, or of the first ``length`` bytes of longer ones."""
        at = np.arange(len(self.starts)) if length is None else np.flatnonzero(self.ends - self.starts > length)
        s = self.starts[at]
        e = self.ends[at] if length is None else s + length
        return at, mix((self._total[e] - self._total[s]) * self._back[s] + np.uint64((length or 0) * int(_BASE) % 2**64))


def held_out(divisor: int, remainder: int) -> str:
    """SQL: whether crc32 of the id as text leaves that remainder; rows without id count as held out."""
    return f"coalesce(crc32(CAST(doc_id AS STRING)) % {divisor} = {remainder}, true)"
