import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from threadloom.llm.bpe import Codec, encode_documents, merge_table, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    pick = random.Random(3)
    letters = "abcdeinrstéäöñß '"
    yield from ["", " ", "  ", "a", "a b", "a  b\n\n c ", " lead", "tail ", "don't WE'LL", "a" * 400, "ab" * 300, "!" * 150 + "=-" * 90, "日本語テキスト" * 9, "👍🏽" * 20, "\x00\x01\x7f", "12 345", "a\n b\t c\xa0d"]
    for _ in range(60):
        yield "".join(pick.choice(letters) for _ in range(pick.choice([3, 20, 90])))


def test_equals_library(ranks, library):
    codec, rows = Codec(ranks, P.PATTERN), list(texts())
    ids, counts = codec.encode(rows)
    for text, got, n in zip(rows, ids, counts, strict=True):
        want = library.encode_ordinary(text)
        assert got == ",".join(map(str, want)) and n == len(want), text


def test_merge_order_with_unsafe_tokens():
    """A pair that becomes possible by a merge may have a lower rank than the merge."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"cd": 256, b"abcd": 257, b"ab": 258, b"bc": 259, b"abc": 260}
    assert 258 in merge_table(ranks)[1]
    library = tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec(ranks, P.PATTERN)
    for text in ("abcd", "abcabcd", "ababcdab", "abcd" * 30, "abc" * 40 + "d"):
        assert codec.encode([text])[0][0] == ",".join(map(str, library.encode_ordinary(text)))


def test_odd_rows(odd, none, library):
    got = encode_documents(odd, PATH, P.PATTERN, keep_decoded=True).collect()
    want = odd.collect()
    assert len(got) == len(want)
    plain = sorted((r.doc_id or 0, r.text or "") for r in want)
    for (i, text), r in zip(plain, sorted(got, key=lambda r: (r.doc_id or 0)), strict=True):
        ids = library.encode_ordinary(text)
        assert (r.doc_id or 0) == i and r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_documents(none, PATH, P.PATTERN).count() == 0
