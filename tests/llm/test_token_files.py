import numpy as np
import public_tokenizers as P
import tiktoken

from threadloom.llm import token_files
from threadloom.llm.blocks import shared_folder
from threadloom.llm.bpe import read_ranks
from threadloom.llm.shared_files import Writer

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_counts(spark, odd, none):
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={}).encode_ordinary
    got = token_files.token_counts(odd, shared_folder(spark, "tokens"), PATH, P.PATTERN, 50256).collect()
    want = [(r.doc_id, len(encode(r.text or ""))) for r in odd.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_files.token_counts(none, shared_folder(spark, "tokens"), PATH, P.PATTERN, 50256).count() == 0


def test_documents_across_blocks(spark):
    """Empty documents, separators at block edges, documents over many blocks, an open end."""
    folder = shared_folder(spark, "tokens")
    out, rows, want = Writer(folder, ".u16", 1 << 40), [], set()
    for lengths, rest in (([0, 3, 4, 0, 0, 25, 1], 0), ([4, 4, 4], 7), ([], 13), ([50], 0), ([0], 0)):
        ids = [x for n in lengths for x in [*range(n), -1]] + list(range(rest))
        data = np.array([99 if x < 0 else x for x in ids], "<u2").tobytes()
        name, _ = out.add(data)
        out.close()
        rows.append((name, len(data)))
        want |= {(name, i, n) for i, n in enumerate([*lengths, rest] if rest else lengths)}
    files = spark.createDataFrame(rows, "file string, bytes long")
    for block in (1, 5, 1000):
        got = {tuple(r) for r in token_files.scan_token_files(spark, files, folder, 99, block).collect()}
        assert got == want
