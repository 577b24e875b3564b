import gzip
import hashlib

from pyspark.sql import functions as F

from threadloom.llm import warc
from threadloom.llm.blocks import shared_folder
from threadloom.llm.shared_files import Reader

PAGES = "page_id long, url string, html string, key string, digest string, offset int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", 1) for r in rows], PAGES)


ROWS = [
    (1, "http://www.example.com/a", "x" * 2000), (7, "http://example.com/b?q=1", "x" * 2000), (3, None, "x" * 2000), (7, "http://example.com/b?q=1", "x" * 2000),
    (4, "https://EXAMPLE.org:8080/", "small"), (5, "https://example.org/", "small"), (6, "no url\nat all", None), (8, "", ""),
    (None, "http://a.b.c/", "x" * 2000), (9, "http://a.b.c/", "é" * 900), (10, "http://a.b.c/", "long " * 300_000), (-5, "http://a.b.c/", "neg"),
]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    frame, folder = pages(spark, ROWS), shared_folder(spark, "warc")
    captures = warc.write_archives(frame, folder)
    shards = warc.build_index(captures, folder)
    asked = frame.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    got = warc.look_up(asked, shards, folder, payload=True).collect()
    assert len(got) == len(ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for i, _, html in ROWS:
        data = (html or "").encode()
        for r in by_id[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            again = i in (1, 3)
            assert (r.record_type, r.refers_to) == (("revisit", 7) if again else ("response", None))
            assert r.payload is None if again else bytes(r.payload) == data
    assert len(by_id[7]) == 2
    # archives are plain gzip files of WARC records
    reader = Reader(folder)
    for c in captures.collect():
        assert gzip.decompress(reader.read(c.file, c.offset, c.length)).startswith(b"WARC/1.1\r\n")
    # keys that no capture has
    missing = spark.createDataFrame([("zz",), ("",), ("com,example)/a\t",)], "key string")
    assert warc.look_up(missing, shards, folder).count() == 0


def test_keys_sort_by_reversed_host_and_id(spark):
    rows = pages(spark, [(2, "http://b.example.com/x", ""), (-1, "http://b.example.com/x", ""), (10, "http://b.example.com/x", ""), (1, "http://a.org", "")])
    keys = [r.k for r in rows.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("k")).collect()]
    assert keys[0].startswith("com,example,b)/x\t") and keys[1] < keys[0] < keys[2] < keys[3]


def test_no_pages(spark):
    frame, folder = pages(spark, ROWS).limit(0), shared_folder(spark, "warc")
    shards = warc.build_index(warc.write_archives(frame, folder), folder)
    assert shards == []
    assert warc.look_up(spark.createDataFrame([("a",)], "key string"), shards, folder).count() == 0
