"""WARC archives with a two-level capture index.

Writing: each task writes its rows as WARC 1.1 records, one gzip member each, to archives of at most
``ARCHIVE_BYTES`` in the shared folder, and returns where each record lies. Of equal payloads of at
least ``LEAST_BYTES`` one is stored and the others are revisit records that refer to it.

Index: captures are sorted by key (URL with reversed host, then page id) over all tasks. A task writes
one shard: lines in zlib blocks of ``BLOCK_LINES``, then the sparse directory (first key and place of
each block), then the directory's place. Level one is the list of shards with their first and last
keys (a row for each task), level two a shard's directory.

Lookup: requests are sorted like the index, so a task meets neighbouring keys; it finds shard, block
and lines by binary search and reads the block and then the record by their byte ranges.

Defined results: null html is the empty payload, null url the empty URL; rows without ``page_id`` are
written as responses and are never referred to; repeated rows are written and read one by one, and each
row of the response's id is a response. Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

from .blocks import blocks
from .shared_files import Reader, Writer

LEAST_BYTES = 1000
ARCHIVE_BYTES = 256_000_000
BLOCK_LINES = 512


def capture_key(url: Column, page_id: Column) -> Column:
    """``com,example)/path`` and the page id, as one sortable text."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    place = F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))
    place = F.regexp_replace(place, r"[\t\r\n]", " ")
    # ids in order, negative ones too
    number = F.coalesce(F.lpad((page_id.cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0"), F.lit("-"))
    return F.concat(place, F.lit("\t"), number)


def decide(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``digest``, ``bytes`` and ``refers_to`` (null for responses)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    large = pages.where(F.col("bytes") >= LEAST_BYTES)
    first = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    first = cut(first.where("n > 1").drop("n"))
    same = large.join(first, ["digest", "bytes"], "left").withColumn("refers_to", F.expr("CASE WHEN page_id <> first THEN first END")).drop("first")
    small = pages.where(F.col("bytes") < LEAST_BYTES).withColumn("refers_to", F.lit(None).cast("long"))
    return same.unionByName(small)


def record(page_id, url, html: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record."""
    import base64

    page_id = "-" if page_id is None else page_id
    url = (url or "").replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (html if refers_to is None else b"")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one uncompressed record: its headers in lower case, and ``payload`` (None for revisits)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(out["content-length"])]
    out["payload"] = body.partition(b"\r\n\r\n")[2] if out["warc-type"] == "response" else None
    return out


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``pages(page_id, url, html)``; returns the captures ``key, page_id,
    file, offset, length``, stored."""

    def task(batches):
        import gzip

        out = Writer(folder, ".warc.gz", ARCHIVE_BYTES)
        for part in blocks(batches, "html"):
            places, lengths = [], []
            for row in part.select(["page_id", "url", "html", "digest", "bytes", "refers_to"]).to_pylist():
                data = gzip.compress(record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["bytes"], row["refers_to"]), 4, mtime=0)
                places.append(out.add(data))
                lengths.append(len(data))
            yield pa.RecordBatch.from_pydict({
                "key": part["key"], "page_id": part["page_id"], "file": [f for f, _ in places],
                "offset": pa.array([o for _, o in places], pa.int64()), "length": pa.array(lengths, pa.int64()),
            })
        out.close()

    rows = decide(pages).withColumn("key", capture_key(F.col("url"), F.col("page_id")))
    return cut(rows.mapInArrow(task, "key string, page_id long, file string, offset long, length long"))


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Writes the capture index; returns (first key, last key, shard) of its shards, a few for each task."""

    def task(batches):
        import json
        import struct
        import zlib

        out = Writer(folder, ".cdx", 1 << 62)
        blob, directory, lines, at, last = [], [], [], 0, None

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append((lines[0][0], at, len(data)))
            blob.append(data)
            at += len(data)
            lines.clear()

        def end():
            nonlocal at
            if lines:
                flush()
            if directory:
                data = zlib.compress(json.dumps(directory).encode())
                name, _ = out.add(b"".join([*blob, data, struct.pack(">QQ", at, len(data))]))
                out.close()
                yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "last": [last], "shard": [name]})
            blob.clear()
            directory.clear()
            at = 0

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                lines.append(row)
                last = row[0]
                if len(lines) >= BLOCK_LINES:
                    flush()
                    if at > 64_000_000:
                        yield from end()
        yield from end()

    rows = captures.select("key", "file", "offset", "length")
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "key").sortWithinPartitions("key", "file", "offset")
    shards = cut(rows.mapInArrow(task, "first string, last string, shard string"))
    return sorted((r["first"], r["last"], r["shard"]) for r in shards.collect())  # a row for each shard


def find(keys: list[str], shards, reader: Reader):
    """(key, file, offset, length) of the captures of sorted keys, by binary search on both levels."""
    import bisect
    import json
    import struct
    import zlib

    firsts, lasts = [x[0] for x in shards], [x[1] for x in shards]
    held: tuple = (None, [], [])
    block: tuple = (None, [], [])
    for key in keys:
        s = bisect.bisect_left(lasts, key)
        while s < len(shards) and firsts[s] <= key:
            name = shards[s][2]
            if held[0] != name:
                size = reader.file(name).size()
                at, length = struct.unpack(">QQ", reader.read(name, size - 16, 16))
                directory = json.loads(zlib.decompress(reader.read(name, at, length)))
                held = (name, directory, [x[0] for x in directory])
            b = max(bisect.bisect_left(held[2], key) - 1, 0)
            while b < len(held[1]) and held[2][b] <= key:
                if block[0] != (name, b):
                    _, at, length = held[1][b]
                    lines = [json.loads(x) for x in zlib.decompress(reader.read(name, at, length)).decode().split("\n")]
                    block = ((name, b), lines, [x[0] for x in lines])
                for k in range(bisect.bisect_left(block[2], key), bisect.bisect_right(block[2], key)):
                    yield block[1][k]
                b += 1
            s += 1


def look_up(requests: DataFrame, shards: list[tuple[str, str, str]], folder: str, payload: bool = False) -> DataFrame:
    """The records of the captures that ``requests(key)`` name, one row for each capture of a distinct
    key: ``key, page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and the
    ``payload`` itself when asked for (null for revisits)."""
    fields = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def number(text):
        at = text[len("<urn:x-page:") : -1]
        return None if at == "-" else int(at)

    def task(batches):
        import base64
        import gzip
        import hashlib

        reader = Reader(folder)
        names = [x.split(" ")[0] for x in fields.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            rows, size = [], 0
            for key, file, offset, length in find(batch["key"].to_pylist(), shards, reader):
                r = parse(gzip.decompress(reader.read(file, offset, length)))
                body, refers = r["payload"], r.get("warc-refers-to")
                if body is None:
                    n, digest = int(r["x-payload-length"]), base64.b32decode(r["warc-payload-digest"][5:]).hex()
                else:
                    n, digest = len(body), hashlib.sha1(body).hexdigest()
                row = (key, number(r["warc-record-id"]), r["warc-target-uri"], n, digest, r["warc-type"], number(refers) if refers else None)
                rows.append((*row, body) if payload else row)
                size += n * payload + 200
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    keys = requests.select("key").distinct()
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(task, fields)
