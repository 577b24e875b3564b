"""Dump and vector files, index tables, embedding and snapshots."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import embed, text
from threadloom.operators import hydrate, mutate, render
from threadloom.sources import dumps, index


def put(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")


def test_read_dump(spark, tmp_path):
    put(tmp_path / "telegram_dump_-100123.json", [
        {"id": 1, "date": "2024-01-01T10:00:00", "sender": "A", "content": "hi"},
        {"id": 2, "date": "2024-01-02T10:00:00"},
    ])
    put(tmp_path / "other.json", [{"id": 7, "date": "2024-01-03T00:00:00+00:00", "sender": "B", "content": "x"}])
    put(tmp_path / "telegram_dump_5.json", {"id": 9, "date": "2024-01-03T00:00:00", "sender": "no", "content": "list"})
    rows = dumps.to_messages(dumps.read_dump(spark, str(tmp_path))).orderBy("msg_id").collect()
    assert [(r.msg_id, r.chat_id, r.from_id, r.text) for r in rows] == [
        ("-100123_1", "-100123", "A", "hi"), ("-100123_2", "-100123", "Unknown", ""), ("unknown_chat_7", "unknown_chat", "B", "x"),
    ]
    assert rows[0].ts == dt.datetime(2024, 1, 1, 10)


def test_malformed_date_fails(spark, tmp_path):
    put(tmp_path / "telegram_dump_1.json", [{"id": 1, "date": "yesterday"}])
    with pytest.raises(Exception):
        dumps.read_dump(spark, str(tmp_path)).collect()


def test_read_lines(spark, tmp_path):
    put(tmp_path / "a.txt", "Hello world\n\n  Another line \n")
    rows = dumps.read_lines(spark, str(tmp_path / "a.txt"), "2024-01-01 00:00:00").orderBy("id").collect()
    assert [(r.id, r.content, r.sender) for r in rows] == [("0", "Hello world", "Unknown"), ("2", "Another line", "Unknown")]


def test_dump_round_trip(spark, tmp_path):
    rows = [(-100, "1", "2024-01-01T00:00:00", "A", "x"), (-100, "2", "2024-01-01T00:01:00", "B", "y\nz"), (7, "1", "2024-01-01T00:00:00", "C", "w")]
    df = spark.createDataFrame(rows, "chat_id long, id string, date string, sender string, content string")
    dumps.write_dump(df, str(tmp_path / "d"))
    back = dumps.to_messages(dumps.read_written_dump(spark, str(tmp_path / "d"))).orderBy("msg_id").collect()
    assert [(r.msg_id, r.text) for r in back] == [("-100_1", "x"), ("-100_2", "y\nz"), ("7_1", "w")]


def test_stream_batches_follow_messages(spark, tmp_path, monkeypatch):
    """450 chats of one message are no reason for three batches of 200 files."""
    from threadloom.plans import archive_queries

    spark.range(450).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "concat('t', id) AS text").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    monkeypatch.setattr(archive_queries, "scratch", lambda spark, what: str(tmp_path / what))
    rows = archive_queries.stream_ingest(spark, str(tmp_path)).collect()
    assert sorted((r.msg_id, r.text) for r in rows) == sorted((f"{i}_0", f"t{i}") for i in range(450))
    assert len(list((tmp_path / "ingest" / "messages").glob("batch=*"))) == 1


def test_packed_dump_cuts_large_chats(spark, tmp_path):
    df = spark.range(100).selectExpr("if(id < 90, -7L, id) AS chat_id", "cast(id AS string) AS id", "'2024-01-01T00:00:00' AS date", "'A' AS sender", "if(id = 3, null, 'x') AS content")
    dumps.write_dump_packed(df, str(tmp_path / "d"), 20)
    assert max(len(f.read_text().splitlines()) for f in (tmp_path / "d").glob("*.json")) == 20
    back = dumps.to_messages(dumps.read_written_dump(spark, str(tmp_path / "d"))).collect()
    assert sorted((r.chat_id, r.msg_id, r.text) for r in back) == sorted(
        (str(c), f"{c}_{i}", "" if i == 3 else "x") for i in range(100) for c in [-7 if i < 90 else i]
    )


def test_vector_file(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.5])], "chunk_id string, embedding array<float>")
    dumps.write_vectors(df, str(tmp_path / "v"))
    assert {r.id: r.embedding for r in dumps.read_vectors(spark, str(tmp_path / "v")).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.5]}
    dumps.write_vectors(df.limit(0), str(tmp_path / "w"))
    assert dumps.read_vectors(spark, str(tmp_path / "w")).count() == 0
    with pytest.raises(Exception):
        dumps.write_vectors(df.withColumn("embedding", F.lit(None).cast("array<float>")), str(tmp_path / "x"))


def test_index(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("c1", "t", '{"a": 1}', [1.0], 3, 1), ("c2", "u", "nonsense", [2.0], None, None), ("c3", "v", None, None, 1, 1)],
        "chunk_id string, text string, metadata string, embedding array<float>, topic_l1_id long, topic_l2_id long",
    )
    built = index.build_chunk_index(chunks)
    index.write_index(built, str(tmp_path / "i"))
    rows = {r.id: r.metadata for r in index.read_index(spark, str(tmp_path / "i")).collect()}
    assert rows == {"c1": {"a": "1", "topic_l1_id": "3", "topic_l2_id": "1"}, "c2": {}}
    wider = built.withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")).limit(1)
    assert index.check_dim(built, wider).first().rebuild
    assert index.sync_index(built, wider).count() == 1
    assert not index.check_dim(built.limit(0), wider).first().rebuild
    assert index.clear(built).count() == 0


def test_embedding_is_incremental(spark):
    rows = [("a", "old text", [9.0], 1), ("b", "new\ntext here", None, None), ("c", "wrong dim", [1.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>, embedding_dim int")
    run, dim = embed.get_embedder("model", load=lambda: (lambda texts: [[float(len(t))] for t in texts]), dim=1, batch=2)
    got = {r.chunk_id: (r.embedding, r.embedding_dim) for r in embed.embed_missing(df, run, dim).collect()}
    assert got == {"a": ([9.0], 1), "b": ([13.0], 1), "c": ([9.0], 1)}
    run, dim = embed.get_embedder("no such name")
    vec = {r.chunk_id: r.embedding for r in run(df.drop("embedding"), "text", "embedding").collect()}
    assert dim == embed.dimension() == 64 and abs(sum(x * x for x in vec["b"]) - 1) < 1e-6


def test_links(spark):
    rows = [(-1001234, 5, "room"), (-1001234, 5, ""), (-1001234, 5, "  "), (-1001234, 5, None), (-55, 6, None), (77, 8, None), (0, 9, None), (-10, 1, None)]
    df = spark.createDataFrame(rows, "c long, m long, u string")
    got = [r.l for r in df.select(text.message_link(F.col("c"), F.col("m"), F.col("u")).alias("l")).collect()]
    assert got == [
        "https://t.me/room/5", *["https://t.me/c/1234/5"] * 3, "tg://openmessage?chat_id=-55&message_id=6",
        "tg://openmessage?user_id=77&message_id=8", "tg://openmessage?user_id=0&message_id=9", "tg://openmessage?chat_id=-10&message_id=1",
    ]


def test_ids(spark):
    df = spark.createDataFrame([("5_12",), ("12",), ("5_x",), ("unknown_chat_7",), ("5_1_000",)], "i string")
    rows = df.select(text.link_msg_id(F.col("i")).alias("n"), text.raw_id(F.col("i")).alias("r"), text.render_msg_id(F.col("i")).alias("h")).collect()
    assert [r.n for r in rows] == [12, 12, None, None, 1000]
    assert [r.r for r in rows] == ["12", "12", "x", "chat_7", "1_000"]
    assert all(0 <= r.h < 10**9 for r in rows)


def test_search_args(spark):
    said = ["/find 2.0 vpn tunnel", "0.5 test", "vpn tunnel", "/find", "2.0", "", "1e1 x", "nan y", "1d z"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = [tuple(r.p) for r in df.select(text.parse_search_args(F.col("s")).alias("p")).collect()]
    assert got[:7] == [
        (2.0, "vpn tunnel", None), (0.5, "test", None), (1.5, "vpn tunnel", None), (None, None, "usage"),
        (None, None, "threshold_without_query"), (None, None, "usage"), (10.0, "x", None),
    ]
    assert got[7][1] == "y" and got[8] == (1.5, "1d z", None)


def test_title_responses(spark):
    ok = '{"title": "T", "description": "D"}'
    said = [ok, f"```json\n{ok}\n```", f"x ```\n{ok}\n``` y", "{bad", "[1]", '{"title": "T"}', '{"title": " ", "description": "D"}', '{"title": null, "description": "D"}', "", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = [r.p.status for r in df.select(text.parse_title_response(F.col("s")).alias("p")).collect()]
    assert got == ["ok"] * 3 + ["invalid_json", "not_an_object", "missing_key", "empty_value", "empty_value", "empty_response", "empty_response"]


def test_title_response_is_one_value(spark):
    """What follows the first JSON value makes a response invalid."""
    one = '{"title": "a", "description": "b"}'
    said = [one, f" {one}\n", "12 words", f"{one} and more", f"{one}, {one}", "1], [2", '1}', '1, "b": 2', "12", "null", "[1, 2]"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = [r.p.status for r in df.select(text.parse_title_response(F.col("s")).alias("p")).collect()]
    assert got == ["ok", "ok"] + ["invalid_json"] * 6 + ["not_an_object"] * 3


def test_access(spark):
    rows = [(True, False, None, True, False), (True, False, None, False, True), (True, True, "/admin_set pw", False, False), (False, True, "/x", False, False), (False, False, None, False, True), (False, False, None, False, False)]
    df = spark.createDataFrame(rows, "p boolean, c boolean, t string, a boolean, l boolean")
    got = [tuple(r.d) for r in df.select(text.access_decision(*[F.col(c) for c in "pctal"]).alias("d")).collect()]
    assert got == [(True, None), (False, "private_non_admin"), (True, None), (True, None), (True, None), (False, "chat_not_whitelisted")]


def test_parts(spark):
    rows = [("1_1", "A" * 5096), ("1_2", ""), ("1_3", "<script>" * 3), ("1_4", ("word " * 400).strip()), ("1_5", "l\n" * 600)]
    df = spark.createDataFrame(rows, "msg_id string, text string").withColumns({"ts": F.expr("timestamp_ntz'2024-01-01 00:00:07.5'"), "from_id": F.lit("U")})
    got = {}
    for r in render.split_parts(df, 500).orderBy("msg_id", "part").collect():
        got.setdefault(r.msg_id, []).append(r)
    assert [r.part for r in got["1_2"]] == [None] and "<code>date: 2024-01-01T00:00:07.500000</code>" in got["1_2"][0].content
    assert "&lt;script&gt;" in got["1_3"][0].content
    assert all(len(r.content) <= 500 for k in got for r in got[k] if (r.part or 0) < 10)
    inner = lambda r: r.content.split("<pre>")[1][: -len("</pre>")]
    for name, body in rows[3:] + rows[:1]:
        assert "".join(map(inner, got[name])) == body
        assert all(inner(r)[-1] in " \n" for r in got[name][:-1]) or name == "1_1"


def test_insert_and_snapshots(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "c", t, "u", "x")], "msg_id string, chat_id string, ts timestamp_ntz, from_id string, text string")
    new = spark.createDataFrame([("a", "c", t, "u", "y"), ("b", "c", t, "u", "z"), ("b", "c", t, "u", "w")], old.schema)
    assert [(r.msg_id, r.text) for r in hydrate.insert_new(old, new).collect()] == [("b", "w")]
    assert tuple(hydrate.insert_counts(old, new).first()) == (1, 2)
    wide = mutate.evolve(old.drop("text"), old.schema)
    assert wide.columns == old.columns and wide.first().text is None
    delta = spark.createDataFrame([("a", None)], "msg_id string, text string")
    assert mutate.apply_delta(old, delta, "msg_id").first().text == "x"
    assert mutate.apply_delta(old, delta, "msg_id", keep_null=True).first().text is None
    assert mutate.lookup(old, "msg_id", "a").count() == 1


def test_chunk_messages_edges(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    m = spark.createDataFrame([(f"c_{i}", "c", t(i), "u", str(i)) for i in range(1, 6)] + [("d_2", "d", t(2), "u", "o")], "msg_id string, chat_id string, ts timestamp_ntz, from_id string, text string")
    rows = [("in", "c", "c_2", "c_4", None, None), ("one", "c", "c_3", "c_3", None, None), ("noend", "c", "c_2", "c_99", None, None), ("nostart", "c", "c_77", "c_4", None, None), ("null", "c", None, None, None, None), ("win", "c", "c_1", "c_1", t(2), t(3)), ("far", "c", "c_1", "c_2", t(20), t(21)), ("last", "c", "c_5", "c_1", t(20), t(21)), ("wide", "d", "d_2", "d_2", t(1), dt.datetime(2034, 1, 1))]
    c = spark.createDataFrame(rows, "chunk_id string, chat_id string, msg_id_start string, msg_id_end string, ts_from timestamp_ntz, ts_to timestamp_ntz")
    def got(by):
        out = {}
        for r in hydrate.chunk_messages(c, m, by).collect():
            out.setdefault(r.chunk_id, []).append(r.msg_id)
        return {k: sorted(v) for k, v in out.items()}
    ids = got("ids")
    assert ids["in"] == ["c_2", "c_3", "c_4"] and ids["one"] == ["c_3"] and ids["noend"] == ["c_2"]
    assert "nostart" not in ids and "null" not in ids
    ts = got("ts")
    assert ts["win"] == ["c_2", "c_3"] and ts["far"] == ["c_1", "c_2"] and ts["last"] == ["c_5"]
    assert ts["wide"] == ["d_2"]
    assert ts["noend"] == ["c_2", "c_3", "c_4", "c_5"]


def test_sample_chunks(spark):
    from threadloom.operators.topics import sample_chunks

    df = spark.range(60).select(
        F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") < 58, F.col("id") % 4).alias("topic_l1_id"), F.lit("t" * 300).alias("text")
    )
    pick = lambda frame, seed: sorted((r.topic_id, r.nth, r.chunk_id) for r in sample_chunks(frame, 5, seed).collect())
    one = pick(df, 1)
    assert len(one) == 20 and {t for t, _, _ in one} == {0, 1, 2, 3} and all(int(c) % 4 == t for t, _, c in one)
    assert one == pick(df.repartition(7), 1) and one != pick(df, 2)
    assert len(sample_chunks(df).first().block) == len("Chunk 1:\n") + 203


def test_long_texts_go_to_the_splitter_in_small_batches(spark):
    """Ten thousand long texts were one batch of a worker."""
    from threadloom.operators import render

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        rows = spark.createDataFrame([("1_1", "x" * 5000)], "msg_id string, text string").withColumns({"ts": F.expr("timestamp_ntz'2024-01-01 00:00:07'"), "from_id": F.lit("U")})
        assert render.split_parts(rows).count() == 2
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, old)
