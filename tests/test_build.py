"""The full build and the streaming twins."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.operators import history, search
from threadloom.plans import bindings as b
from threadloom.plans import archive_queries as aq
from threadloom.plans.build import Archive, EmptyInput, build
from threadloom.streaming import ingest, live

SF = "/root/testdata/sf0.001"


def titles(requests):
    return requests.select("topic_id", F.to_json(F.struct(F.concat(F.lit("T"), "topic_id").alias("title"), F.lit("d").alias("description"))).alias("response"))


def test_build_and_ask(spark, tmp_path):
    cfg = Config(chunk_token_max=200, min_cluster_size=2)
    archive = build(spark, b.messages(spark, SF), str(tmp_path), cfg, "p1", titles)
    t = archive.tables()
    n = t["chunks"].count()
    assert n > 0 and t["chunks"].filter("embedding is null").count() == 0 and t["index_chunks"].count() == n
    assert t["messages"].count() == b.messages(spark, SF).count()
    assert t["topics_l1"].count() > 1
    assert t["topics_l1"].filter("title = 'unknown'").count() == 0
    report = {(r.stage, r.metric): r.value for r in archive.report().collect()}
    assert report["chunks", "chunks"] == n and report["vectors", "orphans"] == 0
    # a rerun inserts nothing and gives the same chunks
    before = {r.chunk_id for r in t["chunks"].select("chunk_id").collect()}
    archive.messages(b.messages(spark, SF))
    archive.chunks(cfg)
    assert {r.chunk_id for r in archive.read("chunks").select("chunk_id").collect()} == before
    assert archive.read("chunks").filter("embedding is null").count() == 0  # nothing is embedded again
    assert archive.read("messages").count() == b.messages(spark, SF).count()
    # every chunk finds itself first
    q = t["chunks"].select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = search.search_direct(q, t["chunks"], 1).filter("distance > 1e-9").count()
    assert got == 0
    archive.reset(6)
    assert archive.read("topics_l2").count() == 0 and archive.read("chunks").filter("topic_l2_id is not null").count() == 0
    archive.reset()
    assert all(df.count() == 0 for df in archive.tables().values())


def test_preconditions(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), "empty")
    for stage in (archive.chunks, archive.vectors, archive.chunk_index, archive.topics_l1, archive.topics_l2):
        with pytest.raises(EmptyInput):
            stage()
    archive.append("messages", [{"msg_id": "1_1", "chat_id": "1", "text": "hi"}])
    assert archive.read("messages").first().text == "hi"
    with pytest.raises(ValueError):
        Config(chunk_overlap_ratio=2.0)


def stream(spark, df, path, order, transform, name):
    """Drives two batches of rows through a streaming transform."""
    df = df.withColumn("_half", F.ntile(2).over(__import__("pyspark").sql.Window.orderBy(order)))
    for half in (1, 2):
        df.filter(F.col("_half") == half).drop("_half").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.drop("_half").schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = transform(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark


def needs_state_runtime():
    try:
        import google.protobuf  # noqa: F401
    except ImportError:
        pytest.skip("keyed stream state needs protobuf")


def test_every_n_stream(rocks, tmp_path):
    needs_state_runtime()
    events = aq.counter_events(rocks, SF)
    got = stream(rocks, events, str(tmp_path / "e"), "seq", live.respond_every_stream, "every_n")
    want = history.respond_every(events)
    key = lambda df: sorted(tuple(r) for r in df.select("event_id", "reason", "respond").collect())
    assert key(got) == key(want)


def test_idle_counters_expire(spark, tmp_path):
    needs_state_runtime()
    import time

    rows = [(c, s, s, 3, False, False, False) for s, c in enumerate([1, 2, 1, 2, 2])] + [(2, 10, 10, 3, False, False, False)]
    schema = "chat_id long, seq long, event_id long, frequency int, has_mention boolean, is_command boolean, is_private boolean"
    df = spark.createDataFrame(rows, schema)
    for idle, left in ((None, {1: 2, 2: 4}), (1, {2: 4})):
        at = tmp_path / str(idle)
        for part in ("seq < 10", "seq >= 10"):
            df.filter(part).write.mode("append").parquet(str(at / "in"))
            stream = live.respond_every_stream(spark.readStream.schema(df.schema).parquet(str(at / "in")), idle)
            live.run_available(stream, str(at / "out"), str(at / "state"))
            time.sleep(0.1)
        assert {r.chat_id: r.counter for r in live.stored_counters(spark, str(at / "state")).collect()} == left
        assert sorted((r.seq, r.counter) for r in spark.read.parquet(str(at / "out")).collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (10, 4)]


def test_pieces_of_a_key_count_in_order():
    import pandas as pd

    pieces = [pd.DataFrame({"seq": [3, 1]}), pd.DataFrame({"seq": [0, 2]})]
    assert live._in_order(iter(pieces), "seq")["seq"].tolist() == [0, 1, 2, 3]


def test_flow_stream(rocks, tmp_path):
    needs_state_runtime()
    events = aq.live_events(rocks, SF)
    got = stream(rocks, events, str(tmp_path / "f"), "seq", live.flow_stream, "flow")
    want = live.flow_batch(events)
    key = lambda df: sorted(tuple(r) for r in df.select("event_id", "route").collect())
    assert key(got) == key(want)


def test_session_stream(rocks, tmp_path):
    needs_state_runtime()
    turns = b.table(rocks, SF, "conversations")
    got = stream(rocks, turns, str(tmp_path / "s"), "turn", lambda s: live.session_stream(s, 600), "session")
    want = history.session_reset(turns, 600)
    key = lambda df: sorted(tuple(r) for r in df.select("conv_id", "turn", "depth", "usage", "reset").collect())
    assert key(got) == key(want)


def test_dump_stream(spark, tmp_path):
    source, table, checkpoint = tmp_path / "in", str(tmp_path / "messages"), str(tmp_path / "ck")
    source.mkdir()
    item = lambda i, day: {"id": i, "date": f"2024-01-{day:02d}T00:00:00", "sender": "A", "content": f"m{i}"}
    (source / "telegram_dump_1.json").write_text(json.dumps([item(1, 1), item(2, 2), item(2, 2)]))
    ingest.ingest(spark, str(source), table, checkpoint).awaitTermination()
    (source / "telegram_dump_2.json").write_text(json.dumps([item(1, 20)]))
    ingest.ingest(spark, str(source), table, checkpoint).awaitTermination()
    (source / "more").mkdir()
    (source / "more" / "telegram_dump_1.json").write_text(json.dumps([item(2, 21), item(3, 22)]))
    ingest.ingest(spark, str(source), table, checkpoint).awaitTermination()
    assert sorted(r.msg_id for r in spark.read.parquet(table).collect()) == ["1_1", "1_2", "1_3", "2_1"]


def test_dump_stream_in_descending_time(spark, tmp_path):
    """Older archives after newer ones, one file a batch: nothing is lost."""
    import os

    source, table = tmp_path / "in", str(tmp_path / "messages")
    source.mkdir()
    for n, year in enumerate((2024, 2023, 2022)):
        path = source / f"telegram_dump_{n}.json"
        path.write_text(json.dumps([{"id": i, "date": f"{year}-01-0{i}T00:00:00", "sender": "A", "content": "m"} for i in range(1, 6)]))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    ingest.ingest(spark, str(source), table, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(table).select("msg_id").distinct().count() == 15
