"""The table of runs: equal to a table without repeats, few runs read, safe to repeat."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.schemas import MESSAGES
from threadloom.streaming import store as st
from threadloom.streaming.store import MessageStore


def rows(spark, ids):
    return spark.createDataFrame([(f"1_{i}", "1", None, "s", f"text {i}") for i in ids], MESSAGES)


def test_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FAN", 3)
    pick = random.Random(4)
    table, held, read = MessageStore(spark, str(tmp_path)), set(), []
    keep = MessageStore._rows
    monkeypatch.setattr(MessageStore, "_rows", lambda self, runs: read.append(len(runs)) or keep(self, runs))
    for batch in range(14):
        new = range(batch * 20, batch * 20 + 20)
        again = pick.sample(sorted(held), 2) if batch % 5 == 4 else []
        before, read[:] = len(table.runs()), []
        added = table.insert(rows(spark, [*new, *again, new[0]]), batch)
        assert read[0] <= len({i // 20 for i in again}) + 1  # at most the runs of repeated ids, and a chance hit
        assert before <= 2 * st.FAN + 1
        if batch % 5 == 4:
            assert sorted(r.msg_id for r in added.collect()) == sorted(f"1_{i}" for i in new)
        held |= set(new)
    got = [r.msg_id for r in table.read().select("msg_id").collect()]
    assert sorted(got) == sorted(f"1_{i}" for i in held)
    assert len(table.runs()) <= 2 * st.FAN


def test_a_batch_that_comes_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FAN", 3)
    table = MessageStore(spark, str(tmp_path))
    for batch in range(st.FAN):
        table.insert(rows(spark, range(batch * 5, batch * 5 + 7)), batch)
    assert [r["level"] for r in table.runs()] == [1]
    want = sorted(r.msg_id for r in table.read().collect())
    table.insert(rows(spark, range((st.FAN - 1) * 5, (st.FAN - 1) * 5 + 7)), st.FAN - 1)  # merged already
    assert sorted(r.msg_id for r in table.read().collect()) == want == sorted(f"1_{i}" for i in range(st.FAN * 5 + 2))
    # a run without its manifest is not there
    table._add_run(rows(spark, [900]), "batch-99", 0)
    assert table.read().filter("msg_id = '1_900'").count() == 0
    table.insert(rows(spark, [900, 901]), 99)
    assert table.read().filter("msg_id IN ('1_900', '1_901')").count() == 2


def test_filters_have_no_false_negatives(spark, tmp_path):
    table = MessageStore(spark, str(tmp_path))
    table.insert(rows(spark, range(0, 9000, 3)), 0)
    table.insert(rows(spark, range(1, 9000, 3)), 1)
    for i in (0, 3, 8997):
        assert "batch-0" in {r["run"] for r in table.suspects(rows(spark, [i]))}
    wrong = table.spark.createDataFrame([(f"2_{i}",) for i in range(2000)], "msg_id string")
    bits = table.runs()[0]["bits"]
    asked = st.positions(wrong, F.lit(bits)).selectExpr("msg_id", f"at DIV {st.PIECE} AS piece", f"at % {st.PIECE} AS spot")
    words = spark.read.parquet(str(tmp_path / "filters/batch-0"))
    byte = F.conv(F.hex(F.expr("substring(word, int(spot DIV 8 + 1), 1)")), 16, 10).cast("int")
    hit = asked.join(words, "piece").withColumn("b", byte).where("(shiftright(b, int(spot % 8)) & 1) = 1").groupBy("msg_id").count()
    assert hit.where(F.col("count") == st.HASHES).count() < 60  # about one in a hundred


def test_empty_batches(spark, tmp_path):
    table = MessageStore(spark, str(tmp_path))
    assert table.read().count() == 0 and table.suspects(rows(spark, [1])) == []
    table.insert(rows(spark, []), 0)
    assert table.read().count() == 0
    with pytest.raises(Exception):
        table._rows([{"run": "none"}]).count()
