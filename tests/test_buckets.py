"""Bucket tables: equal to whole-table changes, untouched files stay, few files are opened."""

import os

import pytest

from threadloom.operators import mutate
from threadloom.operators.buckets import BucketTable


def files(path):
    return {os.path.relpath(os.path.join(a, f), path) for a, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.fixture()
def rows(spark):
    out = [(f"k{i}", i, f"text {i}") for i in range(400)] + [(None, -1, "no key")]
    return spark.createDataFrame(out, "id string, topic long, text string")


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_deltas_rewrite_what_they_touch(spark, rows, tmp_path):
    table = BucketTable.create(rows, str(tmp_path), "id", 16)
    assert listed(table.read()) == listed(rows)
    delta = spark.createDataFrame([("k5", 1000), ("k5000", 1), (None, 7), ("k6", None)], "id string, topic long")
    stored = files(tmp_path / "rows")
    for keep_null in (False, True):
        want = mutate.apply_delta(table.read(), delta, "id", keep_null)
        want = listed(want)
        table = table.apply(delta, keep_null)
        assert listed(table.read()) == want == listed(BucketTable(spark, str(tmp_path)).read())
    assert stored < files(tmp_path / "rows")  # nothing stored is written again
    touched = {g for g in table.generations.values()}
    assert touched == {0, 2} and sum(g == 0 for g in table.generations.values()) >= 13
    again = table.apply(delta.limit(0))
    assert again.generations == table.generations


def test_a_lost_change_is_not_seen(spark, rows, tmp_path, monkeypatch):
    table = BucketTable.create(rows, str(tmp_path), "id", 4)
    monkeypatch.setattr(table.manifest, "publish", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
    delta = spark.createDataFrame([("k5", 1000)], "id string, topic long")
    with pytest.raises(RuntimeError):
        table.apply(delta)
    again = BucketTable(spark, str(tmp_path))
    assert listed(again.read()) == listed(rows)
    assert again.apply(delta).lookup(delta).first().topic == 1000


@pytest.mark.parametrize("named", [1000, 1])
def test_lookup(spark, rows, tmp_path, monkeypatch, named):
    from threadloom.operators import buckets

    monkeypatch.setattr(buckets, "NAMED_KEYS", named)
    table = BucketTable.create(rows, str(tmp_path), "id", 16)
    asked = spark.createDataFrame([("k7",), ("k300",), ("k7",), ("none",), (None,)], "id string")
    found = table.lookup(asked)
    assert sorted(r.id for r in found.collect()) == ["k300", "k7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ("In(id" in plan) == (named == 1000)
    assert table.lookup(asked.limit(0)).count() == 0


def test_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        BucketTable(spark, str(tmp_path / "x"))
