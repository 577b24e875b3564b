"""JSON arrays and text lines read by byte ranges."""

import json
import random

import numpy as np
import pytest

from threadloom.sources import arrays, dumps


@pytest.fixture
def ranges(spark):
    """Sets the size of a byte range."""

    def small(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield small
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


def states(text):
    """Inside a string and depth before each byte, one byte at a time."""
    inside, depth, escaped, out = False, 0, False, []
    for c in text:
        out.append((inside, depth))
        if escaped:
            escaped = False
        elif c == 92:
            escaped = True
        elif c == 34:
            inside = not inside
        elif not inside and c in b"{[":
            depth += 1
        elif not inside and c in b"}]":
            depth -= 1
    return [*out, (inside, depth)]


HARD = [
    {"id": 1, "date": "2024-01-01T10:00:00", "sender": 'A "q" \\', "content": "},{ [ ] } \\\" end\\\\"},
    {"id": "2", "date": "2024-01-02T10:00:00", "content": "é漢\U0001f600}\n{", "more": {"deep": [{"x": "}"}, {"y": {}}], "s": "{{{{["}},
    {"id": 3, "date": "2024-01-03T00:00:00", "sender": None, "content": "\"}" * 30},
    {},
    {"id": 5, "date": "2024-01-05T00:00:00", "content": "x" * 300},
]


def plain(items, name):
    return [(None if i.get("id") is None else str(i["id"]), i.get("sender") or "Unknown", i.get("content") or "", name) for i in items]


def listed(frame):
    return sorted(((r.id, r.sender, r.content, r.file_name) for r in frame.collect()), key=str)


def test_states_from_every_cut():
    """Effects of all prefixes compose to the states of a scan byte by byte."""
    data = np.frombuffer(json.dumps(HARD, ensure_ascii=False).encode(), np.uint8)
    want = states(data.tolist())
    cut_at = [0, *(np.flatnonzero(data == 125) + 1).tolist()]
    for a in cut_at:
        flips, outside, inside = arrays.effect(data[:a])
        assert (bool(flips), outside) == want[a]
        flips, outside, inside = arrays.effect(data[a:])
        assert (want[a][0] ^ bool(flips), want[a][1] + (inside if want[a][0] else outside)) == want[-1]
        found, *end = arrays.cuts(data[a:], int(want[a][0]), want[a][1])
        assert tuple(end) == (int(want[-1][0]), want[-1][1])
        assert (found + a).tolist() == [i + 1 for i in range(a, len(data)) if data[i] == 125 and not want[i][0] and want[i + 1][1] == 1]


@pytest.mark.parametrize("size", [23, 97])
@pytest.mark.parametrize("layout", ["compact", "indented"])
def test_hard_texts_at_many_cuts(spark, tmp_path, ranges, size, layout):
    text = json.dumps(HARD, ensure_ascii=False) if layout == "compact" else " \n" + json.dumps(HARD, indent=3) + "\n\n"
    (tmp_path / "telegram_dump_1.json").write_text(text, encoding="utf-8")
    (tmp_path / "telegram_dump_2.json").write_text(json.dumps(HARD[:1], separators=(",", ":")))
    ranges(size)
    frame = dumps.read_dump(spark, str(tmp_path))
    assert listed(frame) == sorted(plain(HARD, "telegram_dump_1.json") + plain(HARD[:1], "telegram_dump_2.json"), key=str)


def test_every_shift_of_a_cut(spark, tmp_path, ranges):
    """Blanks before the array move a cut of the file over all of its bytes."""
    items = HARD[:2]
    body = json.dumps(items, ensure_ascii=False).encode()
    for shift in range(0, len(body), 9):
        (tmp_path / f"telegram_dump_{shift}.json").write_bytes(b" " * shift + body)
    ranges(len(body))
    rows = arrays.read_objects(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(range(0, len(body), 9)) and {r.text for r in rows} == {json.dumps(i, ensure_ascii=False) for i in items}


def test_a_large_file_is_many_tasks(spark, tmp_path, ranges):
    pick = random.Random(3)
    items = [{"id": i, "date": "2024-01-01T00:00:00", "sender": "s", "content": "".join(pick.choice('ab}{",[]\\é ') for _ in range(pick.randrange(300)))} for i in range(6000)]
    items[77]["content"] = "y}" * 90_000  # longer than a range
    (tmp_path / "telegram_dump_9.json").write_text(json.dumps(items, ensure_ascii=False), encoding="utf-8")
    ranges(64 * 1024)
    frame = dumps.read_dump(spark, str(tmp_path))
    assert arrays._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert listed(frame) == sorted(plain(items, "telegram_dump_9.json"), key=str)
    # a join without broadcast keeps the order within ranges
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert listed(dumps.read_dump(spark, str(tmp_path))) == sorted(plain(items, "telegram_dump_9.json"), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_is_no_array_gives_no_rows(spark, tmp_path, ranges):
    for i, text in enumerate(['{"a": [{"id": 1}]}', "", "  \n ", '"[{}]"', "12", "[]", " [ \n ] "]):
        (tmp_path / f"{i}.json").write_text(text)
    ranges(5)
    assert dumps.read_dump(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", ['[{"id": 1}', '[{"id": 1} {"id": 2}]', '[{"id": 1}, 2]', '[1]', '[[{"id": 1}]]', '[{"id": 1}],', '[,{"id": 1}]', '[{"id": }]', '[{"id": "a]', '[{"id": 1}]}', "["])
def test_malformed_files_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a readable dump"):
        dumps.read_dump(spark, str(tmp_path)).count()


@pytest.mark.parametrize("size", [7, 64])
def test_line_numbers_over_ranges(spark, tmp_path, ranges, size):
    texts = {"a.txt": "one\r\n\r\n  two \rthree\n\n\nfour", "b.txt": "\n" * 50 + "é漢\n" * 40, "c.txt": "", "d.txt": " \n\t\n", "e.txt": "x" * 500 + "\r\n" + "y"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    ranges(size)
    rows = dumps.read_lines(spark, str(tmp_path), "2024-01-01 00:00:00").collect()
    want = [(name, str(i), line.strip()) for name, text in texts.items() for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")) if line.strip()]
    assert sorted((r.file_name, r.id, r.content) for r in rows) == sorted(want)


def test_written_arrays(spark, tmp_path):
    rows = [(c, str(i), f"2024-01-01T00:{i:02}:00", "s", f"[{i}]" if i else None) for c in (-100, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "chat_id long, id string, date string, sender string, content string")
    dumps.write_dump_arrays(df.repartition(3), str(tmp_path / "d"))
    back = dumps.to_messages(dumps.read_dump(spark, str(tmp_path / "d"), name_part=-2)).collect()
    assert sorted((r.msg_id, r.text) for r in back) == sorted((f"{c}_{i}", t or "") for c, i, _, _, t in rows)
    for file in (tmp_path / "d").rglob("part-*"):
        assert isinstance(json.loads(file.read_text()), list)
    dumps.write_dump_arrays(df.limit(0), str(tmp_path / "e"))
