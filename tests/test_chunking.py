"""Chunking against a plain restatement, with one chat over many partitions."""

import datetime as dt
import random

import pytest

from threadloom.config import Config
from threadloom.operators.chunking import apply_map, chunk_messages, exit_map, next_starts, open_at_end, last_start, first_break

TAIL = "\n[продолжение следует]"


def tokens(text):
    return len(text) // 4


def line(m):
    return f"[date: {m[1]:%Y-%m-%d %H:%M}] [user: {m[3]}] {m[4]}"


def head(c):
    return f"snippet: {c[0][1]:%Y-%m-%d %H:%M}–{c[-1][1]:%Y-%m-%d %H:%M}. participants: {', '.join(sorted({m[3] for m in c}))}.\n"


def restated(msgs, least, most, ratio):
    raw, held = [], 0
    for m in msgs:
        t = tokens(line(m))
        if raw and held + t <= most:
            raw[-1].append(m)
            held += t
        else:
            raw.append([m])
            held = t
    extended, before = [], []
    for c in raw:
        full = before + c
        extended.append(full)
        used, before = 0, []
        for m in full[::-1]:
            used += tokens(line(m))
            if used > int(most * ratio):
                break
            before = [m] + before
    out = []
    for i, c in enumerate(extended):
        size = sum(tokens(line(m)) for m in c) + tokens(head(c)) + (tokens(TAIL) if i < len(extended) - 1 else 0)
        if size < least and out:
            out[-1] = out[-1] + c
        else:
            out.append(c)
    return [(c[0][0], c[-1][0], len(c), head(c) + "\n".join(map(line, c)) + ("" if c[-1][0] == msgs[-1][0] else TAIL)) for c in out]


def archive(sizes, lengths, seed=5):
    rng = random.Random(seed)
    return [
        (f"{chat}_{i:05d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), chat, f"u{rng.randrange(5)}", "x" * rng.choice(lengths))
        for chat, n in sizes.items() for i in range(n)
    ]


SCHEMA = "msg_id string, ts timestamp_ntz, chat_id string, from_id string, text string"


@pytest.mark.parametrize("least,most,ratio,parts", [(50, 400, 0.3, 6), (200, 300, 0.9, 5), (10, 60, 0.5, 1)])
def test_matches_restatement(spark, least, most, ratio, parts):
    rows = archive({"big": 700, "one": 1, "c": 40, "two": 2}, [0, 5, 30, 80, 200, 600, 2500])
    cfg = Config(chunk_token_min=least, chunk_token_max=most, chunk_overlap_ratio=ratio)
    got = chunk_messages(spark.createDataFrame(rows, SCHEMA), cfg, parts=parts).collect()
    want = []
    for chat in {r[2] for r in rows}:
        want += [(chat, *w) for w in restated(sorted(r for r in rows if r[2] == chat), least, most, ratio)]
    assert sorted((r.chat_id, r.msg_id_start, r.msg_id_end, r.message_count, r.text) for r in got) == sorted(want)
    assert len({r.chunk_id for r in got}) == len(got)


def test_partition_maps_chain_like_one_scan():
    """The map of a run, applied to what came before it, equals scanning both together."""
    import numpy as np

    rng = random.Random(1)
    for nl in (0, 1):
        for _ in range(200):
            limit = rng.randrange(20, 60)
            a = np.array([rng.randrange(1, 70) for _ in range(rng.randrange(1, 25))])
            b = np.array([rng.randrange(1, 70) for _ in range(rng.randrange(1, 25))])
            end = lambda t: open_at_end(t, last_start(next_starts(t, limit, nl), 0), nl)
            assert apply_map(end(a), *exit_map(b, limit, nl)) == end(np.r_[a, b])
            joined = np.r_[a, b]
            at, nxt = 0, next_starts(joined, limit, nl)
            starts = set()
            while at < len(joined):
                starts.add(int(at))
                at = nxt[at]
            later = [s - len(a) for s in starts if s >= len(a)]
            assert first_break(b, end(a), limit, nl) == (min(later) if later else len(b))


def test_every_message_once_before_overlap(spark):
    from threadloom.operators.chunking import membership

    rows = archive({"a": 120, "b": 30}, [5, 50, 900], seed=2)
    cfg = Config(chunk_token_max=200)
    got = membership(spark.createDataFrame(rows, SCHEMA), cfg, parts=3).collect()
    own = [r for r in got if not r.is_overlap]
    assert sorted(r.msg_id for r in own) == sorted(r[0] for r in rows)
    sizes = {}
    for r in own:
        sizes.setdefault(r.chunk_pos, []).append(r.tok)
    assert all(sum(t) <= 200 or len(t) == 1 for t in sizes.values())


def test_no_messages(spark):
    assert chunk_messages(spark.createDataFrame([], SCHEMA)).count() == 0
