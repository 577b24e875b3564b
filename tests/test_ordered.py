"""Ordered operators when one key spans many segments."""

import random

from threadloom.operators import history


def test_every_n_over_segments(spark):
    rng = random.Random(3)
    rows, want, count = [], {}, {}
    for i in range(400):
        chat = 1 if rng.random() < 0.7 else rng.randrange(2, 6)
        mention, command, private, reset = (rng.random() < 0.1 for _ in range(4))
        freq = chat % 4
        rows.append((chat, i, freq, mention, command, private, reset))
        if reset:
            count[chat] = 0
            want[i] = "reset"
        elif command or private:
            want[i] = "command_or_private"
        elif mention:
            want[i] = "mentioned"
        elif freq < 1:
            want[i] = "freq_zero_no_mention"
        elif freq == 1:
            want[i] = "freq_one"
        else:
            count[chat] = count.get(chat, 0) + 1
            want[i] = f"freq_{'match' if count[chat] % freq == 0 else 'skip'}_{count[chat]}"
    df = spark.createDataFrame(rows, "chat_id long, seq long, frequency int, has_mention boolean, is_command boolean, is_private boolean, is_reset boolean")
    got = {r.seq: r.reason for r in history.respond_every(df, parts=5).collect()}
    assert got == want


def test_small_sequences(spark):
    rows = [(c, s, 2 if c == 1 else 5, False, False, False) for c in (1, 2) for s in range(10)]
    df = spark.createDataFrame(rows, "chat_id long, seq long, frequency int, has_mention boolean, is_command boolean, is_private boolean")
    got = history.respond_every(df).filter("respond").collect()
    assert sorted((r.chat_id, r.seq) for r in got) == [(1, 1), (1, 3), (1, 5), (1, 7), (1, 9), (2, 4), (2, 9)]


def turns(n=150):
    rng = random.Random(8)
    return [(1 if rng.random() < 0.8 else 2, i, rng.choice(["user", "assistant"]), "w" * rng.randrange(1, 600)) for i in range(n)]


def expected_sessions(rows, limit):
    from threadloom import fixed

    lines, out = {}, {}
    for conv, turn, role, text in rows:
        held = lines.setdefault(conv, [])
        usage = 0
        if held:
            prompt = fixed.PROMPT_TEMPLATE.format(task="", context=fixed.EMPTY_CONTEXT, history="\n".join(held[-5:]).strip())
            usage = 12 + len(prompt) // 4
        reset = role == "user" and bool(held) and usage >= limit
        out[turn] = (usage, reset)
        if reset:
            held.clear()
        held.append(("User: " if role == "user" else "Bot: ") + text)
    return out


def test_session_reset_over_segments(spark):
    rows = turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (420, 600):
        got = {r.turn: (r.usage, r.reset) for r in history.session_reset(df, limit, parts=6).collect()}
        assert got == expected_sessions(rows, limit)


def test_history_window_over_segments(spark):
    rows = turns(60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.history for r in history.history_window(df, parts=6).collect()}
    for conv in (1, 2):
        mine = [r for r in rows if r[0] == conv]
        for i, r in enumerate(mine):
            lines = [("User: " if p[2] == "user" else "Bot: ") + p[3] for p in mine[max(0, i - 5) : i]]
            assert got[r[1]] == ("\n".join(lines) if lines else "Нет недавних сообщений.")


def test_templates(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    lit = [F.lit(x) for x in ("T", "{history}", "H")]
    assert one.select(history.fill_template(*lit, template="a {task} b {context}{{}} {history}").alias("p")).first().p == "a T b {history}{} H"
    assert one.select(history.fill_template(*lit, template="{nope}").alias("p")).first().p.startswith("Error in system prompt template: 'nope'\nUsing default.\n")
