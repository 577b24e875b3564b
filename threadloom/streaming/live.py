"""The live message flow: gate, count, route -- as a stream and as its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import access_decision, has_mention, search_mention
from ..operators.history import respond_every

USERNAME, ACCOUNT = "helper", 0


def gated(events: DataFrame, username: str = USERNAME, account_id: int = ACCOUNT) -> DataFrame:
    """Stateless part.  Expects ``text, entities, is_private, is_command, command, admin, listed``."""
    access = access_decision(F.col("is_private"), F.col("is_command"), F.col("command"), F.col("admin"), F.col("listed"))
    rows = events.withColumn("access", access).withColumn(
        "has_mention", has_mention(F.col("text"), F.col("entities"), username, account_id)
    )
    return rows.withColumn("search", search_mention(F.col("text"), F.col("has_mention"), username))


def route(reason: Column) -> Column:
    """Where an event goes: unheard, a search, a command, a question, or history only."""
    return (
        F.when(~F.col("access.allowed"), F.lit("denied"))
        .when(F.col("search").isNotNull(), F.lit("search"))
        .when(F.col("is_command"), F.lit("command"))
        .when(reason == "freq_zero_no_mention", F.lit("ignored"))
        .when(reason.startswith("freq_skip"), F.lit("listen"))
        .otherwise(F.lit("question"))
    )


def flow_batch(events: DataFrame, username: str = USERNAME, account_id: int = ACCOUNT) -> DataFrame:
    """Routes of a finished archive of events; denied events do not advance counters."""
    rows = gated(events, username, account_id)
    heard = respond_every(rows.filter("access.allowed"))
    denied = rows.filter("not access.allowed").withColumns(
        {"counter": F.lit(None).cast("long"), "reason": F.lit(None).cast("string"), "respond": F.lit(False)}
    )
    return heard.unionByName(denied).withColumn("route", route(F.coalesce("reason", F.lit(""))))


# --- keyed state -------------------------------------------------------------------

_COUNTED = "chat_id long, seq long, event_id long, counter long, reason string, respond boolean, hint string"


def _in_order(rows, column: str):
    """The rows of a key in a batch, which may come in several pieces, as one ordered frame."""
    import pandas as pd

    return pd.concat(list(rows), ignore_index=True).sort_values(column, kind="stable")


def _expiry(idle_ms: int | None):
    """Timers that end a key's state when nothing came for ``idle_ms``: (renew, is it due)."""

    def renew(handle, timer_values) -> None:
        if idle_ms is not None:
            for at in list(handle.listTimers()):
                handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + idle_ms)

    return renew, "None" if idle_ms is None else "ProcessingTime"


def _every_n_processor(renew):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class EveryN(StatefulProcessor):
        """One counter per chat; decisions follow the batch rule."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.counter = handle.getValueState("counter", "n long")

        def handleInputRows(self, key, rows, timerValues):
            n = self.counter.get()[0] if self.counter.exists() else 0
            out = []
            for e in _in_order(rows, "seq").itertuples(index=False):
                if e.is_reset:
                    n, reason = 0, "reset"
                elif e.is_command or e.is_private:
                    reason = "command_or_private"
                elif e.has_mention:
                    reason = "mentioned"
                elif e.frequency < 1:
                    reason = "freq_zero_no_mention"
                elif e.frequency == 1:
                    reason = "freq_one"
                else:
                    n += 1
                    reason = f"freq_{'match' if n % e.frequency == 0 else 'skip'}_{n}"
                respond = not reason.startswith("freq_skip") and reason not in ("freq_zero_no_mention", "reset")
                out.append((key[0], e.seq, e.event_id, n, reason, respond, e.hint))
            self.counter.update((n,))
            renew(self.handle, timerValues)
            yield pd.DataFrame(out, columns=["chat_id", "seq", "event_id", "counter", "reason", "respond", "hint"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.counter.clear()
            return iter(())

        def close(self) -> None:
            pass

    return EveryN()


_FLAGS = ("chat_id", "seq", "event_id", "frequency", "has_mention", "is_command", "is_private")


def _flagged(events: DataFrame, hint: Column) -> DataFrame:
    """What the counter needs; ``is_reset`` events are optional, as in ``respond_every``."""
    reset = F.col("is_reset") if "is_reset" in events.columns else F.lit(False)
    return events.select(*_FLAGS, reset.alias("is_reset"), hint.alias("hint"))


def _count(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    renew, mode = _expiry(idle_ms)
    return events.groupBy("chat_id").transformWithStateInPandas(
        statefulProcessor=_every_n_processor(renew), outputStructType=_COUNTED, outputMode="Append", timeMode=mode
    )


def respond_every_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming twin of ``respond_every``, resets included; rows of a batch count in ``seq`` order.

    A chat's counter is kept for ever, or until nothing came for ``idle_ms`` (it begins again at zero then)."""
    return _count(_flagged(events, F.lit("")), idle_ms).drop("hint")


def stored_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``chat_id, counter`` as a counting stream's last finished batch left them, from its state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "counter").load()
    return state.select(F.col("key.chat_id").alias("chat_id"), F.col("value.n").alias("counter"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream gives for all that is present now to the table at ``path``, and stops; the next run
    with the same checkpoint goes on with its state."""
    spark = stream.sparkSession
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # timers alone would keep such a run going for ever
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_SESSION = "conv_id long, turn long, depth int, usage long, reset boolean"


def _session_processor(max_tokens: int, template: str, renew):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    from .. import fixed

    frame = template.format(task="", context=fixed.EMPTY_CONTEXT, history="{h}")
    overhead = 2 + 4 + len("system") // 4 + 4 + len("user") // 4
    tail = 5

    class Session(StatefulProcessor):
        """The last five lines since the last reset."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.lines = handle.getListState("lines", "line string")

        def handleInputRows(self, key, rows, timerValues):
            lines = [r[0] for r in self.lines.get()]
            out = []
            for t in _in_order(rows, "turn").itertuples(index=False):
                text = "\n".join(lines).strip()
                usage = overhead + len(frame.replace("{h}", text)) // 4 if lines else 0
                depth = len(lines)
                reset = t.role == "user" and depth > 0 and usage >= max_tokens
                lines = ([] if reset else lines) + [("User: " if t.role == "user" else "Bot: ") + t.text]
                lines = lines[-tail:]
                out.append((key[0], t.turn, depth, usage, reset))
            self.lines.put([(line,) for line in lines])
            renew(self.handle, timerValues)
            yield pd.DataFrame(out, columns=["conv_id", "turn", "depth", "usage", "reset"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.lines.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Session()


def session_stream(turns: DataFrame, max_tokens: int = Config.max_context_tokens, template: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Streaming twin of ``session_reset``; a session ends too when nothing came for ``idle_ms``, if given."""
    from .. import fixed

    renew, mode = _expiry(idle_ms)
    return turns.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_session_processor(max_tokens, template or fixed.PROMPT_TEMPLATE, renew), outputStructType=_SESSION, outputMode="Append", timeMode=mode
    )


def flow_stream(events: DataFrame, username: str = USERNAME, account_id: int = ACCOUNT) -> DataFrame:
    """Streaming twin of ``flow_batch``: gate, keyed count, route; denied events pass uncounted."""
    rows = gated(events, username, account_id)
    hint = F.when(F.col("search").isNotNull(), F.lit("search")).when(F.col("is_command"), F.lit("command")).otherwise(F.lit(""))
    counted = _count(_flagged(rows.filter("access.allowed"), hint))
    to = (
        F.when(F.col("hint") != "", F.col("hint"))
        .when(F.col("reason") == "freq_zero_no_mention", F.lit("ignored"))
        .when(F.col("reason").startswith("freq_skip"), F.lit("listen"))
        .otherwise(F.lit("question"))
    )
    denied = rows.filter("not access.allowed").select(
        "chat_id", "seq", "event_id", F.lit(None).cast("long").alias("counter"), F.lit(None).cast("string").alias("reason"),
        F.lit(False).alias("respond"), F.lit("denied").alias("route"),
    )
    return counted.withColumn("route", to).drop("hint").unionByName(denied)
