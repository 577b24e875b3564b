"""JSON arrays read by many tasks: byte ranges of a file, a prefix scan over them, objects where they begin.

The text source cuts a file at every ``}``, so Spark deals byte ranges of any size to tasks. A range
first says what it does to the two states it may be entered in, inside a string or outside: whether it
flips them, and by how much the depth of brackets grows. Two running sums over the ranges of a file
(one row each) give every range its true state. A second scan then cuts the text behind each ``}`` that
closes an object of the top-level array. Objects that lie in one range stay in its task; the text before
the first and behind the last such place of a range is put together with that of its neighbours by
one small grouping, which holds an object's own pieces only.

What is cut must be ``[`` or ``,`` and one object, what is left at the end ``]``; anything else is an error, as
is a file that ends early. Files whose first character is not ``[`` give no rows, empty and blank ones neither.
A byte order mark is skipped. Compressed files are one range each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE, _BACKSLASH, _CLOSE = 34, 92, 125
_STEP = np.zeros(256, np.int64)
_STEP[[123, 91]], _STEP[[125, 93]] = 1, -1
_BLANK = b" \t\n\r"

SUMMARY = "path string, at long, bytes long, flips int, outside long, inside long, lead string, whole long"
PART = "path string, at long, part int, text binary"
#: Where a part lies in its range: before the first cut, between two, behind the last, no cut at all.
HEAD, WHOLE, TAIL, THROUGH = range(4)


def quotes(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a quote that is not escaped. Escapes never reach over a ``}``."""
    quote = data == _QUOTE
    slash = data == _BACKSLASH
    behind = np.flatnonzero(quote[1:] & slash[:-1]) + 1
    if len(behind):
        ends = np.flatnonzero(~slash)  # the run of backslashes before a quote begins behind the last other byte
        place = np.searchsorted(ends, behind) - 1
        run = behind - 1 - np.where(place >= 0, ends[place], -1)
        quote[behind[run % 2 == 1]] = False
    return quote


def effect(data: np.ndarray) -> tuple[int, int, int]:
    """(number of quotes modulo 2, change of depth if entered outside a string, and if inside)."""
    inside = np.cumsum(quotes(data)) % 2 == 1
    step = _STEP[data]
    total, within = int(step.sum()), int(step[inside].sum())
    return int(inside[-1]) if len(data) else 0, total - within, within


def cuts(data: np.ndarray, flips: int, depth: int) -> tuple[np.ndarray, int, int]:
    """Places behind each ``}`` outside strings that brings the depth to 1, and the state at the end."""
    inside = (np.cumsum(quotes(data)) + flips) % 2 == 1
    step = np.where(inside, 0, _STEP[data])
    after = depth + np.cumsum(step)
    found = np.flatnonzero((data == _CLOSE) & ~inside & (after == 1)) + 1
    return found, int(inside[-1]) if len(data) else flips, int(after[-1]) if len(data) else depth


def _ranges(batches, more: tuple[str, ...] = ()):
    """(path, at, other values, bytes with their ``}``) of neighbouring rows of the same range."""
    for batch in batches:
        rows = len(batch)
        if not rows:
            continue
        path, at = batch["path"], batch["at"].to_numpy()
        codes = path.dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero((codes[1:] != codes[:-1]) | (at[1:] != at[:-1])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), rows], strict=True):
            text = b"}".join(batch["value"].slice(a, b - a).to_pylist()) + b"}"
            yield path[a].as_py(), int(at[a]), tuple(batch[c][a].as_py() for c in more), np.frombuffer(text, np.uint8)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("at"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))


def _summaries(pieces: DataFrame) -> DataFrame:
    """One row for each byte range."""

    def task(batches):
        now, row = None, None

        def out():
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("flips", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("lead", pa.string()), ("whole", pa.int64())]))

        for path, at, (size,), data in _ranges(batches, ("size",)):
            if (path, at) != now:
                if now is not None:
                    yield out()
                now = (path, at)
                row = {"path": path, "at": at, "bytes": 0, "flips": 0, "outside": 0, "inside": 0, "lead": None, "whole": size}
            flips, outside, inside = effect(data)
            if row["flips"]:  # what was entered outside is inside by now
                outside, inside = inside, outside
            row["bytes"] += len(data)
            row["outside"] += outside
            row["inside"] += inside
            row["flips"] ^= flips
            if row["lead"] is None and (rest := data.tobytes().lstrip(_BLANK)):
                row["lead"] = chr(rest[0])
        if now is not None:
            yield out()

    return pieces.select("path", "at", "size", "value").mapInArrow(task, SUMMARY)


def _states(pieces: DataFrame) -> DataFrame:
    """``path, at, flips, depth`` at the beginning of each range of the files that hold an array."""
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _summaries(pieces)
    rows = rows.withColumn("entered", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).withColumn("first", F.first("lead", ignorenulls=True).over(file))
    rows = rows.withColumn("grows", F.when(F.col("entered") == 0, F.col("outside")).otherwise(F.col("inside")))
    depth = F.coalesce(F.sum("grows").over(before), F.lit(0))
    # the text behind the last } of a file has no } of its own, so all bytes and one more are counted (or three less, a mark)
    ended = F.sum("bytes").over(file) - F.col("whole")
    broken = F.raise_error(F.concat(F.lit("not a readable dump: "), F.col("path"))).cast("boolean")
    sound = F.when((ended == 1) | (ended == -2), True).otherwise(broken)
    rows = rows.select("path", "at", F.col("entered").cast("int").alias("flips"), depth.alias("depth"), "first", sound.alias("sound"))
    return rows.where(F.col("first") == "[").where("sound").select("path", "at", "flips", "depth")


def _parts(placed: DataFrame, edges: bool) -> DataFrame:
    """The whole objects of each range, or (``edges``) what lies before and behind them."""

    def task(batches):
        now, state, head, rest = None, None, True, []
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("part", pa.int32()), ("text", pa.binary())])

        def rows(texts, part):
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n), pa.array([now[1]] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.binary())], schema=schema)

        for path, at, entered, data in _ranges(batches, ("flips", "depth")):
            if (path, at) != now:
                if edges and now is not None:
                    yield rows([b"".join(rest)], THROUGH if head else TAIL)
                now, state, head, rest = (path, at), entered, True, []
            found, *state = cuts(data, *state)
            text, last = data.tobytes(), 0
            if head and len(found):
                if edges:
                    yield rows([b"".join([*rest, text[: found[0]]])], HEAD)
                head, rest, last = False, [], int(found[0])
                found = found[1:]
            if len(found):
                if not edges:
                    places = [last, *found.tolist()]
                    texts = [text[a:b] for a, b in zip(places, places[1:], strict=False)]
                    texts[0] = b"".join([*rest, texts[0]])
                    yield rows(texts, WHOLE)
                rest, last = [], int(found[-1])
            rest.append(text[last:])
        if edges and now is not None:
            yield rows([b"".join(rest)], THROUGH if head else TAIL)

    return placed.mapInArrow(task, PART)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: the objects of the top-level arrays of the files, each as JSON text."""
    pieces = _pieces(spark, path)
    placed = pieces.withColumn("seq", F.monotonically_increasing_id()).join(_states(pieces), ["path", "at"])
    # a range's rows in their order, however Spark joins its one row of state to them
    placed = placed.sortWithinPartitions("path", "at", "seq").select("path", "at", "flips", "depth", "value")
    whole = _parts(placed, edges=False).select("path", F.col("text").cast("string").alias("text"), F.lit(False).alias("first"))

    edges = _parts(placed, edges=True)
    order = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut_in = edges.groupBy("path", "at").agg(F.max((F.col("part") == HEAD).cast("int")).alias("cut"))
    number = cut_in.select("path", "at", F.coalesce(F.sum("cut").over(order), F.lit(0)).alias("n"), F.max("at").over(Window.partitionBy("path")).alias("end"), "cut")
    joined = edges.join(number, ["path", "at"]).select("path", "at", "part", "text", (F.col("n") + (F.col("part") == TAIL).cast("int")).alias("n"), ((F.col("at") == F.col("end")) & (F.col("part") != HEAD)).alias("last"))
    pieces_of = F.sort_array(F.collect_list(F.struct("at", "text")))
    joined = joined.groupBy("path", "n").agg(pieces_of.alias("x"), F.max("last").alias("last"))
    text = F.array_join(F.transform("x", lambda p: p["text"].cast("string")), "")
    joined = joined.select("path", text.alias("text"), (F.col("n") == 0).alias("first"), "last")

    broken = F.raise_error(F.concat(F.lit("not a readable dump: "), F.col("path"))).cast("boolean")
    begins = F.when(F.col("first"), F.lit(r"^[ \t\n\r]*\[[ \t\n\r]*\{")).otherwise(F.lit(r"^[ \t\n\r]*,[ \t\n\r]*\{"))
    objects = whole.union(joined.where("NOT last").select("path", "text", "first"))
    objects = objects.where(F.when(F.regexp(F.col("text"), begins), True).otherwise(broken))
    # the end of a file, behind which the text source had no } to cut
    ends = F.when(F.col("first"), F.lit(r"^[ \t\n\r]*\[[ \t\n\r]*\][ \t\n\r]*\}$")).otherwise(F.lit(r"^[ \t\n\r]*\][ \t\n\r]*\}$"))
    tails = joined.where("last").where(F.when(F.regexp(F.col("text"), ends), False).otherwise(broken)).select("path", "text", "first")
    return objects.union(tails).select("path", F.regexp_replace("text", r"^[ \t\n\r]*[\[,][ \t\n\r]*", "").alias("text"))
