"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``HALVES`` half-keys are made from ``PER_HALF`` minhashes each; every pair of a
half-key from either collection is a table key. So ``HALVES ** 2`` tables cost only
``2 * HALVES * PER_HALF`` minhashes (100 tables from 40, where plain banding needs 400). Documents
of similarity ``s`` meet in no table with probability at most ``2 * (1 - s ** PER_HALF) **
HALVES``: 0.0005 at 0.75, 0.00007 at 0.8.

Documents with equal sets are one class from the start, and everything up to the final edges goes by
class: a class has one set, however many rows or ids have it. Classes that meet in a table are then
compared without listing the pairs of a table. In a first round every class is compared with
the most popular member of its tables, and linked ones take one label. Classes whose tables still
hold several labels are then compared exactly by their rarest shingles (prefix filter: sets of similarity
t share one of their ``n - ceil(t n) + 1`` rarest shingles, and what is left behind the first
shared place must be enough for the overlap): again by rounds, as long as these find links, and at last
all pairs across labels. So neither a large group of near
copies nor a passage that many documents share makes a pair for each two of its documents.

Defined results: null or blank text has the empty set and links with nothing; rows without
``doc_id`` link with nothing and have no component; rows that repeat a ``doc_id`` with another text
count as one document that has both texts. Other columns are ignored. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import cut

from .blocks import blocks, small_batches, tidy
from .components import components

WORDS = 5
HALVES, PER_HALF = 10, 2
THRESHOLD = 75
ROUNDS = 8
#: Rounds go on while this share of their comparisons are links.
YIELD = 0.3
FILTER_BITS = 1 << 23


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = _mix(np.arange(1, WORDS + 2, dtype=np.uint64) * _BASE) | np.uint64(1)
_SEEDS = _mix(np.arange(100, 100 + 4 * HALVES * PER_HALF, dtype=np.uint64) * _BASE)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    empty = np.empty(0, np.uint64)
    if not len(data):
        return [empty] * len(texts)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.append(False, word[:-1])))
    ends = np.flatnonzero(word & (first[1:] | ~np.append(word[1:], False))) + 1
    power = np.cumprod(np.full(len(data), _BASE))
    total = np.append(np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power))
    back = np.cumprod(np.full(len(data), _BACK))
    words = _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _PLACES[WORDS])
    bounds = np.searchsorted(starts, offsets)
    many = max(0, len(words) - WORDS + 1)
    runs = np.zeros(many, np.uint64)
    for k in range(WORDS):
        runs += words[k : k + many] * _PLACES[k]
    runs = _mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif n:
            out.append(_mix((words[a:b] * _PLACES[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(empty)
    return out


def half_keys(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The half-keys of sets stored one after the other, none of them empty: a row for each set."""
    out = np.empty((len(begin), 2 * HALVES), np.uint64)
    seeds = iter(_SEEDS)
    for h in range(2 * HALVES):
        key = np.full(len(begin), np.uint64(h))
        for _ in range(PER_HALF):
            least = np.minimum.reduceat((flat ^ next(seeds)) * (next(seeds) | np.uint64(1)), begin)
            key = _mix(key * _BASE + least)
        out[:, h] = key
    return out


def _set_hashes(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Two hashes of each set, for sets stored as for ``half_keys``."""
    return np.stack([np.add.reduceat(_mix(flat ^ _PLACES[k]), begin) for k in range(2)])


def _sketch_task(batches):
    for part in blocks(batches, "text", 1_000_000):
        sets = shingle_sets(part["text"])
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        full = np.flatnonzero(n)
        keys = np.zeros((len(sets), 2 * HALVES), np.uint64)
        sums = np.zeros((2, len(sets)), np.uint64)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            begin = np.append(0, n[full].cumsum()[:-1])
            keys[full] = half_keys(flat, begin)
            sums[:, full] = _set_hashes(flat, begin)
        yield pa.RecordBatch.from_pydict({
            "doc_id": part["doc_id"],
            "n_shingles": n,
            "h1": sums[0].view(np.int64),
            "h2": sums[1].view(np.int64),
            "keys": pa.FixedSizeListArray.from_arrays(keys.view(np.int64).ravel(), 2 * HALVES).cast(pa.list_(pa.int64())),
        })


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, keys``: size, hash and half-keys of each row's shingle set."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(tidy(_sketch_task), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def table_rows(classes: DataFrame) -> DataFrame:
    """``bucket, rep, n``: the members of every table key that at least two classes have."""
    tables = f"""explode(flatten(transform(sequence(0, {HALVES - 1}), i -> transform(sequence(0, {HALVES - 1}),
        j -> xxhash64(i, j, keys[i], keys[{HALVES} + j])))))"""
    rows = classes.select("rep", "n", F.expr(tables).alias("bucket"))
    return rows.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).where("m > 1").select("bucket", "rep", "n", "m")


_CLASS = ["h1", "h2", "n_shingles"]


def _sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``rep, shingles`` (sorted 64-bit hashes): one row for each of ``classes(rep, doc_id, h1, h2, n_shingles)``.

    Which documents have them is sent to the tasks as a filter of ``FILTER_BITS`` bits (1 MB at
    every size of the input), so that texts are not shuffled; rows that pass it by chance, and other
    texts of the same id, belong to no class that is asked for."""
    spot = F.expr(f"pmod(xxhash64(doc_id), {FILTER_BITS})")
    made = classes.select((spot + 1).alias("spot")).groupBy(F.expr("bitmap_bucket_number(spot)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits"))
    bits = np.zeros(FILTER_BITS, bool)
    for row in made.collect():  # at most FILTER_BITS / 32768 rows
        at = (row["part"] - 1) * 32768
        part = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        bits[at : at + len(part)] = part
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def task(batches):
        asked = np.unpackbits(packed.value)
        for batch in batches:
            batch = batch.filter(pa.array(asked[batch["spot"].to_numpy()].astype(bool)))
            for part in blocks([batch], "text", 1_000_000):
                sets = shingle_sets(part["text"])
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                sums = _set_hashes(np.concatenate([sets[i] for i in full]), np.append(0, n[full].cumsum()[:-1])).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"].take(pa.array(full)),
                    "h1": sums[0],
                    "h2": sums[1],
                    "n_shingles": n[full],
                    "shingles": pa.array([sets[i].tobytes() for i in full], pa.binary()),
                })

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").where("doc_id IS NOT NULL")
    made = rows.withColumn("spot", spot).mapInArrow(tidy(task), "doc_id long, h1 long, h2 long, n_shingles long, shingles binary")
    # repeated rows have one set
    once = made.groupBy("doc_id", *_CLASS).agg(F.first("shingles").alias("shingles"))
    return once.join(classes, ["doc_id", *_CLASS]).select("rep", "shingles")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` whose full sets reach the threshold."""
    names = pairs.columns
    fields = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)

    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= THRESHOLD * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    rows = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return rows.select(*names, "x", "y").mapInArrow(tidy(task), fields).distinct()


_SIZES = f"100 * least(n, o) >= {THRESHOLD} * greatest(n, o)"


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels joined by links ``(la, lb)``: each goes to the one of least hash linked with it."""
    both = links.selectExpr("la", "lb").union(links.selectExpr("lb", "la")).where("xxhash64(lb) < xxhash64(la)")
    to = both.groupBy("la").agg(F.min_by("lb", F.xxhash64("lb")).alias("lb"))
    far = to.toDF("lb", "far")
    to = cut(to.join(far, "lb", "left").select(F.col("la").alias("label"), F.coalesce("far", "lb").alias("new")))
    return cut(labels.join(to, "label", "left").select("rep", F.coalesce("new", "label").alias("label")))


_BEHIND = "175 * least(n - at, o - oat) >= 75 * (n + o)"


def _centre_pairs(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """Each member with the most popular one that its tables' centres offer; a centre is a table's most
    popular member that was none yet."""
    w = Window.partitionBy("bucket")
    fresh = rows if done is None else rows.join(done.withColumn("was", F.lit(1)), "rep", "left")
    rank = F.struct("popular", F.xxhash64("rep").alias("h"), F.col("rep").alias("a"), F.col("n").alias("o"), F.col("label").alias("la"), F.col("at").alias("oat"))
    fresh = fresh.withColumn("best", F.max(rank if done is None else F.when(F.col("was").isNull(), rank)).over(w))
    offers = fresh.select(F.col("rep").alias("b"), F.col("label").alias("lb"), "n", "at", "best.*").where(f"a <> b AND la <> lb AND {_SIZES} AND {_BEHIND}")
    return offers.groupBy("b", "lb").agg(F.max(F.struct("popular", "h", "a", "la")).alias("to")).select("to.a", "b", "to.la", "lb")


def _rest_pairs(rows: DataFrame) -> DataFrame:
    """Members outside their table's commonest label, with all members of other labels."""
    w = Window.partitionBy("bucket")
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("bucket", "label")))
    rows = cut(rows.withColumn("top", F.max(F.struct("c", "label")).over(w).getField("label")))
    few = rows.where("label <> top").select("bucket", F.col("rep").alias("b"), "n", "at", F.col("label").alias("lb"))
    other = rows.select("bucket", F.col("rep").alias("a"), F.col("n").alias("o"), F.col("at").alias("oat"), F.col("label").alias("la"), F.col("top").alias("t"))
    pairs = few.join(other, "bucket").where(f"la <> lb AND (la = t OR a < b) AND {_SIZES} AND {_BEHIND}")
    return pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "if(a < b, la, lb) AS la", "if(a < b, lb, la) AS lb").distinct()


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of tables that still have more than one label."""
    w = Window.partitionBy("bucket")
    rows = rows.join(labels, "rep")
    return cut(rows.withColumn("lo", F.min("label").over(w)).withColumn("hi", F.max("label").over(w)).where("lo <> hi").drop("lo", "hi"))


def _rounds(rows: DataFrame, labels: DataFrame, sets: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """What is left of the tables, the labels, and the links found."""
    links, done = [], None
    popular = rows.groupBy("rep").agg(F.sum("m").alias("popular"))
    rows = _mixed(rows.join(popular, "rep"), labels)
    for _ in range(rounds):
        if rows.isEmpty():
            break
        pairs = cut(_centre_pairs(rows, done))
        found = cut(_confirm(pairs, sets))
        links.append(found)
        centres = pairs.select(F.col("a").alias("rep"))
        done = cut((centres if done is None else done.union(centres)).distinct())
        labels = _relabel(labels, found)
        rows = _mixed(rows.drop("label"), labels)
        if found.count() < YIELD * pairs.count():
            break
    return rows, labels, links


def _prefix_tables(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Tables of rare shingles for ``members(rep, n)``, with the shingle's place ``at`` in the set's order
    by rarity: any two members that are similar enough meet in one."""

    def task(batches):
        for batch in batches:
            values = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["shingles"]]
            yield pa.RecordBatch.from_pydict({"rep": batch["rep"], "n": batch["n"], "shingles": pa.array(values, pa.list_(pa.int64()))})

    one = members.join(sets, "rep").mapInArrow(tidy(task), "rep long, n long, shingles array<long>").selectExpr("rep", "n", "explode(shingles) AS bucket")
    often = one.withColumn("m", F.count("*").over(Window.partitionBy("bucket")))
    rare = often.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("m", "bucket")) - 1)
    rare = rare.where(f"m > 1 AND at <= n - CAST(ceil(n * {THRESHOLD} / 100) AS BIGINT)").select("bucket", "rep", "n", "at")
    return rare.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).where("m > 1")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)
    rows = cut(sketches(docs))
    real = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = real.groupBy(*_CLASS).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    # a class has a number of its own: one id may be the least of several classes
    classes = cut(grouped.withColumn("rep", F.monotonically_increasing_id()))
    tables = cut(table_rows(classes.select("rep", "keys", F.col("n_shingles").alias("n"))).withColumn("at", F.lit(0)))
    met = cut(classes.join(tables.select("rep").distinct(), "rep").select("rep", "doc_id", *_CLASS))
    sets = cut(_sets_of(docs, met))
    left, labels, links = _rounds(tables, cut(met.selectExpr("rep", "rep AS label")), sets, 1)
    if not left.isEmpty():
        rare = cut(_prefix_tables(left.select("rep", "n").distinct(), sets))
        left, labels, more = _rounds(rare, labels, sets, ROUNDS)
        links += more
        if not left.isEmpty():
            links.append(cut(_confirm(cut(_rest_pairs(left)), sets)))
    edges = labels.selectExpr("rep AS u", "label AS v")
    for x in links:
        edges = edges.union(x.select("a", "b"))
    # from classes to ids: rows of one doc_id with several texts are one document
    edges = edges.join(met.selectExpr("rep AS u", "doc_id AS a"), "u").join(met.selectExpr("rep AS v", "doc_id AS b"), "v").select("a", "b")
    alike = classes.where("copies > 1").select(*_CLASS, F.col("doc_id").alias("least"))
    edges = edges.union(real.join(alike, _CLASS).select("doc_id", "least")).toDF("u", "v")
    found = cut(components(edges))
    out = rows.drop("keys", "h1", "h2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
