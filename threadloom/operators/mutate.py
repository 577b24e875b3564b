"""Table changes as new snapshots of immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed

# what each build stage fills, and so what its reset empties
STAGE_TABLES = {
    0: ("messages",),
    1: ("chunks",),
    3: ("index_chunks",),
    4: ("topics_l1",),
    5: ("index_l1",),
    6: ("topics_l2",),
    7: ("index_l2",),
}


def empty(df: DataFrame) -> DataFrame:
    return df.limit(0)


def _null(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(df.schema[n].dataType) for n in names if n in df.columns})


def reset_stage(tables: dict[str, DataFrame], stage: int) -> dict[str, DataFrame]:
    """The tables as they were before ``stage`` ran."""
    out = dict(tables)
    for name in STAGE_TABLES.get(stage, ()):
        if name in out:
            out[name] = empty(out[name])
    if "chunks" in out:
        if stage == 2:
            out["chunks"] = _null(out["chunks"], "embedding", "embedding_dim")
        elif stage == 4:
            out["chunks"] = _null(out["chunks"], "topic_l1_id")
        elif stage == 6:
            out["chunks"] = _null(out["chunks"], "topic_l2_id")
    if stage == 6 and "topics_l1" in out:
        out["topics_l1"] = _null(out["topics_l1"], "parent_l2_id")
    for level in (1, 2):
        if stage == 7 + level and f"topics_l{level}" in out:
            out[f"topics_l{level}"] = out[f"topics_l{level}"].withColumns(
                {"title": F.lit(fixed.UNNAMED_TITLE), "descr": F.lit(fixed.PENDING_DESCRIPTION)}
            )
    return out


def reset_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    for stage in range(9, -1, -1):
        tables = reset_stage(tables, stage)
    return tables


def apply_delta(table: DataFrame, delta: DataFrame, key: str, keep_null: bool = False) -> DataFrame:
    """``table`` with the columns of ``delta`` overwritten where its key matches.

    Null means "leave as it is" unless ``keep_null``, which lets a delta set nulls.
    """
    changed = [c for c in delta.columns if c != key]
    marked = delta.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))
    joined = table.join(marked, key, "left")

    def value(c: str):
        if c not in changed:
            return F.col(c)
        if keep_null:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)

    return joined.select(*[value(c) for c in table.columns])


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def evolve(table: DataFrame, schema) -> DataFrame:
    """``table`` under a newer schema: missing columns appear as nulls."""
    blank = table.sparkSession.createDataFrame([], schema)
    return blank.unionByName(table, allowMissingColumns=True)
