"""Vector arithmetic and distance/score rules as column expressions.

These are for *one row, one pair* work (a chunk against its own centroid).  Searching
many vectors goes through ``operators.nearest``, which never emits all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(_double(v), lambda x: x * x)))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    scale = F.when(n == 0.0, F.lit(1.0)).otherwise(n)
    return F.transform(_double(v), lambda x: x / scale)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the common length; 0 when either side has no length."""
    width = F.least(F.size(a), F.size(b))
    left, right = F.slice(_double(a), 1, width), F.slice(_double(b), 1, width)
    scale = norm(left) * norm(right)
    dot = _total(F.zip_with(left, right, lambda x, y: x * y))
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot / scale)


def sq_l2(a: Column, b: Column) -> Column:
    """The index distance: squared Euclidean."""
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def score(distance: Column, kind: str = "compat") -> Column:
    """Distance to similarity.  ``compat`` jumps at 1 and 2; ``cosine`` is monotone on unit vectors."""
    if kind == "cosine":
        return 1.0 - distance / 2.0
    return (
        F.when(distance <= 1.0, 1.0 - distance)
        .when(distance <= 2.0, 1.0 - distance / 2.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - distance))
    )


def score_hydrated(distance: Column) -> Column:
    return F.when(distance <= 1.0, 1.0 - distance).otherwise(F.lit(0.0))


def effective_distance(distance: Column, score_: Column) -> Column:
    return F.coalesce(distance, 1.0 - score_)


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded without negative zero."""
    return F.round(c, places) + F.lit(0.0)
