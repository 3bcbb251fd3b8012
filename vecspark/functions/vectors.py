"""Vector functions as column expressions, and SplitMix64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v) -> Column:
    """``v`` at unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_d(v), lambda x: x / n)).otherwise(_d(v))


def distance(a, b, metric: str) -> Column:
    """Euclidean, or cosine distance, which is 1 where a vector is zero."""
    if metric_name(metric) == "euclidean":
        return F.sqrt(l2_squared(a, b))
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / n)


def metric_name(metric: str) -> str:
    names = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean"}
    if metric not in names:
        raise ValueError(f"unknown metric {metric!r}")
    return names[metric]


def score(distance_col, metric: str) -> Column:
    """Higher is closer: one minus a cosine distance, or a negative Euclidean one."""
    d = F.col(distance_col) if isinstance(distance_col, str) else distance_col
    return 1 - d if metric_name(metric) == "cosine" else -d


def wrong_width(v, dim: int) -> Column:
    return F.coalesce(F.size(F.col(v)) != dim, F.lit(True))


def first_not_finite(v) -> Column:
    """The position of the first value that is null, NaN or infinite; null if all are finite."""
    bad = F.transform(_d(v), lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.nullif(F.array_position(bad, True), F.lit(0).cast("long")) - 1


#: Fixed values of SplitMix64.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(ids, seed: int):
    """The generator's output number ``id`` (from 0) of ``seed``, for an array of ids."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = np.uint64(seed) + (np.asarray(ids).astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
        return z ^ (z >> np.uint64(31))


def levels(ids, seed: int, m: int):
    """Layer of each id: floor(-ln(u) / ln(m)) of a uniform draw, kept above zero."""
    import numpy as np

    u = np.maximum((splitmix64(ids, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53, np.finfo(float).tiny)
    return np.floor(-np.log(u) / np.log(m)).astype(np.int32)


#: Name, parameters, result and body of each function that ``register`` adds to SQL.
SQL_FUNCTIONS = [
    ("vector_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("vector_norm", "a ARRAY<DOUBLE>", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    ("vector_l2", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    ("vector_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "CASE WHEN vector_norm(a) * vector_norm(b) = 0 THEN 1D ELSE 1 - vector_dot(a, b) / (vector_norm(a) * vector_norm(b)) END"),
]


def register(spark) -> None:
    """Make the vector functions known to the session's SQL, as expressions that Catalyst inlines."""
    for name, parameters, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
