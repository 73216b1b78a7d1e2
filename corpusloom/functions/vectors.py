"""Vector expressions: validity, distance, score and JSON form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import col

# Fixed value: expected vector width unless the caller gives one.
DEFAULT_DIMENSION = 1024

METRICS = ("l2", "squared_l2")


def is_zero(vector: Column | str) -> Column:
    return F.forall(col(vector), lambda x: x == 0)


def has_dimension(vector: Column | str, dimension: int) -> Column:
    return F.size(col(vector)) == dimension


def require_dimension(vector: Column | str, dimension: int) -> Column:
    """The vector itself; a wrong width stops the query."""
    vector = col(vector)
    message = F.concat(
        F.lit(f"embedding dimension mismatch: expected {dimension}, got "),
        F.size(vector).cast("string"),
    )
    return F.when(has_dimension(vector, dimension), vector).otherwise(F.raise_error(message))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    diff = F.zip_with(
        col(a), col(b), lambda x, y: x.cast("double") - y.cast("double")
    )
    return F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d)


def score(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """``1 / (1 + d)`` with true or squared distance."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    squared = squared_distance(a, b)
    return 1 / (1 + (F.sqrt(squared) if metric == "l2" else squared))


def to_json_text(vector: Column | str) -> Column:
    return F.to_json(col(vector))


def from_json_text(text: Column | str) -> Column:
    return F.from_json(col(text), "array<float>")
