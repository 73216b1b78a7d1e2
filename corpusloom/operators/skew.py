"""Joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
ROWS_PER_SALT = 500_000

# At most this many keys are spread, so the list of them is always small
# enough to broadcast. A key beyond it is joined unsalted, which is still
# right; it has fewer rows than every key on the list.
MAX_HOT_KEYS = 10_000


def _hashable(df: DataFrame) -> list[str]:
    """Columns a salt can be made of; maps and variants have no hash."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return [n for n, kind in kinds.items() if "map<" not in kind and "variant" not in kind]


def hot_keys(df: DataFrame, on: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys of ``df`` with many rows and the number of salts each gets."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return hot_from_counts(counts, on, "_rows", rows_per_salt)


def hot_from_counts(
    counts: DataFrame, on: list[str], rows: str, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """The same from counts per key that are there already."""
    return (
        counts.where(F.col(rows) > rows_per_salt)
        .orderBy(F.desc(rows), *on)
        .limit(MAX_HOT_KEYS)
        .select(*on, F.ceil(F.col(rows) / rows_per_salt).cast("int").alias("_salts"))
    )


def first_rows(
    df: DataFrame, group: list[str], order: list[str], n: int, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group, for ``n`` in the thousands.

    A single ranking would bring up to ``n`` rows from every task to the one
    that ranks a large group. Ranking inside salted parts first leaves it at
    most ``salts * n``.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts)).cast("int"))
    inside = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
    near = salted.withColumn("_n", inside).where(F.col("_n") <= n).drop("_salt", "_n")
    overall = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return near.withColumn("_n", overall).where(F.col("_n") <= n).drop("_n")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join in which the hot keys of ``left`` are split by a salt.

    Rows of ``right`` are repeated only for hot keys, once per salt. ``how``
    is ``inner`` or ``left``. The keys are counted right away, so both sides
    go by the same list; without hot keys this is a plain join. ``left``
    should be a table or cheap to compute. ``hot`` may be given when the
    counts are known already; it must have at most ``MAX_HOT_KEYS`` rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    if hot is None:
        hot = hot_keys(left, on, rows_per_salt)
    rows = hot.collect()
    if not rows:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    salt = F.pmod(F.xxhash64(*_hashable(left)), F.coalesce(F.col("_salts"), F.lit(1)).cast("long"))
    salted = left.join(hot, on, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    repeated = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
