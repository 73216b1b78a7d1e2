"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.strings import let
from corpusloom.session import cut_lineage

# The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"

# A table of parameters (rates, hot keys) is sent to every task only up to this many rows.
SMALL_ROWS = 100_000
# and only up to this many bytes.
SMALL_BYTES = 32 << 20


def whole_text(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def split_words(text: Column) -> Column:
    """``array<string>`` of the words ``[^\\x20\\x09-\\x0D]+``."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def count_chars_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """What is written inside the block passes to workers in Arrow batches of about ``most`` bytes, not of 64 MB.

    A batch is in the memory of a task and of its worker, and in neither's heap. A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    used = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)) if before else 0
    if 0 < used <= most:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def is_small(rows: DataFrame, row_bytes: Column) -> bool:
    """Whether a table may be sent to every task; ``row_bytes`` is what is large in a row."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()
    return n <= SMALL_ROWS and size + 64 * n <= SMALL_BYTES


def number_rows(df: DataFrame, order: list[Column], output: str) -> DataFrame:
    """Gapless numbers from 0 in the given order, for tables of any size.

    The rows are written first, as finding the ranges reads them once more.
    Then one range shuffle: rows are sorted inside ranges, written with their
    place in the range, and the sizes of the earlier ranges are added. Rows
    that tie in ``order`` get numbers in an unspecified order.
    """
    placed = cut_lineage(
        cut_lineage(df)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", 33).cast("int")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).collect()
    before, starts = 0, []  # one number for each partition
    for row in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((row["_part"], before))
        before += row["_size"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(output, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_before", "_place")
    )


# A key with more than a thousandth of all rows is hot, so there are fewer than a thousand of them.
HOT_SHARE = 1000
HOT_LEAST = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one fact row for each key, whatever the keys' sizes.

    ``count`` says how many of the ``total`` rows have the key. Facts of hot
    keys, under ``HOT_SHARE`` of them, are sent to every task; their rows then
    go through the ordinary join under keys of their own that match nothing,
    so they spread evenly. ``key`` is binary and never null.
    """
    limit = max(HOT_LEAST, total // HOT_SHARE)
    columns = [c for c in facts.columns if c != key]
    hot = facts.where(F.col(count) > limit).select(
        F.col(key), *[F.col(c).alias(f"_hot_{c}") for c in columns]
    )
    is_hot = F.col(f"_hot_{count}").isNotNull()
    spread = F.concat(F.col(key), F.monotonically_increasing_id().cast("string").cast("binary"))
    first = rows.join(F.broadcast(hot), key, "left").withColumn("_join", F.when(is_hot, spread).otherwise(F.col(key)))
    cold = facts.where(F.col(count) <= limit).withColumnRenamed(key, "_join")
    merged = {c: F.coalesce(F.col(f"_hot_{c}"), F.col(c)) for c in columns}
    return first.join(cold, "_join", "left").withColumns(merged).drop("_join", *[f"_hot_{c}" for c in columns])


__all__ = ["SMALL_ROWS", "SPACES", "batch_bytes", "count_chars_of", "is_small", "join_facts", "let", "number_rows", "split_words", "whole_text"]
