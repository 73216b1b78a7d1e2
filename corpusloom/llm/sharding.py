"""Sharding by a Feistel permutation of row numbers.

Rows are numbered by id, and the number goes through a keyed permutation of
``0 .. n-1``: a balanced Feistel network over the next power of four, walked
until the value lies below ``n`` again (cycle walking). Position ``p`` is shard
``p mod shards``, slot ``p div shards``, so shard sizes differ by one row at
most, slots have no gaps, and either can be computed from the row number alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows, whole_text

ROUNDS = 6
SEED = 20240607


def _round(value: np.ndarray, key: int, mask: int) -> np.ndarray:
    """The round function: a multiply-shift mixer of the half block."""
    with np.errstate(over="ignore"):
        x = (value + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(mask)


def _keys(seed: int) -> list[int]:
    state = np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)
    return [int(k) for k in state]


def permute(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where each of ``numbers`` (all in ``0 .. n-1``) goes in ``0 .. n-1``."""
    return _walk(numbers, n, [(key, False) for key in _keys(seed)])


def unpermute(positions: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The inverse of :func:`permute`."""
    return _walk(positions, n, [(key, True) for key in reversed(_keys(seed))])


def _walk(values: np.ndarray, n: int, rounds: list[tuple[int, bool]]) -> np.ndarray:
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = (1 << half) - 1, np.uint64(half)
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # under four steps each on average, as the block has at most 4n values
        x = out[todo]
        left, right = x >> shift, x & np.uint64(mask)
        for key, back in rounds:
            if back:
                left, right = right ^ _round(left, key, mask), left
            else:
                left, right = right, left ^ _round(right, key, mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def assign_shards(
    docs: DataFrame, shards: int, order: list[str], seed: int = SEED
) -> DataFrame:
    """``docs`` with ``row_number``, ``shard`` (int) and ``slot`` (long), both from 0.

    ``order`` names the columns that fix the row numbers (nulls first). Rows
    that tie in all of them are interchangeable; they get neighbouring
    numbers. An empty table stays empty. One shuffle, of the given columns
    only: leave texts out unless they are wanted in the result.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    numbered = number_rows(docs, [F.col(f"`{c}`").asc_nulls_first() for c in order], "row_number")
    n = numbered.count()

    @F.pandas_udf("long")
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    return (
        numbered.withColumn("_position", position("row_number"))
        .withColumn("shard", (F.col("_position") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_position") / F.lit(shards)).cast("long"))
        .drop("_position")
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write the rows below ``path/shard=N``, in slot order within and across files."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def shard_digest(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    ``size`` is the bytes of the text plus 1, so a null or empty text has 1.
    The numbers follow ``doc_id``, then the text's checksum and size.
    """
    text = whole_text(F.col("text"))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return assign_shards(narrow, shards, ["doc_id", "text_crc32", "size"], seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
