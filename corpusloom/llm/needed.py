"""Rows whose key is among given ones: a filter of bounded size first, an exact join after it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .urls import build_filter, may_contain

# The filter is sent to every task; keys that do not fit into so many bytes only let more rows through.
FILTER_BYTES = 32 << 20


def _let_through(table, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pc.fill_null(batch["_hash"], 0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(may_contain(hashes, table.value))).select(names)

    return run


def possible(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """All rows whose ``on`` is among those of ``keys``, and few others; nothing is shuffled but the keys."""
    listed = keys.select(F.col(on).alias("key"))
    table = rows.sparkSession.sparkContext.broadcast(build_filter(listed, keys.count(), FILTER_BYTES))
    hashed = rows.withColumn("_hash", F.xxhash64(on))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return hashed.mapInArrow(_let_through(table, rows.columns), fields)


def among(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``on`` may be among those of ``keys``, and those where it is not, for which no join is needed.

    ``keys`` should be written, and ``rows`` cheap to compute, as each part does so.
    """
    listed = keys.select(F.col(on).alias("key"))
    table = rows.sparkSession.sparkContext.broadcast(build_filter(listed, keys.count(), FILTER_BYTES))

    def let_through(hashes: pd.Series) -> pd.Series:
        return pd.Series(may_contain(hashes.to_numpy().view(np.uint64), table.value))

    found = F.pandas_udf(let_through, "boolean")(F.xxhash64(on))
    return rows.where(found), rows.where(~found)


def needed_texts(rows: DataFrame, involved: DataFrame, on: str, text: str = "_text") -> DataFrame:
    """``involved`` with ``text``: that of the row with the same ``on``.

    The filter keeps most other texts from being sent; of equal texts each
    task sends on one.
    """
    some = possible(rows.select(on, text), involved, on)
    return some.groupBy(on).agg(F.first(text).alias("text")).join(involved, on)
