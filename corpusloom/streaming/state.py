"""Ingest whose memory of seen contents is the stream's own state.

Each content hash is a key of a state store with a time to live. A micro-batch
looks up the hashes it brings and no others, however many are stored, and the
store forgets by itself. It needs the RocksDB state store, which keeps state on
disk; ``use_rocksdb`` sets it for a session.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import StructField, StructType

from corpusloom.functions.tokens import content_hash
from corpusloom.operators.chunks import store_chunks

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class FirstCopy(StatefulProcessor):
    """Lets the copy with the smallest key through, if its content has not been seen for the time to live.

    Every copy prolongs the memory of its content.
    """

    def __init__(self, key: str, key_type: StructField, ttl_ms: int | None) -> None:
        self.key, self.schema, self.ttl_ms = key, StructType([StructField("key", key_type.dataType)]), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.first.get() if self.first.exists() else None
        best = None
        for row in rows:
            if known is None and (best is None or row[self.key] < best[self.key]):
                best = row
        if best is not None:
            known = (best[self.key],)
            yield best
        self.first.update(tuple(known))

    def close(self) -> None:
        pass


def unseen_documents(documents: DataFrame, key: str, text: str = "text", ttl_ms: int | None = 24 * HOUR_MS) -> DataFrame:
    """The stream's documents whose content has not come before, one per content, with ``content_hash``.

    ``key`` must not be null. Content counts as new again when none of its copies has come for ``ttl_ms``
    (None: never). Of copies in one micro-batch the one with the smallest key counts.
    """
    hashed = documents.withColumn("content_hash", content_hash(text))
    processor = FirstCopy(key, hashed.schema[key], ttl_ms)
    mode = "ProcessingTime" if ttl_ms is not None else "None"
    return hashed.groupBy("content_hash").transformWithState(processor, hashed.schema, "Append", mode)


def counted(rows: DataFrame, name: str, **counts) -> DataFrame:
    """Rows whose counts are taken as they pass; a listener such as :class:`Counters` receives them."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])


class Counters(StreamingQueryListener):
    """Adds up what ``counted`` observes over all micro-batches: ``{name: {count: total}}``."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            for name, row in event.progress.observedMetrics.items():
                total = self.totals.setdefault(name, {})
                for count, value in row.asDict().items():
                    total[count] = total.get(count, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ingest_with_state(
    documents: DataFrame,
    chunk_path: str,
    checkpoint: str,
    key: str,
    keep: list[str] | None = None,
    text: str = "text",
    ttl_ms: int | None = 24 * HOUR_MS,
    **limits,
) -> DataStreamWriter:
    """A stream writer of the chunks of new documents, to be started by the caller.

    With a time to live the stream never comes to rest by itself, as it runs
    batches without data in which it forgets; give it a processing-time trigger
    and stop it. Without one (None) ``trigger(availableNow=True)`` ends it.

    ``Counters`` receives ``documents`` (``rows`` that came), ``fresh`` (those
    stored; the rest was skipped) and ``chunks`` (``rows`` and ``extra``, those
    beyond the first of a document), taken while the rows are written.
    """
    fresh = counted(unseen_documents(counted(documents, "documents"), key, text, ttl_ms), "fresh")
    chunks = store_chunks(fresh, [key, *(keep or [])], text, **limits)
    out = counted(chunks, "chunks", extra=F.count_if(F.col("chunk_index") > 0))
    return out.writeStream.format("parquet").option("path", chunk_path).option("checkpointLocation", checkpoint)
