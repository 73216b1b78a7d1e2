"""New documents in, chunks out; content seen before is skipped."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.session import is_missing_path
from corpusloom.functions.tokens import content_hash
from corpusloom.operators.chunks import store_chunks


def first_copies(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``content_hash, key``: the smallest key of each different content.

    Only hashes and keys are aggregated, first on each task, so a text that a
    third of all rows repeat costs one row per task and texts stay put.
    """
    return documents.select(content_hash(text).alias("content_hash"), key).groupBy(
        "content_hash"
    ).agg(F.min(key).alias(key))


def new_documents(
    documents: DataFrame, key: str, text: str = "text", seen: DataFrame | None = None, observed: Observation | None = None
) -> DataFrame:
    """Documents whose content is not in ``seen`` (``content_hash``), one per content.

    ``key`` must be unique. The join that fetches the texts is on it, so no
    hash can make a task large. ``observed`` receives the number of
    ``documents`` when the result is read.
    """
    chosen = first_copies(documents, key, text)
    if seen is not None:
        chosen = chosen.join(seen.select("content_hash"), "content_hash", "left_anti")
    if observed is not None:
        documents = documents.observe(observed, F.count(F.lit(1)).alias("documents"))
    return documents.join(chosen, key)


def drop_recent_copies(
    documents: DataFrame, ts: str, delay: str = "1 hour", text: str = "text"
) -> DataFrame:
    """Streaming form with bounded state: copies within ``delay`` of the first are dropped."""
    hashed = documents.withColumn("content_hash", content_hash(text))
    return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


def ingest_batch(
    batch: DataFrame, batch_id: int, chunk_path: str, hash_path: str, key: str, keep: list[str], text: str, **limits
) -> dict[str, int]:
    """Store one micro-batch and tell what was ``added``, ``skipped`` and how many ``extra_chunks`` there are.

    Running it again gives the same tables: every batch owns one partition of
    both tables and overwrites it, and hashes of its own earlier attempt are
    not counted as seen. The counts are taken while the rows are written.
    """
    spark = batch.sparkSession
    seen = read_hashes(spark, hash_path).where(F.col("batch_id") != batch_id)
    read, stored = Observation(), Observation()
    fresh = new_documents(batch, key, text, seen, read)

    def store(rows: DataFrame, path: str) -> None:
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)

    chunks = store_chunks(fresh, [key, *keep], text, **limits)
    first = F.count_if(F.col("chunk_index") == 0)
    store(chunks.observe(stored, first.alias("added"), F.count(F.lit(1)).alias("chunks")), chunk_path)
    store(new_documents(batch, key, text, seen).select("content_hash"), hash_path)
    added, written = _observed(stored, "added") or 0, _observed(stored, "chunks") or 0
    documents = _observed(read, "documents")
    if documents is None:  # nothing was new, so the texts have not been read
        documents = batch.count()
    return {"added": added, "skipped": documents - added, "extra_chunks": written - added}


def _observed(observation: Observation, name: str) -> int | None:
    """A count, or None where Spark has left out the part of the plan that takes it, as it gives no rows."""
    try:
        return observation.get.get(name)
    except Py4JJavaError:
        return None


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    schema = "content_hash string, batch_id long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return spark.createDataFrame([], schema)


def ingest_stream(
    documents: DataFrame,
    chunk_path: str,
    hash_path: str,
    checkpoint: str,
    key: str,
    keep: list[str] | None = None,
    text: str = "text",
    **limits,
) -> DataStreamWriter:
    """A stream writer to be started by the caller, e.g. with ``trigger(availableNow=True)``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, chunk_path, hash_path, key, keep or [], text, **limits)

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
