"""The table of embedded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.vectors import DEFAULT_DIMENSION
from corpusloom.operators.retrieval import clean_vectors, matches_filters

from . import snapshots

# Keys most searches filter by are columns, so filters on them reach the
# Parquet scan; the rest of the metadata is a map.
PROMOTED = ("file_path", "language")

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *[T.StructField(name, T.StringType()) for name in PROMOTED],
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.DoubleType()),
    ]
)


def vector_documents(
    chunks: DataFrame, meta: dict[str, str] | None = None, id: str = "chunk_id"
) -> DataFrame:
    """Chunks with an embedding in the shape of the table.

    ``meta`` maps metadata keys to the columns they come from.
    """
    meta = meta or {}
    pairs = [x for key, name in meta.items() for x in (F.lit(key), F.col(name).cast("string"))]
    now = F.current_timestamp()
    stamped = [F.lit("timestamp"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")]
    return chunks.select(
        F.col(id).cast("long").alias("id"),
        "content",
        F.col("embedding").cast("array<float>").alias("embedding"),
        *[F.col(meta[n]).alias(n) if n in meta else F.lit(None).cast("string").alias(n) for n in PROMOTED],
        F.create_map(*pairs, *stamped).alias("meta"),
        (F.unix_micros(now) / 1e6).alias("created_at"),
    )


def append_vectors(
    documents: DataFrame, path: str, dimension: int = DEFAULT_DIMENSION, mode: str = "append"
) -> int:
    """Write valid vectors as a new version of the table and return its number.

    What the table held stays until the new version is complete, and can still
    be loaded afterwards. The width stands in the version's manifest, so it is
    known without reading rows.
    """
    kept = clean_vectors(documents, dimension=dimension)
    return snapshots.commit(kept, path, mode, {"dimension": dimension})


def replace_vectors(documents: DataFrame, path: str, dimension: int = DEFAULT_DIMENSION) -> int:
    """A new run: what the table held before is no longer in it."""
    return append_vectors(documents, path, dimension, mode="overwrite")


def clear_vectors(spark: SparkSession, path: str, dimension: int = DEFAULT_DIMENSION) -> None:
    replace_vectors(spark.createDataFrame([], SCHEMA), path, dimension)


def filter_condition(filters: dict[str, object]) -> Column:
    keep = F.lit(True)
    for key, value in filters.items():
        keep = keep & (
            F.col(key) == F.lit(str(value)) if key in PROMOTED else matches_filters("meta", {key: value})
        )
    return keep


def load_vectors(
    spark: SparkSession,
    path: str,
    dimension: int = DEFAULT_DIMENSION,
    filters: dict[str, object] | None = None,
    version: int | None = None,
) -> DataFrame:
    """The latest or the given version; an empty table when there is none or its width is another."""
    parts = snapshots.parts(spark, path, version)
    if not parts or any(p["dimension"] != dimension for p in parts):
        return spark.createDataFrame([], SCHEMA)
    stored = spark.read.schema(SCHEMA).parquet(*[p["folder"] for p in parts])
    return stored.where(filter_condition(filters or {}))


def write_jdbc(documents: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a database table: vectors and metadata as JSON text."""
    flat = documents.select(
        "content", F.to_json("embedding").alias("embedding"), F.to_json("meta").alias("meta"), "created_at"
    )
    flat.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.withColumns(
        {
            "embedding": F.from_json("embedding", "array<float>"),
            "meta": F.from_json(F.col("meta").cast("string"), "map<string,string>"),
        }
    )


def drop_zero_vectors(spark: SparkSession, path: str, output: str) -> None:
    """Rewrite a table without its all-zero vectors."""
    from corpusloom.functions.vectors import is_zero

    rows = spark.read.parquet(path)
    kept = rows.where(~is_zero("embedding"))
    writer = kept.write.mode("overwrite")
    (writer.partitionBy("dimension") if "dimension" in rows.columns else writer).parquet(output)
