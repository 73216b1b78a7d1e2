"""The cache of finished diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import list_files, read_contents

DIAGRAM = "target_graph string, generated_code string"


def read_diagram_folders(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<hash>/<Name>.json`` with one JSON object per file.

    Folders are listed and files read in tasks: Spark's own reader would hold
    the path of every file in the driver.
    """
    listed = list_files(spark, root, prune=False).where(F.col("rel_path").rlike(r"^[^/]+/[^/_.][^/]*\.json$"))
    read = read_contents(listed)
    text = F.when(F.col("error").isNotNull(), F.raise_error("error")).otherwise(F.col("content").cast("string"))
    found = read.select(F.substring_index("rel_path", "/", 1).alias("content_hash"), text.alias("_text")).where("trim(_text) <> ''")
    kind = f"array<struct<{DIAGRAM.replace(' string', ': string')}>>"
    rows = F.coalesce(F.from_json("_text", kind), F.array(F.lit(None).cast(kind[6:-1])))
    return found.select("content_hash", F.explode(rows).alias("_d")).select("content_hash", "_d.target_graph", "_d.generated_code")


def write_diagrams(diagrams: DataFrame, path: str) -> None:
    """Append as JSON lines, spread over 256 folders by the start of the hash.

    A folder per hash would mean two tiny files per diagram.
    """
    rows = diagrams.select(
        F.substring("content_hash", 1, 2).alias("hash_start"), "content_hash", "target_graph", "generated_code"
    )
    rows.write.mode("append").partitionBy("hash_start").json(path)


def read_diagrams(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"content_hash string, {DIAGRAM}, hash_start string").json(path)
    return rows.drop("hash_start")
