"""Diagram tables: edges of a diagram, cache hits and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.diagram_text import TARGET_DIAGRAMS, checked_code, has_code, is_error
from corpusloom.functions.strings import find_all
from corpusloom.functions.tokens import content_hash

NODE = r"(\w+)(?:\[([^\]]*)\])?"
EDGE = rf"(?dU)^\s*{NODE}\s*(-->|---)(?:\|[^|]*\|)?\s*{NODE}"


def check_outputs(outputs: DataFrame, target: str = "target_graph", output: str = "output") -> DataFrame:
    """Replace raw outputs by their diagram text or a message."""
    return outputs.withColumn("generated_code", checked_code(target, output)).drop(output)


def keep_valid(diagrams: DataFrame, code: str = "generated_code") -> DataFrame:
    """Diagrams with code that is no error message."""
    return diagrams.where(has_code(code) & ~is_error(code))


def diagram_edges(diagrams: DataFrame, keys: list[str], code: str = "generated_code") -> DataFrame:
    """One row per arrow with node ids and labels.

    A node's label may be written at any of its uses; the first one counts,
    and a node without one is labelled by its id.
    """
    labelled = r"(\w+)\[([^\]]*)\]"
    uses = F.arrays_zip(find_all(code, labelled, 1).alias("id"), find_all(code, labelled, 2).alias("label"))
    # the first label of each node, looked up by a join: a list of labels on every line would be quadratic
    labels = (
        diagrams.select(*keys, F.posexplode(uses).alias("_at", "_use"))
        .groupBy(*keys, F.col("_use.id").alias("_id"))
        .agg(F.min_by("_use.label", "_at").alias("_label"))
    )
    rows = diagrams.select(*keys, F.posexplode(F.split(code, "\n")).alias("line_no", "_line")).where(
        F.col("_line").rlike(EDGE)
    )
    rows = rows.withColumns(
        {
            "src": F.regexp_extract("_line", EDGE, 1),
            "arrow": F.regexp_extract("_line", EDGE, 3),
            "dst": F.regexp_extract("_line", EDGE, 4),
        }
    )

    def with_label(rows: DataFrame, node: str) -> DataFrame:
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
        joined = rows.alias("r").join(labels.alias("l"), [*same, F.col(f"r.{node}") == F.col("l._id")], "left")
        return joined.select("r.*", F.coalesce("l._label", f"r.{node}").alias(f"{node}_label"))

    out = with_label(with_label(rows, "src"), "dst")
    return out.select(*keys, "line_no", "src", "arrow", "dst", "src_label", "dst_label")


def cached_hashes(cache: DataFrame) -> DataFrame:
    """Hashes for which every target diagram exists."""
    wanted = cache.where(F.col("target_graph").isin(TARGET_DIAGRAMS))
    return (
        wanted.groupBy("content_hash")
        .agg(F.countDistinct("target_graph").alias("_n"))
        .where(F.col("_n") == len(TARGET_DIAGRAMS))
        .select("content_hash")
    )


def request_hashes(requests: DataFrame, text: str = "text") -> DataFrame:
    """Different contents with the number of requests for each.

    Copies are counted before the join with the cache, so a text that a third
    of all requests repeat is one row there.
    """
    return requests.groupBy(content_hash(text).alias("content_hash")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def cache_hits(requests: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    return request_hashes(requests, text).join(cached_hashes(cache), "content_hash", "left_semi")


def cache_misses(requests: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    return request_hashes(requests, text).join(cached_hashes(cache), "content_hash", "left_anti")
