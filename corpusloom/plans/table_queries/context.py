"""Vector validity, nearest neighbours and retrieved context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.operators import reports, retrieval
from corpusloom.sources import vectors as store

from .base import Query, md5_of, new_folder, table

WIDTH = 64
K = 10


def _mixed(spark, sf_dir):
    """Embeddings of which those of label 0 become zero and those of label 1 lose a number."""
    rows = table(spark, sf_dir, "embeddings")
    vec = (
        F.when(F.col("label") == 0, F.transform("embedding", lambda x: F.lit(0).cast("float")))
        .when(F.col("label") == 1, F.slice("embedding", 1, WIDTH - 1))
        .otherwise(F.col("embedding"))
    )
    return rows.select("vec_id", "label", vec.alias("embedding"))


def vector_roundtrip(spark, sf_dir):
    """Written, replaced, appended to and read back with a filter; a missing table and another width are empty.

    ``strangers`` also counts what the whole table has more or less than was written.
    """
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("c"), "vec_id").alias("content"), "embedding",
        F.concat(F.lit("l"), "label").alias("language"), F.concat(F.lit("v"), F.col("vec_id") % 3).alias("team"),
    )
    path = new_folder(spark)
    before = store.load_vectors(spark, path, WIDTH).count()
    made = store.vector_documents(rows, {"language": "language", "team": "team"})
    store.append_vectors(made, path, WIDTH)
    store.replace_vectors(made.where("id % 2 = 0"), path, WIDTH)
    store.append_vectors(made.where("id % 2 = 1"), path, WIDTH)
    store.append_vectors(_mixed(spark, sf_dir).where("label < 2").select(
        F.col("vec_id").alias("id"), F.lit("x").alias("content"), "embedding", F.lit("l3").alias("language"),
        F.lit(None).cast("string").alias("file_path"), F.create_map(F.lit("team"), F.lit("v1")).alias("meta"),
        F.lit(0.0).alias("created_at"),
    ), path, WIDTH)
    other = store.load_vectors(spark, path, WIDTH + 1).count()
    same = ["id", "content", "language", "embedding", F.try_element_at("meta", F.lit("team")).alias("team")]
    written = made.select(*same, F.lit(1).alias("n"))
    stored = store.load_vectors(spark, path, WIDTH).select(*same, F.lit(-1).alias("n"))
    rows = written.unionByName(stored).groupBy("id", "content", "language", "embedding", "team").agg(F.sum("n").alias("n"))
    wrong = rows.where("n <> 0").count()
    found = store.load_vectors(spark, path, WIDTH, {"language": "l3", "team": "v1"})
    return found.select(
        F.col("id").alias("vec_id"), "content", F.size("embedding").alias("width"),
        (F.col("created_at").isNotNull() & F.try_element_at("meta", F.lit("timestamp")).isNotNull()).alias("stamped"),
        F.lit(before + other + wrong).alias("strangers"),
    )


def zero_dim_filter(spark, sf_dir):
    return retrieval.clean_vectors(_mixed(spark, sf_dir), dimension=WIDTH).select("vec_id", "label")


def vector_counts(spark, sf_dir):
    return retrieval.vector_counts(_mixed(spark, sf_dir), dimension=WIDTH)


def vector_json(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    back = vectors.from_json_text(vectors.to_json_text("embedding"))
    return rows.select("vec_id", F.size(back).alias("width"), vectors.squared_distance("embedding", back).alias("d2"))


def _centres(spark, sf_dir):
    """The mean vector of each label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding")
    ).withColumn("query_id", F.col("label"))


def _nearest(spark, sf_dir, **options):
    docs = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(_centres(spark, sf_dir), docs, doc_id="vec_id", **options)


def _rounded(hits):
    return hits.select("query_id", F.col("doc_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def knn_topk(spark, sf_dir):
    return _rounded(_nearest(spark, sf_dir, k=K))


def knn_prefilter(spark, sf_dir):
    return _rounded(_nearest(spark, sf_dir, k=K, filter_key="label"))


def knn_postfilter(spark, sf_dir):
    return _rounded(_nearest(spark, sf_dir, k=K, filter_key="label", mode="post", metric="squared_l2"))


def knn_self(spark, sf_dir):
    """Every vector as a query, as when each chunk looks for related ones."""
    rows = table(spark, sf_dir, "embeddings")
    return _rounded(retrieval.nearest(rows, rows, k=3, query_id="vec_id", doc_id="vec_id"))


def knn_cells(spark, sf_dir):
    """The same by cells around pivots, the way for more queries than tasks can hold."""
    rows = table(spark, sf_dir, "embeddings")
    return _rounded(
        retrieval.nearest(rows, rows, k=3, query_id="vec_id", doc_id="vec_id", max_broadcast=50, block_rows=64)
    )


def knn_key_blocks(spark, sf_dir):
    """Every vector among those of its label, by blocks of a label."""
    rows = table(spark, sf_dir, "embeddings")
    hits = retrieval.nearest(
        rows, rows, k=3, query_id="vec_id", doc_id="vec_id", filter_key="label", max_broadcast=50, block_rows=64
    )
    return _rounded(hits)


def knn_filtered_search(spark, sf_dir):
    """Metadata filters as given by a caller, on the map column."""
    docs = table(spark, sf_dir, "embeddings").withColumn(
        "meta", F.create_map(F.lit("label"), F.col("label").cast("string"))
    )
    hits = retrieval.search(_centres(spark, sf_dir), docs, k=5, filters={"label": 3}, doc_id="vec_id")
    return _rounded(hits)


def _hits(spark, sf_dir):
    """Hits with the columns of chunks; the label stands for the file."""
    hits = _nearest(spark, sf_dir, k=20)
    docs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.when(F.col("label") != 9, F.concat(F.lit("src/f"), "label")).alias("file_path"),
        F.concat(F.lit("l"), "label").alias("language"),
        F.col("vec_id").alias("start_line"),
        (F.col("vec_id") + 9).alias("end_line"),
        (F.col("label") > 4).alias("is_chunk"),
        F.col("label").alias("chunk_index"),
        F.lit(10).alias("total_chunks"),
        F.concat(F.lit("text "), "vec_id").alias("content"),
    )
    return hits.join(docs, "doc_id")


def related_files(spark, sf_dir):
    out = retrieval.related_files(_hits(spark, sf_dir))
    return out.select(
        "query_id", "file_path", F.round("score", 6).alias("score"), "file_rank", "start_line",
        F.array_join("contents", "|").alias("contents"),
    )


def related_context(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    full = retrieval.context_text(hits).select("query_id", md5_of("context", "full"))
    return full.join(
        retrieval.context_plain(hits).select("query_id", md5_of("context", "plain")), "query_id"
    )


def context_totals(spark, sf_dir):
    out = retrieval.context_totals(_hits(spark, sf_dir))
    return out.withColumn("avg_score", F.round("avg_score", 6))


def hashed_embedding(spark, sf_dir):
    """Unit vectors of documents made without a model, each number rounded to four digits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = retrieval.hashed_embedding(docs, dimension=WIDTH)
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double") * 10_000).cast("int"))
    return out.select("doc_id", vectors.is_zero("embedding").alias("zero"), F.md5(F.array_join(rounded, ",")).alias("md5"))


TEMPLATE = "Write six sections."


def prompt_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = reports.prompt_table(docs, TEMPLATE, "text", context="source", rules="lang")
    return out.select("doc_id", md5_of("prompt", "prompt"), md5_of("retry_prompt", "retry"))


def fallback_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    failed = docs.select(
        "doc_id", F.col("source").alias("file_name"), F.col("lang").alias("language"),
        F.when(F.col("lang") == "fr", "read error").alias("error"), F.col("text").alias("requirements"),
        reports.chunk_fallback("source", "doc_id").alias("chunk"), reports.chunk_error("lang").alias("chunk_error"),
    )
    out = reports.with_text(reports.with_fallback(failed))
    return out.select("doc_id", md5_of("requirements"), md5_of("chunk", "chunk"), md5_of("chunk_error", "chunk_error"))


def result_export(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    results = docs.select(F.col("source").alias("file_name"), F.col("doc_id").cast("string").alias("rel_path"), F.col("lang").alias("requirements"))
    return reports.export_rows(reports.by_path(results))


_SQL_CENTRES = """means AS (
  SELECT label, pos, avg(x::DOUBLE) AS x FROM (
    SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos),
centres AS (SELECT label AS query_id, label, list(x ORDER BY pos) AS c FROM means GROUP BY label)"""


def _sql_hits(k: int, distance: str = "list_distance(c, embedding::DOUBLE[])", on: str = "true") -> str:
    return f"""WITH {_SQL_CENTRES},
scored AS (
  SELECT query_id, q.label AS want, vec_id, e.label, {distance} AS d FROM centres q JOIN embeddings e ON {on}),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, 1 / (1 + d) AS score
  FROM scored QUALIFY rank <= {k})"""


_SQL_FILES = _sql_hits(20) + """,
named AS (SELECT *, CASE WHEN label = 9 THEN 'unknown' ELSE 'src/f' || label END AS file_path FROM hits),
files AS (
  SELECT query_id, file_path, max(score) AS score, min(rank) AS best, arg_min(vec_id, rank) AS start_line,
    arg_min(label, rank) AS label, list('text ' || vec_id ORDER BY rank) AS contents
  FROM named GROUP BY query_id, file_path)"""

_SQL_SELF = """WITH scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS d
  FROM embeddings q JOIN embeddings d ON {on})
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank,
  round(1 / (1 + d), 6) AS score
FROM scored QUALIFY rank <= 3"""

QUERIES = {
    "zero_dim_filter": Query(
        zero_dim_filter, "SELECT vec_id, label FROM embeddings WHERE label NOT IN (0, 1)"
    ),
    "vector_counts": Query(
        vector_counts,
        """SELECT count(*) FILTER (label > 1) AS added, count(*) FILTER (label <= 1) AS skipped,
  count(*) FILTER (label = 0) AS zero_vectors FROM embeddings""",
    ),
    "vector_json": Query(
        vector_json, "SELECT vec_id, len(embedding) AS width, 0.0::DOUBLE AS d2 FROM embeddings"
    ),
    "knn_topk": Query(knn_topk, _sql_hits(K) + " SELECT query_id, vec_id, rank, round(score, 6) AS score FROM hits"),
    "knn_prefilter": Query(
        knn_prefilter,
        _sql_hits(K, on="q.label = e.label") + " SELECT query_id, vec_id, rank, round(score, 6) AS score FROM hits",
    ),
    "knn_postfilter": Query(
        knn_postfilter,
        _sql_hits(2 * K, "list_sum(list_transform(list_zip(c, embedding), lambda p: (p[1] - p[2]::DOUBLE) * (p[1] - p[2]::DOUBLE)))")
        + """ SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, round(score, 6) AS score
FROM hits WHERE want = label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 10""",
    ),
    "knn_self": Query(knn_self, _SQL_SELF.format(on="true")),
    "knn_cells": Query(knn_cells, _SQL_SELF.format(on="true")),
    "knn_key_blocks": Query(knn_key_blocks, _SQL_SELF.format(on="q.label = d.label")),
    "knn_filtered_search": Query(
        knn_filtered_search,
        _sql_hits(5, on="e.label = 3") + " SELECT query_id, vec_id, rank, round(score, 6) AS score FROM hits",
    ),
    "related_files": Query(
        related_files,
        _SQL_FILES
        + """ SELECT query_id, file_path, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY best) AS file_rank, start_line,
  array_to_string(contents, '|') AS contents FROM files""",
    ),
    "related_context": Query(
        related_context,
        _SQL_FILES
        + """,
blocks AS (
  SELECT query_id, best, concat_ws(chr(10), 'File: ' || file_path, 'Language: l' || label,
    'Lines: ' || start_line || '-' || (start_line + 9),
    CASE WHEN label > 4 THEN 'Chunk: ' || (label + 1) || '/10' END,
    'Content:', array_to_string(contents, chr(10)), '---') AS block
  FROM files)
SELECT b.query_id, md5(string_agg(block, chr(10) ORDER BY best)) AS full,
  any_value(p.plain) AS plain
FROM blocks b JOIN (SELECT query_id, md5(string_agg('text ' || vec_id, chr(10) || '---' || chr(10) ORDER BY rank)) AS plain
  FROM hits GROUP BY query_id) p ON p.query_id = b.query_id
GROUP BY b.query_id""",
    ),
    "context_totals": Query(
        context_totals,
        _SQL_FILES
        + """ SELECT query_id, count(DISTINCT file_path) AS total_files, count(*) AS total_chunks,
  round(avg(score), 6) AS avg_score FROM named GROUP BY query_id""",
    ),
    "vector_roundtrip": Query(
        vector_roundtrip,
        f"""SELECT vec_id, 'c' || vec_id AS content, {WIDTH} AS width, true AS stamped, 0 AS strangers
FROM embeddings WHERE label = 3 AND vec_id % 3 = 1""",
    ),
    "hashed_embedding": Query(
        hashed_embedding,
        f"""WITH places AS (
  SELECT doc_id, list_transform(
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: w <> ''),
    lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % {WIDTH})::INT) AS p FROM documents),
counts AS (
  SELECT d.doc_id, k.k, count(u.x) AS n
  FROM (SELECT doc_id FROM documents) d CROSS JOIN (SELECT unnest(range({WIDTH})) AS k) k
  LEFT JOIN (SELECT doc_id, unnest(p) AS x FROM places) u ON u.doc_id = d.doc_id AND u.x = k.k GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(greatest(sum(n * n), 1)) AS norm FROM counts GROUP BY doc_id)
SELECT doc_id, sum(n) = 0 AS zero,
  md5(string_agg(round((n / norm)::FLOAT::DOUBLE * 10000)::INT, ',' ORDER BY k)) AS md5
FROM counts JOIN norms USING (doc_id) GROUP BY doc_id""",
    ),
    "prompt_table": Query(
        prompt_table,
        f"""SELECT doc_id,
  md5('{TEMPLATE}' || chr(10) || 'Detected rules for context:' || chr(10) || lang || chr(10) || chr(10) || text) AS prompt,
  md5('{TEMPLATE}' || chr(10) || chr(10) || 'Here is related context from the project:' || chr(10) || '---' || chr(10)
    || source || chr(10) || '---' || chr(10) || text) AS retry
FROM documents""",
    ),
    "fallback_rows": Query(
        fallback_rows,
        """SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN
  'Overview' || chr(10) || 'Limited analysis for ' || source || ' due to read error. ' || chr(10) || chr(10)
  || 'Objective' || chr(10) || 'To support core fr business functions.' || chr(10) || chr(10)
  || 'Use Case' || chr(10) || 'General fr business processes.' || chr(10) || chr(10)
  || 'Key Functionalities' || chr(10) || '1. Basic Processing: Performs core tasks.' || chr(10) || chr(10)
  || '2. Support Functions: Assists operations.' || chr(10) || chr(10)
  || 'Workflow Summary' || chr(10) || 'Integrates with fr system workflow.' ELSE text END) AS md5,
  md5('Overview' || chr(10) || 'Failed to process chunk ' || doc_id || ' of ' || source || '.' || chr(10) || chr(10)
  || 'Objective' || chr(10) || 'To support chunk functionality.' || chr(10) || chr(10)
  || 'Use Case' || chr(10) || 'General chunk operations.' || chr(10) || chr(10)
  || 'Key Functionalities' || chr(10) || '1. Partial Processing: Supports chunk ' || doc_id || ' operations.' || chr(10) || chr(10)
  || '2. Fallback: Provides basic functionality.' || chr(10) || chr(10)
  || 'Workflow Summary' || chr(10) || 'Processes available chunk data.') AS chunk,
  md5('Overview' || chr(10) || 'Error analyzing ' || lang || ' code segment.' || chr(10) || chr(10)
  || 'Objective' || chr(10) || 'Unable to determine specific objectives.' || chr(10) || chr(10)
  || 'Use Case' || chr(10) || 'General ' || lang || ' file operations.' || chr(10) || chr(10)
  || 'Key Functionalities' || chr(10) || '1. Basic Processing: Handles core tasks.' || chr(10) || chr(10)
  || '2. Error Recovery: Provides fallback functionality.' || chr(10) || chr(10)
  || 'Workflow Summary' || chr(10) || 'Supports basic ' || lang || ' file workflow.') AS chunk_error
FROM documents WHERE trim(text, ' ' || chr(10)) <> '' OR lang = 'fr'""",
    ),
    "result_export": Query(
        result_export,
        """SELECT '{"file_name":"' || source || '","rel_path":"' || doc_id || '","requirements":"' || lang || '"}' AS value
FROM documents""",
    ),
}
