"""Tables, and corpora that Spark derives from them, with the SQL of each."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.strings import let
from corpusloom.session import ensure_checkpoint_dir, spread


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


# tables of long texts, where a row is much work
TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def new_folder(spark: SparkSession) -> str:
    """A folder of its own, not there yet, below the shared one for checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


def sql_strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    listed = ", ".join(sql_text(v) for v in values)
    return f"list_extract([{listed}], ({index} % {len(values)})::INT + 1)"


# --- documents as files of mixed kinds, some of them in ignored folders ---

EXTENSIONS = [
    ".py", ".js", ".ts", ".java", ".cs", ".rb", ".css", ".log", ".md", ".txt", ".html", ".exe", ".PY",
    ".xlsm", "",
]
FOLDERS = ["src", "lib", "node_modules", "about", ".git", "build", "docs"]


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws(
        "/", "source", pick(FOLDERS, F.col("doc_id")), "lang",
        F.concat(F.lit("doc"), "doc_id", pick(EXTENSIONS, F.col("doc_id"))),
    )
    return docs.select("doc_id", "text", "lang", "source", path.alias("rel_path"))


SQL_MIXED_FILES = f"""
mixed_files AS (
  SELECT doc_id, text, lang, source,
    source || '/' || {sql_pick(FOLDERS, 'doc_id')} || '/' || lang || '/doc' || doc_id
      || {sql_pick(EXTENSIONS, 'doc_id')} AS rel_path
  FROM documents)"""


# --- documents as source files: the first word of each line becomes a statement, the line a comment ---

# language tag of a text -> language, extension, statement before and after the word, comment mark
CODE_KINDS = {
    "en": ("Python", ".py", "import ", ", os", "# "),
    "fr": ("JavaScript", ".js", "import { x } from './", "';", "// "),
    "de": ("TypeScript", ".ts", "import { x } from './", "';", "// "),
    "es": ("Ruby", ".rb", "require '", "'", "# "),
}
OTHER_KIND = ("Java", ".java", "import ", ";", "// ")


def by_kind(item: int) -> Column:
    out = F.lit(OTHER_KIND[item])
    for lang, kind in CODE_KINDS.items():
        out = F.when(F.col("lang") == lang, kind[item]).otherwise(out)
    return out


def sql_by_kind(item: int) -> str:
    cases = " ".join(f"WHEN '{lang}' THEN {sql_text(k[item])}" for lang, k in CODE_KINDS.items())
    return f"(CASE lang {cases} ELSE {sql_text(OTHER_KIND[item])} END)"


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), "([a-z]+)", 1)


def _word_or_x(text: Column) -> Column:
    return let(first_word(text), lambda w: F.when(w != "", w).otherwise("x"))


def worded_lines(text: Column) -> Column:
    """``array<struct<word, line>>`` of all lines; the word of one without a letter a-z is ``x``."""
    return F.transform(F.split(text, "\n"), lambda l: F.struct(_word_or_x(l).alias("word"), l.alias("line")))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project_id, rel_path, file_name, language, text`` and the document's own columns."""
    docs = table(spark, sf_dir, "documents")
    before, after, mark = by_kind(2), by_kind(3), by_kind(4)
    content = F.array_join(
        F.transform(
            worded_lines(F.col("text")),
            lambda r: F.concat(before, r["word"], after, F.lit("\n"), mark, r["line"]),
        ),
        "\n",
    )
    name = F.concat(_word_or_x(F.col("text")), by_kind(1))
    return docs.select(
        F.col("source").alias("project_id"),
        F.concat_ws("/", "lang", F.concat(F.lit("d"), "doc_id"), name).alias("rel_path"),
        name.alias("file_name"),
        by_kind(0).alias("language"),
        content.alias("text"),
        "doc_id",
        "lang",
        F.col("text").alias("prose"),
    )


SQL_CODE_FILES = f"""
worded AS (
  SELECT doc_id, lang, source, text,
    regexp_extract(lower(text), '([a-z]+)', 1) AS head,
    list_transform(string_split(text, chr(10)),
      lambda l: {{'word': coalesce(nullif(regexp_extract(lower(l), '([a-z]+)', 1), ''), 'x'), 'line': l}}) AS rows
  FROM documents),
code_files AS (
  SELECT *, source AS project_id, {sql_by_kind(0)} AS language, {sql_by_kind(1)} AS ext,
    coalesce(nullif(head, ''), 'x') AS stem,
    coalesce(nullif(head, ''), 'x') || {sql_by_kind(1)} AS file_name,
    lang || '/d' || doc_id || '/' || coalesce(nullif(head, ''), 'x') || {sql_by_kind(1)} AS rel_path
  FROM worded),
code_imports AS (
  SELECT project_id, rel_path AS src_path, language, ext, file_name AS src_name, pos - 1 AS import_pos,
    rows[pos].word AS word
  FROM code_files, LATERAL (SELECT unnest(range(1, len(rows) + 1)) AS pos))"""


# dependencies of the code corpus, resolved in SQL
SQL_DEPENDENCIES = SQL_CODE_FILES + """,
lookup AS (
  SELECT project_id, name, max(rel_path) AS target_path FROM (
    SELECT project_id, file_name AS name, rel_path FROM code_files
    UNION ALL SELECT project_id, stem, rel_path FROM code_files)
  GROUP BY project_id, name),
asked AS (
  SELECT project_id, src_path, src_name, language, word, min(import_pos) AS import_pos
  FROM code_imports GROUP BY ALL),
options AS (
  SELECT *, CASE language
      WHEN 'Python' THEN [word || '.py', word]
      WHEN 'JavaScript' THEN [word || '.js', word, word || '.jsx']
      WHEN 'TypeScript' THEN [word || '.ts', word, word || '.tsx']
      WHEN 'Ruby' THEN [word || '.rb', word]
      ELSE [word || '.java', word] END AS names
  FROM asked),
ranked AS (
  SELECT o.project_id, o.src_path, o.src_name, o.language, o.word, o.import_pos, l.target_path,
    row_number() OVER (PARTITION BY o.project_id, o.src_path, o.import_pos ORDER BY o.rank) AS n
  FROM (SELECT *, unnest(names) AS name, unnest(range(len(names))) AS rank FROM options) o
  JOIN lookup l ON l.project_id = o.project_id AND l.name = o.name),
dependencies AS (
  SELECT project_id, src_path, target_path,
    regexp_replace(target_path, '^.*/', '') AS file_name,
    arg_min(CASE language
      WHEN 'Python' THEN 'Imports ' || word || ' module, providing functionality for ' || src_name || '.'
      WHEN 'JavaScript' THEN 'Imports ' || word || ', providing components or utilities for ' || src_name || '.'
      WHEN 'TypeScript' THEN 'Imports ' || word || ', providing components, services, or modules for ' || src_name || ' (Angular/TypeScript).'
      WHEN 'Ruby' THEN 'Requires ' || word || ' module, providing functionality for ' || src_name || ' (Ruby).'
      ELSE 'Imports ' || word || ' package or class, providing functionality for ' || src_name || ' (Java).' END,
      import_pos) AS reason
  FROM ranked WHERE n = 1 GROUP BY project_id, src_path, target_path)"""


def md5_of(name: str, alias: str = "md5") -> Column:
    return F.md5(name).alias(alias)
