"""Scalar text functions, JSON, fact summaries and diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import jsontext, paths, tokens
from corpusloom.functions import sections as S
from corpusloom.functions.diagram_text import is_drawable, type_mismatch
from corpusloom.functions.strings import ellipsis
from corpusloom.operators import diagrams, reports, summaries
from corpusloom.sources import diagrams as cache
from corpusloom.sources import files, workbooks
from corpusloom.streaming import ingest

from .base import Query, md5_of, new_folder, sql_strip, table, worded_lines

# --- cuts and checks ---


def text_cuts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.md5(tokens.truncate_words(text, 100)).alias("words"),
        F.md5(tokens.truncate_over_limit(text, 400)).alias("over_limit"),
        F.md5(tokens.truncate_medium(text, 400)).alias("medium"),
        F.md5(tokens.trim_context(text, F.col("source"), 500)).alias("context"),
        F.md5(tokens.first_window(text, 120)).alias("window"),
        F.md5(ellipsis(text)).alias("ellipsis"),
        tokens.content_hash(text).alias("sha"),
        F.md5(S.tidy(F.concat(F.replace(text, F.lit("\n"), F.lit("\n \n\n")), F.lit(" This Chunk")))).alias("tidy"),
        F.md5(F.array_join(S.sentences(text), "|")).alias("sentences"),
        F.md5(S.complete_sentences(text)).alias("complete"),
    )


SQL_SENTENCES = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_SENTENCES = SQL_SENTENCES.format("text")


def path_checks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    url = F.regexp_replace("url", "^https?://[^/]*/en/", "https://github.com/")
    windows = F.concat(F.lit("C:\\"), F.translate(F.substring("url", F.lit(9), F.length("url")), "/", "\\"))
    return pages.select(
        "page_id",
        paths.clean_folder_name("url").alias("folder"),
        paths.clean_folder_name(F.concat(F.col("url"), F.lit("/main/")), drop_main=True).alias("root"),
        paths.is_github_url(url).alias("github"),
        paths.is_windows_path(windows).alias("windows"),
        paths.extension("url").alias("ext"),
        paths.stem("url").alias("stem"),
        paths.parent("url").alias("parent"),
    )


# --- JSON ---


def json_props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    wrapped = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("see\n```json\n["), "props", F.lit("]\n``` done")))
        .when(F.col("event_type") == "view", F.concat(F.lit("```\n["), "props", F.lit("]\n```")))
        .when(F.col("event_type") == "error", F.concat(F.lit("rules: ["), "props", F.lit(", {}] end")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.concat(F.lit("[broken "), "props"))
    )
    found = jsontext.extract_json(wrapped)
    return events.select(
        "event_id",
        F.try_variant_get(found, "$[0].k", "int").alias("k"),
        found.isNotNull().alias("parsed"),
        F.array_join(jsontext.object_keys("props"), ",").alias("keys"),
    )


# --- source text of the summaries, derived from documents line by line ---


def _worded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", "text", worded_lines(F.col("text")).alias("rows"))


_SQL_WORDED = """worded AS (
  SELECT doc_id, lang, source, text, list_transform(string_split(text, chr(10)),
    lambda l: {'word': coalesce(nullif(regexp_extract(lower(l), '([a-z]+)', 1), ''), 'x'), 'line': l}) AS rows
  FROM documents)"""


def _joined(rows, line, sep="\n"):
    return F.array_join(F.transform(rows, line), sep)


def _sql_joined(line: str, sep: str = "chr(10)", rows: str = "rows") -> str:
    """``line`` may use r and its number i (from 1)."""
    return f"coalesce(array_to_string(list_transform({rows}, lambda r, i: {line}), {sep}), '')"


def vba_modules(spark, sf_dir):
    text = _joined(
        F.col("rows"),
        lambda r, i: F.concat(
            F.lit(" --- VBA Module: "), r["word"], F.lit(" ---\nPublic Sub "), r["word"], F.lit("_go(x, "),
            (i + 1).cast("string"), F.lit(")\n  ' "), r["line"],
        ),
    )
    found = _worded(spark, sf_dir).select("doc_id", text.alias("t"))
    return found.select("doc_id", F.posexplode(summaries.vba_modules("t")).alias("place", "m")).select(
        "doc_id", "place", "m.module", "m.parameters", "m.comments", F.md5("m.logic").alias("logic")
    )


def vba_procedures(spark, sf_dir):
    text = _joined(
        F.col("rows"),
        lambda r: F.concat(F.lit("' about "), r["line"], F.lit("\nFunction "), r["word"], F.lit("(a)\nEnd Function\n\n\n")),
    )
    found = _worded(spark, sf_dir).select("doc_id", text.alias("t"))
    return found.select("doc_id", F.posexplode(summaries.vba_procedures("t")).alias("place", "p")).select(
        "doc_id", "place", "p.kind", "p.name", "p.parameters", F.md5("p.comments").alias("comments")
    )


def _workbook_text():
    facts = _joined(
        F.col("rows"),
        lambda r, i: F.concat(
            F.lit("CELL: A"), (i + 1).cast("string"), F.lit(" = "), r["word"],
            F.lit("\nFORMULA: B"), (i + 1).cast("string"), F.lit(" = SUM("), r["line"],
            F.lit(")\nDATA_VALIDATION: Range: C1 | Type: list | Formula1: "), r["word"],
            F.lit(" | Formula2: 9"),
        ),
    )
    names = _joined(F.col("rows"), lambda r: F.concat(F.lit("  - "), r["word"], F.lit(": $A$1")))
    return F.concat(
        F.lit("=== WORKSHEET DATA ===\n\n--- Sheet: "), "source", F.lit(" ---\n"), facts,
        F.lit("\nCONDITIONAL_FORMATTING: Range: D1 | Type: expression | Formula: x>1\n\n  Named Ranges:\n"), names,
        F.lit("\n\nPivot Tables in "), "source", F.lit(":\n  - Name: p1"),
    )


_SQL_WORKBOOK_NAMES = _sql_joined("'Named Range: - ' || r.word || ': $A$1'")


def workbook_summary(spark, sf_dir):
    text = _worded(spark, sf_dir).select("doc_id", _workbook_text().alias("t"))
    return text.select("doc_id", F.md5(summaries.workbook_summary("t")).alias("md5"))


def workbook_lines(spark, sf_dir):
    text = _worded(spark, sf_dir).select("doc_id", "lang", _workbook_text().alias("text"))
    rows = workbooks.workbook_lines(text, ["doc_id"])
    return rows.select(
        "doc_id", "sheet", "kind", "ref", F.md5(F.coalesce("value", F.lit(""))).alias("value"),
        "cell_range", "rule_type", "formula1", "formula2",
    )


def csharp_summary(spark, sf_dir):
    methods = _joined(
        F.col("rows"),
        lambda r, i: F.concat(
            F.lit("public static IHost "), r["word"], (i + 1).cast("string"), F.lit("(this IHost b)\n{ b."),
            F.element_at(
                F.array(*[F.lit(x) for x in ("AddHealthChecks", "AddLogging", "UseRouting", "None")]), i % 4 + 1
            ),
            F.lit("(); // "), F.translate(r["line"], "{}", "  "), F.lit(" }"),
        ),
    )
    text = _worded(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("static class Ext"), "doc_id", F.lit(" {\n"), methods).alias("t")
    )
    return text.select("doc_id", F.md5(summaries.csharp_summary("t")).alias("md5"))


def _plain(line):
    """A line as the text of a comment, without marks that would end it or mean something."""
    return F.translate(line, "\"'`{}()<>@=", " " * 11)


CONFIG_EXTENSIONS = {"en": ".yml", "fr": ".http", "de": ".sln", "es": ".csproj"}


def config_summary(spark, sf_dir):
    rows = F.col("rows")
    text = (
        F.when(F.col("lang") == "en", _joined(rows, lambda r: F.concat(F.lit(" "), r["word"], F.lit(": # "), r["line"])))
        .when(F.col("lang") == "fr", _joined(rows, lambda r: F.concat(F.lit("GET /"), r["word"], F.lit("\nHost: "), r["line"])))
        .when(
            F.col("lang") == "de",
            _joined(rows, lambda r: F.concat(F.lit('Project("{A-1}") = "'), r["word"], F.lit('", "x"\n# '), _plain(r["line"]))),
        )
        .otherwise(
            _joined(
                rows,
                lambda r: F.concat(
                    F.lit('<ProjectReference Include="'), r["word"], F.lit('" /><PackageReference Include="'),
                    r["word"], F.lit('" Version="1.0" /><!-- '), _plain(r["line"]), F.lit(" -->"),
                ),
            )
        )
    )
    ext = F.lit(".csproj")
    for lang, e in CONFIG_EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    files = _worded(spark, sf_dir).select(
        "doc_id", text.alias("t"), F.concat(F.lit("app/config"), ext).alias("path")
    )
    return files.select("doc_id", F.md5(summaries.config_summary("t", "path")).alias("md5"))


def config_json(spark, sf_dir):
    """Event properties as JSON files, broken ones included."""
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    return events.select(
        "event_id",
        summaries.config_summary(text, F.lit("a.json")).alias("config"),
        summaries.angular_summary(text, F.lit("angular.json")).alias("angular"),
    )


def angular_summary(spark, sf_dir):
    text = _joined(
        F.col("rows"),
        lambda r, i: F.concat(
            F.element_at(F.array(F.lit("@Component"), F.lit("@Injectable"), F.lit("@NgModule")), i % 3 + 1),
            F.lit("({ selector: 'app-"), r["word"], F.lit("' })\nexport class "), r["word"], F.lit("Part {} // "),
            _plain(r["line"]),
        ),
    )
    files = _worded(spark, sf_dir).select("doc_id", text.alias("t"))
    return files.select("doc_id", F.md5(summaries.angular_summary("t", F.lit("a/part.ts"))).alias("md5"))


def top_tags(spark, sf_dir):
    return summaries.top_tags(table(spark, sf_dir, "pages"), ["page_id"])


def html_summary(spark, sf_dir):
    return summaries.html_summary(table(spark, sf_dir, "pages"), ["page_id"])


_SQL_TAGS = """tags AS (
  SELECT page_id, tag, count(*) AS uses, min(pos) AS first FROM (
    SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS pos
    FROM (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z0-9_-]+)', 1) AS t FROM pages))
  GROUP BY page_id, tag),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY uses DESC, first) AS place FROM tags
  QUALIFY place <= 5)"""


# --- diagrams ---


def _diagram_code(spark, sf_dir):
    """A chain over the lines: the first node of each arrow but the first is named by its id."""
    rows = F.col("rows")
    node = lambda r, i: F.concat(F.lit("N"), i.cast("string"), F.lit("["), r["word"], F.lit("]"))
    arrow = lambda i: F.when(i % 3 == 0, F.lit("---")).otherwise("-->")
    later = F.transform(
        F.slice(rows, F.lit(2), F.size(rows)),
        lambda r, i: F.concat(
            F.lit("    "),
            F.when(i == 0, node(rows[0], i)).otherwise(F.concat(F.lit("N"), i.cast("string"))),
            F.lit(" "), arrow(i), F.lit(" "), node(r, i + 1),
        ),
    )
    code = F.concat(F.lit("graph TD\n"), F.array_join(later, "\n"))
    return _worded(spark, sf_dir).select("doc_id", "lang", code.alias("generated_code"))


def diagram_edges(spark, sf_dir):
    return diagrams.diagram_edges(_diagram_code(spark, sf_dir), ["doc_id"])


def diagram_checks(spark, sf_dir):
    code = F.col("generated_code")
    output = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Here:\n```mermaid\n"), code, F.lit("\n```")))
        .when(F.col("lang") == "fr", code)
        .when(F.col("lang") == "de", F.concat(F.lit("flow"), code))
        .otherwise(F.translate(code, "\n", " "))
    )
    target = F.when(F.col("doc_id") % 2 == 0, "Requirement Diagram").otherwise("Entity Relationship Diagram")
    raw = _diagram_code(spark, sf_dir).select("doc_id", output.alias("output"), target.alias("target_graph"))
    checked = diagrams.check_outputs(raw)
    return checked.select(
        "doc_id",
        md5_of("generated_code"),
        is_drawable("generated_code").alias("drawable"),
        type_mismatch("generated_code", "target_graph").alias("mismatch"),
    )


def diagram_cache_roundtrip(spark, sf_dir):
    """Checked diagrams, an invalid one beside each, the valid ones written to the cache and read back."""
    target = F.lit("Requirement Diagram").alias("target_graph")
    made = _diagram_code(spark, sf_dir)
    bad = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("lang") == "de", "no graph").otherwise("graph TD")
    rows = made.select("doc_id", F.col("generated_code").alias("output"), target).unionByName(
        made.select("doc_id", bad.alias("output"), target)
    )
    valid = diagrams.keep_valid(diagrams.check_outputs(rows)).withColumn("content_hash", F.md5(F.col("doc_id").cast("string")))
    path = new_folder(spark)
    cache.write_diagrams(valid, path)
    back = cache.read_diagrams(spark, path)
    return back.select("content_hash", "target_graph", md5_of("generated_code"))


def diagram_folders(spark, sf_dir):
    """A folder named by the hash of each document's text, with the two diagrams of its cache, read back."""
    root = new_folder(spark)
    filesystem = files._filesystem  # the module as a whole cannot be sent to the workers

    def write(batches):
        import json

        for batch in batches:
            for folder, code in zip(batch["content_hash"], batch["code"]):
                for target in ("Entity Relationship Diagram", "Requirement Diagram"):
                    system, path = filesystem(f"{root}/{folder}/{target.replace(' ', '_')}.json")
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(path) as out:
                        out.write(json.dumps({"target_graph": target, "generated_code": code}, indent=2).encode())
            yield batch[["content_hash"]]

    docs = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("text").alias("text"))
    made = docs.select("content_hash", F.concat(F.lit("graph TD\n  A[\""), "text", F.lit("\"] --> B")).alias("code"))
    made.mapInPandas(write, "content_hash string").count()
    back = cache.read_diagram_folders(spark, root)
    return back.select("content_hash", "target_graph", md5_of("generated_code"))


_SQL_DIAGRAMS = _SQL_WORDED + """,
arrows AS (
  SELECT doc_id, lang, rows, i, 'N' || i AS src, CASE WHEN i % 3 = 0 THEN '---' ELSE '-->' END AS arrow,
    'N' || (i + 1) AS dst, rows[i + 1].word AS src_label, rows[i + 2].word AS dst_label
  FROM (SELECT *, unnest(range(0, len(rows) - 1)) AS i FROM worded)),
diagrams AS (
  SELECT doc_id, lang, 'graph TD' || chr(10) || string_agg('    ' || src
    || CASE WHEN i = 0 THEN '[' || src_label || ']' ELSE '' END || ' ' || arrow || ' ' || dst
    || '[' || dst_label || ']', chr(10) ORDER BY i) AS code
  FROM arrows GROUP BY doc_id, lang)"""


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _cache(spark, sf_dir):
    """English texts have both diagrams, French ones only the first."""
    targets = F.when(F.col("lang") == "en", F.array(*[F.lit(t) for t in diagrams.TARGET_DIAGRAMS])).when(
        F.col("lang") == "fr", F.array(F.lit(diagrams.TARGET_DIAGRAMS[0]))
    )
    return _requests(spark, sf_dir).select(
        tokens.content_hash("text").alias("content_hash"), F.explode(targets).alias("target_graph")
    )


def cache_hit(spark, sf_dir):
    return diagrams.cache_hits(_requests(spark, sf_dir), _cache(spark, sf_dir))


def cache_miss(spark, sf_dir):
    return diagrams.cache_misses(_requests(spark, sf_dir), _cache(spark, sf_dir))


_SQL_CACHE = """cached AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE lang = 'en'),
requests AS (SELECT sha256(text) AS content_hash, count(*) AS requests FROM documents GROUP BY 1)"""


# --- ingest and history ---


def content_dedup_ingest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = docs.where("lang = 'es'").select(tokens.content_hash("text").alias("content_hash"))
    return ingest.new_documents(docs, "doc_id", seen=seen).select("doc_id", "content_hash", "n_chars")


def recent_history(spark, sf_dir):
    return reports.recent(table(spark, sf_dir, "events"), "ts", tie="event_id").select(
        "event_id", "user_id", "event_type"
    )


QUERIES = {
    "text_cuts": Query(
        text_cuts,
        f"""SELECT doc_id,
  md5(CASE WHEN len(regexp_split_to_array({sql_strip('text')}, '\\s+')) > 100
    THEN array_to_string(list_slice(regexp_split_to_array({sql_strip('text')}, '\\s+'), 1, 100), ' ')
    ELSE text END) AS words,
  md5(CASE WHEN length(text) // 4 > 400 THEN substr(text, 1, 300) ELSE text END) AS over_limit,
  md5(CASE WHEN length(text) // 4 > 200
    THEN substr(text, 1, floor(length(text) * 400 * 0.3::DOUBLE / (length(text) // 4))::INT) ELSE text END) AS medium,
  md5(CASE WHEN length(text) // 4 + length(source) // 4 > 500 THEN substr(source, 1, 125) ELSE source END) AS context,
  md5(CASE WHEN length(text) // 4 > 120 THEN substr(text, 1, 480) ELSE text END) AS window,
  md5(CASE WHEN text = '' THEN 'No description available.' WHEN length(text) <= 150 THEN text
    ELSE substr(text, 1, 150) || '...' END) AS ellipsis,
  sha256(text) AS sha,
  md5(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10)) || ' This Chunk',
    '\\n\\s*\\n+', chr(10) || chr(10), 'g'), '(?i)this chunk|this segment', 'the code', 'g')) AS tidy,
  md5(array_to_string({_SENTENCES}, '|')) AS sentences,
  md5(CASE WHEN regexp_matches(list_last({_SENTENCES}), '[.!?]$') THEN text
    ELSE array_to_string(list_slice({_SENTENCES}, 1, len({_SENTENCES}) - 1), ' ') END) AS complete
FROM documents""",
    ),
    "path_checks": Query(
        path_checks,
        """SELECT page_id,
  coalesce(nullif(regexp_replace(rtrim(trim(url, '/\\- '), '-'), '[^0-9A-Za-z_\\-]', '_', 'g'), ''), 'project-root') AS folder,
  coalesce(nullif(regexp_replace(regexp_replace(rtrim(regexp_replace(trim(url || '/main/', '/\\- '), 'main/?$', ''), '-'),
    '^.*/', ''), '[^0-9A-Za-z_\\-]', '_', 'g'), ''), 'project-root') AS root,
  regexp_matches(url, '^https?://[^/]*/en/') AS github,
  NOT regexp_matches(replace(substr(url, 9), '/', '\\'), '[/:*?"<>|]') AS windows,
  lower(regexp_extract(regexp_replace(url, '^.*/', ''), '[^.](\\.[^.]*)$', 1)) AS ext,
  regexp_replace(regexp_replace(url, '^.*/', ''), '([^.])\\.[^.]*$', '\\1') AS stem,
  nullif(regexp_replace(url, '/[^/]*$', ''), '') AS parent
FROM pages""",
    ),
    "json_props": Query(
        json_props,
        """SELECT event_id,
  CASE WHEN event_type IN ('click', 'view', 'error', 'purchase') THEN (props->>'$.k')::INT END AS k,
  event_type IN ('click', 'view', 'error', 'purchase') AS parsed,
  array_to_string(json_keys(props), ',') AS keys
FROM events""",
    ),
    "vba_modules": Query(
        vba_modules,
        f"""WITH {_SQL_WORDED},
parts AS (
  SELECT doc_id, rows[i].word AS word, rows[i].line AS line, i
  FROM (SELECT *, unnest(range(1, len(rows) + 1)) AS i FROM worded)),
named AS (SELECT doc_id, word, min(i) AS first, max(i) AS last FROM parts GROUP BY doc_id, word)
SELECT n.doc_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY first) - 1 AS place,
  n.word || ' ---' AS module, n.word || '_go(x, ' || last || ')' AS parameters,
  {sql_strip('p.line')} AS comments,
  md5('Public Sub ' || n.word || '_go(x, ' || last || ')' || chr(10) || '  '' ' || p.line) AS logic
FROM named n JOIN parts p ON p.doc_id = n.doc_id AND p.i = n.last""",
    ),
    "vba_procedures": Query(
        vba_procedures,
        f"""WITH {_SQL_WORDED}
SELECT doc_id, i - 1 AS place, 'Function' AS kind, rows[i].word AS name, 'a' AS parameters,
  md5({sql_strip("''' about ' || rows[i].line")}) AS comments
FROM (SELECT *, unnest(range(1, len(rows) + 1)) AS i FROM worded)""",
    ),
    "workbook_summary": Query(
        workbook_summary,
        f"""WITH {_SQL_WORDED}
SELECT doc_id, md5(concat_ws(chr(10),
  nullif({_sql_joined("'Formula in B' || i || ': SUM(' || r.line || ')'")}, ''),
  nullif({_sql_joined("'Data Validation Rule: Range: C1 | Type: list | Formula1: ' || r.word || ' | Formula2: 9'")}, ''),
  'Conditional Formatting: Range: D1 | Type: expression | Formula: x>1',
  nullif({_SQL_WORKBOOK_NAMES}, ''),
  'Named Range: - Name: p1', 'Pivot Tables in ' || source || ':', '- Name: p1')) AS md5
FROM worded""",
    ),
    "workbook_lines": Query(
        workbook_lines,
        f"""WITH {_SQL_WORDED},
parts AS (
  SELECT doc_id, source, rows[i].word AS word, rows[i].line AS line, i
  FROM (SELECT *, unnest(range(1, len(rows) + 1)) AS i FROM worded))
SELECT doc_id, source AS sheet, 'cell' AS kind, 'A' || i AS ref, md5(word) AS value,
  NULL AS cell_range, NULL AS rule_type, NULL AS formula1, NULL AS formula2 FROM parts
UNION ALL SELECT doc_id, source, 'formula', 'B' || i, md5('SUM(' || line || ')'), NULL, NULL, NULL, NULL FROM parts
UNION ALL SELECT doc_id, source, 'data_validation', NULL, md5(''), 'C1', 'list', word, '9' FROM parts
UNION ALL SELECT doc_id, source, 'conditional_formatting', NULL, md5(''), 'D1', 'expression', 'x>1', NULL FROM worded
UNION ALL SELECT doc_id, source, 'named_range', word, md5('$A$1'), NULL, NULL, NULL, NULL FROM parts
UNION ALL SELECT doc_id, NULL, 'pivot', 'Name', md5('p1'), NULL, NULL, NULL, NULL FROM worded""",
    ),
    "csharp_summary": Query(
        csharp_summary,
        f"""WITH {_SQL_WORDED}
SELECT doc_id, md5(replace(replace(replace(replace(
  'This file defines the ''Ext' || doc_id || ''' static class, providing extension methods to streamline service and middleware configuration in ASP.NET Core applications.'
  || chr(10) || 'Key functionalities include:' || chr(10)
  || coalesce(nullif({_sql_joined('''CASE (i - 1) % 4
      WHEN 0 THEN '- \'\'' || r.word || i || '\'\': Registers health check endpoints for service monitoring.'
      WHEN 1 THEN '- \'\'' || r.word || i || '\'\': Configures application logging (console, debug).'
      WHEN 2 THEN '- \'\'' || r.word || i || '\'\': Sets up middleware for routing and health check endpoints.'
      ELSE '- \'\'' || r.word || i || '(this IHost b)\'\': Extension method for ASP.NET Core services.' END''')}, ''),
    '- No extension methods detected.'),
  'macro', ''), 'xlsm', ''), 'Excel', ''), 'sheet', '')) AS md5
FROM worded""",
    ),
    "config_summary": Query(
        config_summary,
        f"""WITH {_SQL_WORDED}
SELECT doc_id, md5(CASE lang
  WHEN 'en' THEN 'YAML config file; top-level keys: ' || {_sql_joined('r.word', "', '", 'list_slice(rows, 1, 10)')} || '.'
  WHEN 'fr' THEN 'HTTP file; endpoints: ' || {_sql_joined("'GET /' || r.word", "', '", 'list_slice(rows, 1, 5)')} || '.'
  WHEN 'de' THEN 'Solution file; projects: ' || {_sql_joined('r.word', "', '")} || '.'
  ELSE CASE WHEN len(rows) = 0 THEN 'No project references detected.' ELSE
    'Project References: ' || {_sql_joined('r.word', "', '")} || chr(10)
    || 'NuGet Packages: ' || {_sql_joined("r.word || ' (1.0)'", "', '")} END END) AS md5
FROM worded""",
    ),
    "config_json": Query(
        config_json,
        """SELECT event_id,
  CASE WHEN event_type = 'error' THEN 'JSON config file; unable to parse.'
    ELSE 'JSON config file; top-level keys: ' || array_to_string(json_keys(props), ', ') || '.' END AS config,
  CASE WHEN event_type = 'error' THEN 'Angular JSON config file; unable to parse.'
    ELSE 'Angular JSON config; top-level keys: ' || array_to_string(json_keys(props), ', ') || '.' END AS angular
FROM events""",
    ),
    "angular_summary": Query(
        angular_summary,
        f"""WITH {_SQL_WORDED}
SELECT doc_id, md5(CASE WHEN len(rows) = 0 THEN 'Angular TypeScript file; no decorators or classes detected.' ELSE
  'Decorators: ' || array_to_string(list_slice(['Component', 'Injectable', 'NgModule'], 1, least(3, len(rows))), ', ')
  || '. Classes: ' || {_sql_joined("r.word || 'Part'", "', '")}
  || '. Selectors: ' || {_sql_joined("'app-' || r.word", "', '")} || '.' END) AS md5
FROM worded""",
    ),
    "top_tags": Query(top_tags, f"WITH {_SQL_TAGS} SELECT page_id, tag, uses, place FROM placed"),
    "html_summary": Query(
        html_summary,
        f"""WITH {_SQL_TAGS}
SELECT p.page_id, 'HTML template file; main tags: ' || coalesce(string_agg(tag, ', ' ORDER BY place), '') || '.' AS summary
FROM pages p LEFT JOIN placed t ON t.page_id = p.page_id GROUP BY p.page_id""",
    ),
    "diagram_edges": Query(
        diagram_edges,
        f"""WITH {_SQL_DIAGRAMS}
SELECT doc_id, i + 1 AS line_no, src, arrow, dst, src_label, dst_label FROM arrows""",
    ),
    "diagram_folders": Query(
        diagram_folders,
        """SELECT sha256(text) AS content_hash, t AS target_graph, md5('graph TD' || chr(10) || '  A["' || text || '"] --> B') AS md5
FROM (SELECT DISTINCT text FROM documents), (VALUES ('Entity Relationship Diagram'), ('Requirement Diagram')) v(t)""",
    ),
    "diagram_cache_roundtrip": Query(
        diagram_cache_roundtrip,
        f"""WITH {_SQL_DIAGRAMS}
SELECT md5(doc_id::VARCHAR) AS content_hash, 'Requirement Diagram' AS target_graph, md5(code) AS md5 FROM diagrams""",
    ),
    "diagram_checks": Query(
        diagram_checks,
        f"""WITH {_SQL_DIAGRAMS}
SELECT doc_id, md5(CASE WHEN lang IN ('en', 'fr') THEN code
    WHEN lang = 'de' THEN 'Error: Invalid graph type. Must start with ''graph TD'' or ''graph LR'''
    ELSE 'Error: Insufficient graph definition for '
      || CASE WHEN doc_id % 2 = 0 THEN 'Requirement Diagram' ELSE 'Entity Relationship Diagram' END END) AS md5,
  lang IN ('en', 'fr') AS drawable, true AS mismatch
FROM diagrams
UNION ALL
SELECT doc_id, md5(CASE WHEN lang = 'en' THEN 'graph TD'
    ELSE 'Error: Insufficient graph definition for '
      || CASE WHEN doc_id % 2 = 0 THEN 'Requirement Diagram' ELSE 'Entity Relationship Diagram' END END), false, true
FROM worded WHERE len(rows) < 2""",
    ),
    "cache_hit": Query(
        cache_hit, f"WITH {_SQL_CACHE} SELECT * FROM requests WHERE content_hash IN (SELECT content_hash FROM cached)"
    ),
    "cache_miss": Query(
        cache_miss,
        f"WITH {_SQL_CACHE} SELECT * FROM requests WHERE content_hash NOT IN (SELECT content_hash FROM cached)",
    ),
    "content_dedup_ingest": Query(
        content_dedup_ingest,
        """WITH seen AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'es')
SELECT doc_id, sha256(text) AS content_hash, n_chars FROM documents
WHERE sha256(text) NOT IN (SELECT h FROM seen)
QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""",
    ),
    "recent_history": Query(
        recent_history,
        "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
    ),
}

