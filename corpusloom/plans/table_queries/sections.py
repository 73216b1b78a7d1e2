"""Parsing, checking, filling and merging sectioned texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import sections as S
from corpusloom.functions.tokens import token_count
from corpusloom.operators import merging, reports

from .base import Query, md5_of, sql_strip, sql_text, table
from .texts import SQL_SENTENCES

_LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda l: " + sql_strip("l") + "), lambda l: l <> '')"


def _sectioned(spark, sf_dir):
    """Documents wrapped in sections; Spanish ones repeat a header."""
    docs = table(spark, sf_dir, "documents")
    numbered = F.concat(F.lit("1. "), F.replace("text", F.lit("\n"), F.lit("\n2. ")))
    plain = F.when(F.col("lang") == "fr", F.col("text")).otherwise(numbered)
    text = F.concat(
        F.lit("Some intro\n\nOverview\n"), "text", F.lit("\n\nmore on "), "source",
        F.lit("\n\nObjective: none\n"), "lang",
        F.lit("\n\nKey Functionalities\n"), plain, F.lit("\n\n7. last "), "source",
        F.lit("\n\nDependent Files\n"), "source", F.lit("\n"), "lang",
        F.when(F.col("lang") == "es", F.lit("\n\nOverview\nagain")).otherwise(""),
    )
    return docs.select("doc_id", "lang", "source", text.alias("t"))


def section_parse(spark, sf_dir):
    p = _sectioned(spark, sf_dir).select("doc_id", S.parse_sections("t").alias("p"))
    return p.select(
        "doc_id",
        F.md5("p.overview").alias("overview"),
        "p.objective",
        "p.use_case",
        F.size("p.key_functionalities").alias("items"),
        F.md5(F.array_join("p.key_functionalities", "|")).alias("key_functionalities"),
        F.array_join("p.dependent_files", "|").alias("dependent_files"),
    )


def _drafts():
    """Sectioned drafts of documents, good for some languages and lacking for others."""
    body = F.concat(
        F.lit("## Overview\n"), "text", F.lit("\n\n#objective\nTo hold "), "source", F.lit(" together.")
    )
    full = F.concat(
        body, F.lit("\nuse case\nAll of "), "source",
        F.lit(" at work.\n### Key functionalities\n1. a: b and c\nWorkflow Summary\nshort\nDependent Files\nfile "), "source",
    )
    return (
        F.when(F.col("lang") == "en", full)
        .when(F.col("lang") == "fr", body)
        .when(F.col("lang") == "de", F.concat(F.lit("Overview\nError: LLM failed on it\nUse Case\n"), "text"))
        .otherwise(F.col("text"))
    )


def section_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", _drafts().alias("t"))
    filled = S.fill_sections("t", F.col("source"), F.col("lang"), F.concat(F.lit("rules of "), "source"))
    out = docs.select("doc_id", F.md5(filled).alias("md5"), S.sections_loose("t", S.HEADERS).alias("s"))
    return out.select("doc_id", "md5", F.array_join(S.missing_sections(F.col("s")), ",").alias("missing"))


def chunk_format(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = F.concat(
        F.lit("Overview\n"), "text", F.lit("\n \n\nKey Functionalities\n1. this segment does\nnote\n2. "), "source",
        F.lit("\n\nWorkflow Summary\n"),
    )
    return docs.select("doc_id", F.md5(S.format_chunk(t, F.col("lang"))).alias("md5"))


def quality_flag(spark, sf_dir):
    """Drafts judged and, when generic, replaced by a second output."""
    docs = table(spark, sf_dir, "documents")
    first = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Key Functionalities\n1. "), "text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("Key Functionalities\n1. this FILE does "), "text"))
        .otherwise(F.col("text"))
    )
    drafts = docs.select("doc_id", first.alias("output"), F.concat(F.lit("second "), "source").alias("retry_output"))
    out = reports.chosen_outputs(drafts.withColumn("generic", S.is_generic("output")))
    return out.select("doc_id", "generic", md5_of("requirements"))


def complete_output(spark, sf_dir):
    """Three attempts at six sections, each lacking one of them for some documents; the first whole one counts."""
    docs = table(spark, sf_dir, "documents")
    line = F.translate("text", "\t\n\x0b\x0c\r", "     ")

    def attempt(k: int, without: str, every: int, instead: str):
        parts = []
        for h in S.HEADERS:
            body = F.concat(F.lit(f"attempt {k} at "), "doc_id", F.lit(" "), line) if h == "Overview" else F.lit(f"what {h} says")
            part = F.concat(F.lit(f"{h}\n"), body)
            lacking = F.lit(f"{h}\n{instead}") if instead else F.lit(None)
            parts.append(F.when(F.col("doc_id") % every == 0, lacking).otherwise(part) if h == without else part)
        return F.concat_ws("\n\n", *parts)

    tried = [attempt(1, "Objective", 2, ""), attempt(2, "Use Case", 3, "short"), attempt(3, "Dependent Files", 5, "")]
    out = docs.select("doc_id", S.first_complete(tried).alias("_c"))
    return out.select(
        "doc_id", "_c.attempt", F.array_join("_c.missing", "|").alias("missing"), F.md5("_c.sections.overview").alias("overview")
    )


SUMMARY = [f"## {h}\n" for h in S.SUMMARY_HEADINGS]


def summary_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(
        F.lit("\n" + "in short\n".join(SUMMARY[:6])),
        F.when(F.col("lang") == "en", F.lit("done\n" + SUMMARY[6])).otherwise(F.lit("done\n ## OTHER-PART\n")),
        F.col("text"),
    )
    marked = docs.select("doc_id", text.alias("t"))
    return marked.select(
        "doc_id",
        F.array_join(S.summary_missing("t"), ",").alias("missing"),
        S.summary_complete("t").alias("complete"),
        F.explode(S.summary_sections("t")).alias("s"),
    ).select("doc_id", "missing", "complete", "s.title", "s.key", F.md5("s.content").alias("content"))


def dependent_files(spark, sf_dir):
    """Dependent Files paragraphs written from the lines of documents."""
    docs = table(spark, sf_dir, "documents")
    rows = F.split("text", "\n")
    listed = F.transform(
        rows,
        lambda l, i: F.when(i % 3 == 0, F.concat(F.lit("1. f"), i.cast("string"), F.lit(": about "), l))
        .when(i % 3 == 1, F.concat(F.lit(" - g"), i.cast("string"), F.lit(" : "), l))
        .otherwise(F.concat(F.lit("h"), i.cast("string"))),
    )
    text = F.concat(
        F.lit("Overview\nx\n\nDependent Files\n"),
        F.when(F.col("lang") == "es", F.lit("No dependencies detected.")).otherwise(F.array_join(listed, "\n")),
    )
    return docs.select("doc_id", F.explode(S.parse_dependent_files(text)).alias("d")).select(
        "doc_id", "d.file_name", F.md5("d.overview").alias("overview")
    )


# --- merging the chunks of a file; a conversation is a file, its turns are chunks ---


def _turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    items = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda l, i: F.concat((i + 1).cast("string"), F.lit(". item: "), l),
        ),
        "\n\n",
    )
    return turns.withColumn("key_text", items)


def greedy_budget(spark, sf_dir, **rounds):
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(
        "conv_id", "turn", F.posexplode(S.sentences("text")).alias("pos", "sentence")
    ).where(F.trim("sentence") != "")
    rows = rows.withColumn("tokens", token_count("sentence")).withColumn("budget", F.lit(60))
    kept = merging.budget_sentences(rows, ["conv_id"], ["turn", "pos"], **rounds)
    return kept.select(
        "conv_id", "used", F.size("kept").alias("sentences"), F.md5(F.array_join("kept", " ")).alias("md5")
    )


def greedy_rounds(spark, sf_dir):
    """The same in many small rounds."""
    return greedy_budget(spark, sf_dir, round_sentences=3)


def greedy_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(merging.greedy_text("text", 100)).alias("md5"))


def functionality_merge(spark, sf_dir):
    return merging.merge_functionalities(_turns(spark, sf_dir), ["conv_id"], index="turn")


def combine_sections(spark, sf_dir):
    """Assistant turns are complete chunk outputs, user turns lack a section."""
    text = F.concat(
        F.lit("Overview\n"), "text", F.lit("\n\nObjective\nTo be "), "role",
        F.lit("\n\nUse Case\n"), F.element_at(F.split("text", "\n"), 1),
        F.lit("\n\nKey Functionalities\n"), "key_text",
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.concat(F.lit("\n\nWorkflow Summary\n"), "text")),
    )
    turns = _turns(spark, sf_dir).select("conv_id", "turn", text.alias("text"), F.lit("Python").alias("language"))
    out = merging.combine_sections(turns, ["conv_id"], index="turn")
    return out.select("conv_id", md5_of("requirements"))


def project_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(
        F.lit("Overview\n"), "text", F.lit("\n\nObjective\nhold "), "lang", F.lit("\n\nWorkflow Summary\n"),
        F.when(F.col("lang") == "de", F.lit("Error here")).otherwise(F.concat(F.lit("flow "), "source")),
    )
    results = docs.select(
        F.col("source").alias("project_id"), F.format_string("%08d", "doc_id").alias("rel_path"),
        F.concat(F.lit("f"), "doc_id").alias("file_name"), text.alias("requirements"),
    )
    out = merging.project_context(results, max_tokens=5000)
    return out.select("project_id", "tokens", F.md5("context").alias("md5"))


def project_context_empty(spark, sf_dir):
    """Projects by language; German ones have no text, French ones no section. Each text is one long line."""
    docs = table(spark, sf_dir, "documents")
    line = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    text = F.when(F.col("lang") == "fr", F.concat(F.lit("no section "), "doc_id", F.lit(" "), line)).when(
        F.col("lang") != "de", F.concat(F.lit("Overview\nno "), "doc_id", F.lit(" "), line)
    )
    results = docs.select(
        F.col("lang").alias("project_id"), F.format_string("%08d", "doc_id").alias("rel_path"),
        F.concat(F.lit("f"), "doc_id").alias("file_name"), text.alias("requirements"),
    )
    return merging.project_context(results, max_tokens=10**6).select("project_id", "tokens", F.md5("context").alias("md5"))


_FOLD = """list_reduce(list_prepend({{'used': 0, 'kept': '', 'n': 0, 't': 0, 's': ''}},
    list_transform({items}, lambda x: {{'used': 0, 'kept': '', 'n': 0, 't': length(x)::INT // 4, 's': x}})),
  lambda a, b: CASE WHEN a.used < {budget} AND a.used + b.t <= {budget}
    THEN {{'used': a.used + b.t, 'kept': CASE WHEN a.n = 0 THEN b.s ELSE a.kept || ' ' || b.s END, 'n': a.n + 1, 't': 0, 's': ''}}
    ELSE a END)"""


def _fold(items: str, budget: int) -> str:
    return _FOLD.format(items=items, budget=budget)


def _nonblank(items: str) -> str:
    return f"list_filter(list_transform({items}, lambda x: {sql_strip('x')}), lambda x: x <> '')"


_WORDS = "regexp_split_to_array({0}, '\\s+')".format(sql_strip("t"))
_KEY_LINES = "list_transform(string_split(text, chr(10)), lambda l, i: {'text': " + sql_strip("l") + ", 'i': i})"
_EXPLAIN = (
    "'No explicit business logic was detected in the ' || source || ' ' || lang || ' file for the ''{0}'' section. "
    "This may be because the file primarily contains UI components, configuration, or utility code, or lacks "
    "business rules, workflows, or domain logic. If this is a React component or similar, the file may focus on "
    "rendering or wiring rather than business processes.'"
)


def _sql_functions(where: str) -> str:
    return f"""
items AS (
  SELECT conv_id, l.text AS item, min(turn * 100000 + l.i) AS first
  FROM (SELECT conv_id, turn, unnest({_KEY_LINES}) AS l FROM conversations {where}) GROUP BY 1, 2),
functions AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS number, item
  FROM items QUALIFY number <= 10)"""


def _sql_section(expression: str, budget: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT conv_id, {_fold('flatten(list(parts ORDER BY first))', budget)} AS f FROM (
    SELECT conv_id, item, min(turn) AS first, {_nonblank(SQL_SENTENCES.format('item'))} AS parts
    FROM (SELECT conv_id, turn, {sql_strip(expression)} AS item FROM conversations WHERE role <> 'user')
    WHERE item <> '' GROUP BY conv_id, item) GROUP BY conv_id)"""


def _sql_body(alias: str, budget: int, default: str) -> str:
    kept = f"coalesce({alias}.f.kept, '')"
    return f"CASE WHEN {kept} = '' OR length({kept}) // 4 > {budget} THEN '{default}' ELSE {kept} END"


_SQL_GREEDY = f"""WITH parts AS (
  SELECT conv_id, flatten(list(p ORDER BY turn)) AS items
  FROM (SELECT conv_id, turn, list_filter({SQL_SENTENCES.format('text')}, lambda x: trim(x) <> '') AS p FROM conversations)
  GROUP BY conv_id),
folded AS (SELECT conv_id, {_fold('items', 60)} AS f FROM parts)
SELECT conv_id, f.used AS used, f.n AS sentences, md5(f.kept) AS md5 FROM folded"""

QUERIES = {
    "section_parse": Query(
        section_parse,
        f"""WITH parsed AS (
  SELECT *, {_LINES.format('text')} AS plain,
    list_filter(list_transform(string_split('1. ' || replace(text, chr(10), chr(10) || '2. '), chr(10)),
      lambda l: {sql_strip('l')}), lambda l: regexp_matches(l, '^\\d+\\. ')) AS numbered
  FROM documents),
items AS (
  SELECT *, list_append(list_transform(CASE WHEN lang = 'fr' THEN plain ELSE numbered END,
    lambda x: {sql_strip("regexp_replace(x, '^\\d+\\. ', '')")}), 'last ' || source) AS keys
  FROM parsed)
SELECT doc_id,
  md5(CASE WHEN lang = 'es' THEN 'again' ELSE concat_ws(' ', nullif(array_to_string(plain, ' '), ''), 'more on ' || source) END) AS overview,
  lang AS objective, '' AS use_case, len(keys) AS items,
  md5(array_to_string(keys, '|')) AS key_functionalities, source || '|' || lang AS dependent_files
FROM items""",
    ),
    "section_fill": Query(
        section_fill,
        f"""WITH bodies AS (
  SELECT *, CASE WHEN lang IN ('en', 'fr') AND length({sql_strip('text')}) >= 10 THEN {sql_strip('text')} END AS overview,
    CASE WHEN lang IN ('en', 'fr') THEN 'To hold ' || source || ' together.' END AS objective,
    CASE WHEN lang = 'en' THEN 'All of ' || source || ' at work.'
      WHEN lang = 'de' AND length({sql_strip('text')}) >= 10 THEN {sql_strip('text')} END AS use_case,
    CASE WHEN lang = 'en' THEN '1. a: b and c' END AS key_text,
    CASE WHEN lang = 'en' AND length('file ' || source) >= 10 THEN 'file ' || source END AS files
  FROM documents)
SELECT doc_id, md5('Overview' || chr(10) || coalesce(overview, 'rules of ' || source) || chr(10) || chr(10)
  || 'Objective' || chr(10) || coalesce(objective, {_EXPLAIN.format('Objective')}) || chr(10) || chr(10)
  || 'Use Case' || chr(10) || coalesce(use_case, {_EXPLAIN.format('Use Case')}) || chr(10) || chr(10)
  || 'Key Functionalities' || chr(10) || coalesce(key_text, {_EXPLAIN.format('Key Functionalities')}) || chr(10) || chr(10)
  || 'Workflow Summary' || chr(10) || {_EXPLAIN.format('Workflow Summary')} || chr(10) || chr(10)
  || 'Dependent Files' || chr(10) || coalesce(files, 'No dependencies detected.') || chr(10)) AS md5,
  concat_ws(',', CASE WHEN overview IS NULL AND lang <> 'de' THEN 'overview' END,
    CASE WHEN objective IS NULL THEN 'objective' END, CASE WHEN use_case IS NULL THEN 'use case' END,
    CASE WHEN key_text IS NULL THEN 'key functionalities' END, 'workflow summary',
    CASE WHEN files IS NULL THEN 'dependent files' END) AS missing
FROM bodies""",
    ),
    "chunk_format": Query(
        chunk_format,
        f"""SELECT doc_id, md5(concat_ws(chr(10) || chr(10),
  'Overview' || chr(10) || CASE WHEN {sql_strip('text')} = '' THEN 'Supports ' || lower(lang) || ' file operations.' ELSE {sql_strip('text')} END,
  'Objective' || chr(10) || 'To enable core ' || lower(lang) || ' file functionality.',
  'Use Case' || chr(10) || 'Supports general business tasks in ' || lower(lang) || ' applications.',
  'Key Functionalities' || chr(10) || '1. the code does' || chr(10) || chr(10) || '2. ' || source,
  'Workflow Summary' || chr(10) || 'Contributes to the ' || lower(lang) || ' file''s workflow.')) AS md5
FROM documents""",
    ),
    "quality_flag": Query(
        quality_flag,
        """WITH drafts AS (
  SELECT *, CASE lang WHEN 'en' THEN 'Key Functionalities' || chr(10) || '1. ' || text
    WHEN 'fr' THEN 'Key Functionalities' || chr(10) || '1. this FILE does ' || text ELSE text END AS output
  FROM documents),
judged AS (
  SELECT *, lang <> 'en' OR length(trim(output, ' ' || chr(10))) < 50
    OR regexp_matches(output, '(?i)no business logic detected|utility file|this file (does|is|contains)|no explicit business logic') AS generic
  FROM drafts)
SELECT doc_id, generic, md5(CASE WHEN generic THEN 'second ' || source ELSE output END) AS md5 FROM judged""",
    ),
    "complete_output": Query(
        complete_output,
        f"""WITH tried AS (
  SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 1 WHEN doc_id % 3 <> 0 THEN 2 WHEN doc_id % 5 <> 0 THEN 3 END AS attempt,
    translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS line FROM documents)
SELECT doc_id, attempt, CASE WHEN attempt IS NULL THEN 'dependent files' ELSE '' END AS missing,
  md5({sql_strip("'attempt ' || attempt || ' at ' || doc_id || ' ' || line")}) AS overview
FROM tried""",
    ),
    "summary_parse": Query(
        summary_parse,
        f"""WITH marked AS (
  SELECT *, {sql_text(chr(10) + "in short\n".join(SUMMARY[:6]))} || CASE WHEN lang = 'en'
    THEN {sql_text("done\n" + SUMMARY[6])} ELSE {sql_text("done\n ## OTHER-PART\n")} END || text AS t
  FROM documents),
judged AS (
  SELECT doc_id, lang, text, CASE WHEN lang = 'en' THEN '' ELSE 'TECHNICAL FOUNDATION' END AS missing,
    lang = 'en' AND len({_WORDS}) >= 150 AS complete
  FROM marked)
SELECT doc_id, missing, complete, title, regexp_replace(lower(title), '[^a-z0-9]', '_', 'g') AS key,
  md5(CASE i WHEN 6 THEN 'done' WHEN 7 THEN array_to_string({_LINES.format('text')}, ' ') ELSE 'in short' END) AS content
FROM (SELECT *, unnest(list_append([{", ".join(sql_text(h) for h in S.SUMMARY_HEADINGS[:6])}],
    CASE WHEN lang = 'en' THEN 'TECHNICAL FOUNDATION' ELSE 'OTHER-PART' END)) AS title, unnest(range(1, 8)) AS i FROM judged)""",
    ),
    "dependent_files": Query(
        dependent_files,
        f"""SELECT doc_id,
  CASE i % 3 WHEN 0 THEN 'f' || i WHEN 1 THEN CASE WHEN {sql_strip('line')} = '' THEN '- g' || i ELSE '- g' || i END ELSE 'h' || i END AS file_name,
  md5(CASE i % 3 WHEN 0 THEN {sql_strip("'about ' || line")} WHEN 1 THEN {sql_strip('line')} ELSE '' END) AS overview
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE lang <> 'es')""",
    ),
    "greedy_budget": Query(greedy_budget, _SQL_GREEDY),
    "greedy_rounds": Query(greedy_rounds, _SQL_GREEDY),
    "greedy_text": Query(
        greedy_text,
        f"""SELECT doc_id, md5(({_fold(_nonblank(SQL_SENTENCES.format('text')), 100)}).kept) AS md5 FROM documents""",
    ),
    "functionality_merge": Query(
        functionality_merge, f"WITH {_sql_functions('')} SELECT conv_id, number, item FROM functions"
    ),
    "combine_sections": Query(
        combine_sections,
        f"""WITH {_sql_functions("WHERE role <> 'user'")},
{_sql_section('text', 1000, 'overviews')},
{_sql_section("'To be ' || role", 500, 'objectives')},
{_sql_section("string_split(text, chr(10))[1]", 500, 'cases')},
{_sql_section('text', 500, 'flows')},
listed AS (SELECT conv_id, string_agg(number || '. ' || item, chr(10) || chr(10) ORDER BY number) AS t FROM functions GROUP BY conv_id),
files AS (SELECT DISTINCT conv_id FROM conversations)
SELECT s.conv_id, md5(concat_ws(chr(10) || chr(10),
  'Overview' || chr(10) || {_sql_body('o', 1000, 'Supports python file operations.')},
  'Objective' || chr(10) || {_sql_body('b', 500, 'To enable core python business functionality.')},
  'Use Case' || chr(10) || {_sql_body('c', 500, 'Supports python business scenarios.')},
  'Key Functionalities' || chr(10) || l.t,
  'Workflow Summary' || chr(10) || {_sql_body('w', 500, 'Integrates with python file workflows.')})) AS md5
FROM files s LEFT JOIN overviews o USING (conv_id) LEFT JOIN objectives b USING (conv_id)
LEFT JOIN cases c USING (conv_id) LEFT JOIN flows w USING (conv_id) LEFT JOIN listed l USING (conv_id)""",
    ),
    "project_context_empty": Query(
        project_context_empty,
        f"""WITH texts AS (
  SELECT lang, CASE lang WHEN 'de' THEN {sql_text(merging.NO_CONTENT)} WHEN 'fr' THEN {sql_text(merging.CONTEXT_TITLE)}
    ELSE {sql_text(merging.CONTEXT_TITLE)} || string_agg(chr(10) || 'f' || doc_id || ':' || chr(10) || '  Overview: '
      || {sql_strip("'no ' || doc_id || ' ' || line")} || chr(10), '' ORDER BY doc_id) END AS t
  FROM (SELECT *, translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS line FROM documents)
  GROUP BY lang)
SELECT lang AS project_id, length(t) // 4 AS tokens, md5(t) AS md5 FROM texts""",
    ),
    "project_context": Query(
        project_context,
        f"""WITH parts AS (
  SELECT source, doc_id, CASE WHEN lang <> 'de' THEN 'f' || doc_id || ': flow ' || source || chr(10) END AS flow,
    chr(10) || 'f' || doc_id || ':' || chr(10)
      || CASE WHEN {sql_strip('text')} <> '' THEN '  Overview: ' || {sql_strip('text')} || chr(10) ELSE '' END
      || '  Objective: hold ' || lang || chr(10) AS block
  FROM documents),
texts AS (
  SELECT source, coalesce('WORKFLOW SUMMARIES:' || chr(10) || string_agg(flow, '' ORDER BY doc_id) || chr(10), '')
    || 'ADDITIONAL FILE CONTEXT:' || chr(10) || string_agg(block, '' ORDER BY doc_id) AS t
  FROM parts GROUP BY source)
SELECT source AS project_id, length(t) // 4 AS tokens,
  md5(CASE WHEN length(t) // 4 > 5000 THEN substr(t, 1, 3750) ELSE t END) AS md5
FROM texts""",
    ),
}
