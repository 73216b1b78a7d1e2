"""Path rules, sizes, chunks and rules over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import chunks, corpus, rules
from corpusloom.operators.rules import Rule
from corpusloom.sources import files

from .base import SQL_MIXED_FILES, Query, md5_of, mixed_files, new_folder, sql_text, table

_ANCESTORS = """list_transform(range(1, len(string_split(rel_path, '/')) + 1),
      lambda n: array_to_string(list_slice(string_split(rel_path, '/'), 1, n), '/'))"""
_IGNORE = sql_text("|".join(f"(?:{p})" for p in paths.IGNORE_PATTERNS))
_NAMED = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in {**paths.LANGUAGES, **paths.WORKBOOK_LANGUAGES}.items())
_QUOTED = lambda items: ", ".join(f"'{i}'" for i in items)

SQL_TAGGED = SQL_MIXED_FILES + f""",
tagged AS (
  SELECT *, regexp_replace(rel_path, '^.*/', '') AS file_name,
    lower(regexp_extract(regexp_replace(rel_path, '^.*/', ''), '[^.](\\.[^.]*)$', 1)) AS ext,
    len(list_filter({_ANCESTORS}, lambda p: regexp_matches(p, {_IGNORE})
      OR starts_with(regexp_replace(p, '^.*/', ''), '.'))) > 0 AS ignored
  FROM mixed_files),
files AS (
  SELECT *, CASE ext {_NAMED} ELSE '' END AS language,
    ext IN ({_QUOTED(paths.ALLOWED_EXTENSIONS)}) AS allowed,
    ext IN ({_QUOTED(paths.WORKBOOK_LANGUAGES)}) AS is_workbook,
    ext IN ({_QUOTED([*paths.CODE_EXTENSIONS, *paths.WORKBOOK_LANGUAGES])}) AS is_code
  FROM tagged)"""


def file_tags(spark, sf_dir):
    return corpus.tag_files(mixed_files(spark, sf_dir)).drop("text", "lang", "source")


def file_language_stats(spark, sf_dir):
    kept = corpus.select_files(corpus.tag_files(mixed_files(spark, sf_dir)), workbooks=True)
    return corpus.quick_stats(kept, ["language"])


def archive_entries(spark, sf_dir):
    """A zip of every document, made by Spark, and its entries; every seventh one is broken."""

    def packed(batches):
        import io
        import zipfile

        for batch in batches:
            made = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as out:
                    out.writestr("app/_main.py", text)
                    out.writestr("app/sub/n.txt", str(doc_id))
                    out.writestr("other.py", "")
                made.append(b"no zip" if doc_id % 7 == 0 else buffer.getvalue())
            yield batch[["doc_id"]].assign(content=made)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    zips = docs.mapInPandas(packed, "doc_id long, content binary").select(
        F.concat(F.lit("d"), "doc_id", F.lit(".zip")).alias("rel_path"), "content"
    )
    entries = files.expand_archives(zips)
    return entries.select(
        "zip_path", "entry_path", "rel_path", F.md5("content").alias("md5"), F.col("error").isNotNull().alias("failed")
    )


def corpus_scan(spark, sf_dir):
    """Every document as a file in a folder of its source, and the corpus table of these folders.

    Those whose file is ignored have one that is not in a second folder; ``read`` also says that these came back.
    """
    root, rest = new_folder(spark), new_folder(spark)
    filesystem = files._filesystem  # the module as a whole cannot be sent to the workers

    def write(batches):
        for batch in batches:
            for source, doc_id, text in zip(batch["source"], batch["doc_id"], batch["text"]):
                name = ["_init.py", "a.js", "b.css", ".env"][doc_id % 4]
                for top, file in [(root, name), (rest, "c.py")][: 1 + (doc_id % 4 > 1)]:
                    system, path = filesystem(f"{top}/{source}/d{doc_id}")
                    system.create_dir(path, recursive=True)
                    with system.open_output_stream(f"{path}/{file}") as out:
                        out.write(text.encode())
            yield batch[["doc_id"]]

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs.mapInPandas(write, "doc_id long").count()
    found = files.scan_folder(spark, root, "p")
    other = files.scan_folder(spark, rest, "p").select("rel_path", md5_of("text"), F.lit(-1).alias("n"))
    written = docs.where("doc_id % 4 > 1").select(
        F.concat("source", F.lit("/d"), "doc_id", F.lit("/c.py")).alias("rel_path"), md5_of("text"), F.lit(1).alias("n")
    )
    wrong = written.unionByName(other).groupBy("rel_path", "md5").agg(F.sum("n").alias("n")).where("n <> 0").count()
    read = F.col("error").isNull() & F.lit(wrong == 0)
    return found.select("project_id", "rel_path", "language", md5_of("text"), read.alias("read"))


def size_router(spark, sf_dir):
    sized = corpus.add_size(table(spark, sf_dir, "documents"), small=200, large=2000)
    return sized.groupBy("size_class").agg(
        F.count(F.lit(1)).alias("files"), F.sum("token_count").alias("tokens")
    )


def run_status(spark, sf_dir):
    files = corpus.tag_files(mixed_files(spark, sf_dir))
    return corpus.status_counts(files.withColumn("error", F.when(~F.col("is_code"), "not code")))


def decode_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    plain = F.regexp_replace("text", "[^\\x00-\\xff]", "?")
    content = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(
        F.encode(plain, "ISO-8859-1")
    )
    read = docs.select("doc_id", content.alias("content"))
    return read.select(
        "doc_id",
        F.md5(corpus.decode_text("content")).alias("md5"),
        corpus.probe_utf8("content").alias("valid"),
    )


# --- chunks ---

TOKEN_WINDOW = 64
LINE_TOKENS = 200
SMALL = 300
FRAME = chunks.CHUNK_FRAME[0] + chunks.DEFAULT_SUMMARY + chunks.CHUNK_FRAME[1]

_CHUNK_COLUMNS = ["doc_id", "chunk_index", "total_chunks", "start_line", "end_line", "token_count"]


def _newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def _window_rows(body: str, first: str, tokens: int, source: str) -> str:
    """SQL rows of the token windows of ``body``; ``source`` gives body, first and key columns."""
    width = 4 * tokens
    return f"""
  SELECT * EXCLUDE (w, {body}), w AS content,
    {first} + {_newlines(f"substr({body}, 1, n * {width})")} AS start_line,
    {first} + {_newlines(f"substr({body}, 1, n * {width})")} + {_newlines('w')}
      - CASE WHEN ends_with(w, chr(10)) THEN 1 ELSE 0 END AS end_line
  FROM (SELECT *, substr({body}, n * {width} + 1, CASE WHEN length({body}) // 4 <= {tokens} THEN length({body}) ELSE {width} END) AS w
    FROM (SELECT *, unnest(range(0, CASE WHEN length({body}) // 4 <= {tokens} THEN 1
      ELSE (length({body}) + {width - 1}) // {width} END)) AS n FROM {source}))"""


SQL_LINE_BLOCKS = f"""
split_lines AS (
  SELECT doc_id, lang, text, length(text) // 4 AS tokens,
    CASE WHEN ends_with(text, chr(10)) OR text = ''
      THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1)
      ELSE string_split(text, chr(10)) END AS rows
  FROM documents),
stepped AS (
  SELECT *, CASE WHEN tokens > 0
      THEN greatest(1, floor({LINE_TOKENS * 4 // 5} / (tokens / len(rows))))::INT ELSE 2000 END AS step
  FROM split_lines),
blocks AS (
  SELECT doc_id, lang, text, s AS block_at,
    array_to_string(list_slice(rows, s + 1, s + step), chr(10)) AS body, s + 1 AS first_line
  FROM (SELECT *, unnest(range(0, len(rows), step)) AS s FROM stepped)
  UNION ALL SELECT doc_id, lang, text, 0, '', 1 FROM stepped WHERE len(rows) = 0),
block_windows AS ({_window_rows('body', 'first_line', LINE_TOKENS, 'blocks')}),
line_pieces AS (
  SELECT doc_id, lang, text, {sql_text(FRAME)} || content AS content, start_line, end_line,
    row_number() OVER (PARTITION BY doc_id ORDER BY block_at, n) - 1 AS chunk_index,
    count(*) OVER (PARTITION BY doc_id) AS total_chunks
  FROM block_windows)"""

SQL_STORE = SQL_LINE_BLOCKS + f""",
store AS (
  SELECT doc_id, lang, content, start_line, end_line, chunk_index, total_chunks FROM line_pieces
  WHERE length(text) // 4 > {SMALL}
  UNION ALL
  SELECT doc_id, lang, text, 1, {_newlines('text')} + 1, 0, 1 FROM documents WHERE length(text) // 4 <= {SMALL})"""


def token_chunks(spark, sf_dir):
    out = chunks.token_chunks(table(spark, sf_dir, "documents"), ["doc_id"], max_tokens=TOKEN_WINDOW)
    return out.select(*_CHUNK_COLUMNS, md5_of("content"))


def line_chunks(spark, sf_dir):
    out = chunks.line_chunks(table(spark, sf_dir, "documents"), ["doc_id"], max_tokens=LINE_TOKENS)
    return out.select(*_CHUNK_COLUMNS, md5_of("content"))


def chunk_stats(spark, sf_dir):
    out = chunks.store_chunks(
        table(spark, sf_dir, "documents"), ["doc_id", "lang"], small=SMALL, max_tokens=LINE_TOKENS
    )
    return chunks.chunk_stats(out, ["lang"])


# --- rules ---

TEXT_RULES = [
    Rule("contact", 0, r"[a-z]+\.\d+@mail\d+\.example\.com", "An e-mail address."),
    Rule("licence", 0, r"^released under .*$", "A licence line."),
    Rule("number", 0, r"\d{3,}", "A long number."),
    Rule("german", 0, r"ung[a-z]* .*", "A German noun and what follows it.", ("de",)),
]

# words of the texts -> code that the stock patterns look for
CODE_WORDS = [
    (" the ", " discount = if "),
    (" de ", " if income > 5 approve "),
    (" la ", "\ndef calculate_loan "),
    (" und ", "\nSub apply_discount "),
    (" die ", " FORMULA: A1 = IF(SUM(B1),1) "),
    (" que ", " custom_rule = "),
]
RULE_LANGUAGES = {"de": "VBA", "fr": "Excel", "en": "Python"}


def _sql_rules(rule_list, text, language, source):
    parts = []
    for at, r in enumerate(rule_list):
        where = ""
        if r.languages:
            where = f" WHERE lower({language}) IN ({_QUOTED(r.languages)})"
        parts.append(
            f"""SELECT doc_id, {at} AS rule_at, '{r.domain}' AS domain, {r.pattern_id} AS pattern_id,
    {sql_text(r.description)} AS description, 'regex' AS source,
    unnest(hits) AS rule, unnest(range(len(hits))) AS match_pos
  FROM (SELECT doc_id, regexp_extract_all({text}, {sql_text('(?im)' + r.pattern)}, 0) AS hits FROM {source}{where})"""
        )
    return "hits AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def rule_matches(spark, sf_dir):
    return rules.detect_rules(
        table(spark, sf_dir, "documents"), ["doc_id"], language="lang", rules=TEXT_RULES
    )


def rule_table_matches(spark, sf_dir):
    """Rules read from a table, here one made of the languages: words that begin like a language's tag."""
    tags = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows = tags.select(
        F.lit("tag").alias("domain"), F.ascii("lang").alias("pattern_id"),
        F.concat(F.lit("\\b"), "lang", F.lit("[a-z]*")).alias("pattern"), F.col("lang").alias("description"),
        F.array().cast("array<string>").alias("languages"),
    )
    found = rules.detect_rules(
        table(spark, sf_dir, "documents"), ["doc_id"], language=None, rules=rules.rules_from_table(rows)
    )
    return found.groupBy("doc_id", "pattern_id", "description").agg(
        F.count(F.lit(1)).alias("hits"), F.md5(F.min("rule")).alias("first")
    )


def semantic_rules(spark, sf_dir):
    """Rules of the patterns, and those in outputs that are given for texts with few matches."""
    docs = table(spark, sf_dir, "documents")
    rows = F.concat(
        F.lit('[{"domain": "d", "rule": "'), "lang", F.lit('", "description": "from '), "source",
        F.lit('"}, {"domain": "e", "rule": "r2"}]'),
    )
    output = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```json\n"), rows, F.lit("\n```")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Found: "), rows))
        .when(F.col("doc_id") % 4 == 2, '{"domain": "no list"}')
    )
    return rules.all_rules(docs.withColumn("output", output), ["doc_id"], language="lang", rules=TEXT_RULES)


def _coded(spark, sf_dir):
    text = F.col("text")
    for word, code in CODE_WORDS:
        text = F.replace(text, F.lit(word), F.lit(code))
    language = F.lit("")
    for lang, name in RULE_LANGUAGES.items():
        language = F.when(F.col("lang") == lang, name).otherwise(language)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.alias("text"), language.alias("language"))


_SQL_CODED_TEXT = "text"
for _word, _code in CODE_WORDS:
    _SQL_CODED_TEXT = f"replace({_SQL_CODED_TEXT}, {sql_text(_word)}, {sql_text(_code)})"
_SQL_CODED = f"""coded AS (
  SELECT doc_id, {_SQL_CODED_TEXT} AS text,
    CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RULE_LANGUAGES.items())} ELSE '' END AS language
  FROM documents)"""


def stock_rule_matches(spark, sf_dir):
    found = rules.detect_rules(_coded(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "domain", "pattern_id", "match_pos", F.md5("rule").alias("rule_md5"))


def rule_summary(spark, sf_dir):
    out = rules.rule_summary(_coded(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "matches", "needs_review", md5_of("summary"))


QUERIES = {
    "archive_entries": Query(
        archive_entries,
        """SELECT 'd' || doc_id || '.zip' AS zip_path, e.entry AS entry_path,
  CASE WHEN e.entry LIKE 'app/%' THEN substr(e.entry, 5) END AS rel_path,
  md5(CASE e.entry WHEN 'app/_main.py' THEN text WHEN 'app/sub/n.txt' THEN doc_id::VARCHAR WHEN 'other.py' THEN '' END) AS md5,
  e.entry IS NULL AS failed
FROM documents JOIN (VALUES ('app/_main.py'), ('app/sub/n.txt'), ('other.py'), (NULL)) e(entry)
  ON (e.entry IS NULL) = (doc_id % 7 = 0)""",
    ),
    "corpus_scan": Query(
        corpus_scan,
        """SELECT 'p' AS project_id, source || '/d' || doc_id || '/' || n AS rel_path, l AS language, md5(text) AS md5, true AS read
FROM documents JOIN (VALUES (0, '_init.py', 'Python'), (1, 'a.js', 'JavaScript')) k(m, n, l) ON doc_id % 4 = m""",
    ),
    "file_tags": Query(
        file_tags,
        f"""WITH {SQL_TAGGED}
SELECT doc_id, rel_path, file_name, ext, language, ignored, allowed, is_workbook, is_code FROM files""",
    ),
    "file_language_stats": Query(
        file_language_stats,
        f"""WITH {SQL_TAGGED}
SELECT language, count(*) AS total_files,
  count(DISTINCT regexp_replace(file_name, '^.*\\.', '')) AS languages,
  sum(length(text))::BIGINT AS total_lines
FROM files WHERE (NOT ignored AND allowed) OR is_workbook GROUP BY language""",
    ),
    "size_router": Query(
        size_router,
        """SELECT CASE WHEN length(text) // 4 < 200 THEN 'small' WHEN length(text) // 4 <= 2000
  THEN 'medium' ELSE 'large' END AS size_class, count(*) AS files, sum(length(text) // 4)::BIGINT AS tokens
FROM documents GROUP BY 1""",
    ),
    "run_status": Query(
        run_status,
        f"""WITH {SQL_TAGGED}
SELECT CASE WHEN is_code THEN 'ok' ELSE 'error' END AS status, count(*) AS files,
  round(count(*) * 100 / (SELECT count(*) FROM files), 1) AS percent
FROM files GROUP BY 1""",
    ),
    "decode_fallback": Query(
        decode_fallback,
        """SELECT doc_id,
  md5(CASE WHEN lang = 'en' THEN text ELSE regexp_replace(text, '[^\\x00-\\x{ff}]', '?', 'g') END) AS md5,
  lang = 'en' OR NOT regexp_matches(substr(text, 1, 4096), '[^\\x00-\\x7f]') AS valid
FROM documents""",
    ),
    "token_chunks": Query(
        token_chunks,
        f"""WITH source AS (SELECT doc_id, text AS body, 1 AS first_line FROM documents),
pieces AS ({_window_rows('body', 'first_line', TOKEN_WINDOW, 'source')})
SELECT doc_id, n AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks,
  start_line, end_line, length(content) // 4 AS token_count, md5(content) AS md5
FROM pieces""",
    ),
    "line_chunks": Query(
        line_chunks,
        f"""WITH {SQL_LINE_BLOCKS}
SELECT doc_id, chunk_index, total_chunks, start_line, end_line, length(content) // 4 AS token_count,
  md5(content) AS md5
FROM line_pieces""",
    ),
    "chunk_stats": Query(
        chunk_stats,
        f"""WITH {SQL_STORE}
SELECT lang, count(*) AS chunks, count(*) FILTER (chunk_index = 0) AS files,
  count(*) FILTER (chunk_index > 0) AS extra_chunks, sum(length(content) // 4)::BIGINT AS tokens,
  max(length(content) // 4) AS max_tokens, max(end_line) AS max_end_line
FROM store GROUP BY lang""",
    ),
    "rule_matches": Query(
        rule_matches,
        f"""WITH {_sql_rules(TEXT_RULES, 'text', 'lang', 'documents')}
SELECT doc_id, domain, pattern_id, match_pos, rule, description, source FROM hits""",
    ),
    "rule_table_matches": Query(
        rule_table_matches,
        """WITH found AS (
  SELECT d.doc_id, ascii(t.lang)::INT AS pattern_id, t.lang AS description,
    unnest(list_concat(
      CASE t.lang WHEN 'de' THEN regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}\\p{M}_])(de[a-z]*)', 1) END,
      CASE t.lang WHEN 'en' THEN regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}\\p{M}_])(en[a-z]*)', 1) END,
      CASE t.lang WHEN 'es' THEN regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}\\p{M}_])(es[a-z]*)', 1) END,
      CASE t.lang WHEN 'fr' THEN regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}\\p{M}_])(fr[a-z]*)', 1) END)) AS rule
  FROM documents d, (SELECT DISTINCT lang FROM documents) t)
SELECT doc_id, pattern_id, description, count(*) AS hits, md5(min(rule)) AS first
FROM found GROUP BY doc_id, pattern_id, description""",
    ),
    "semantic_rules": Query(
        semantic_rules,
        f"""WITH {_sql_rules(TEXT_RULES, 'text', 'lang', 'documents')},
few AS (
  SELECT d.* FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) h USING (doc_id)
  WHERE coalesce(n, 0) < 3 AND doc_id % 4 < 2)
SELECT doc_id, domain, pattern_id, match_pos, rule, description, source FROM hits
UNION ALL SELECT doc_id, 'd', NULL, 0, lang, 'from ' || source, 'semantic' FROM few
UNION ALL SELECT doc_id, 'e', NULL, 1, 'r2', NULL, 'semantic' FROM few""",
    ),
    "stock_rule_matches": Query(
        stock_rule_matches,
        f"""WITH {_SQL_CODED}, {_sql_rules(rules.STOCK_RULES, 'text', 'language', 'coded')}
SELECT doc_id, domain, pattern_id, match_pos, md5(rule) AS rule_md5 FROM hits""",
    ),
    "rule_summary": Query(
        rule_summary,
        f"""WITH {_SQL_CODED}, {_sql_rules(rules.STOCK_RULES, 'text', 'language', 'coded')},
lines AS (
  SELECT doc_id, count(*) AS matches,
    string_agg('Detected ' || domain || ' rule (' || source || '): ' || description, chr(10)
      ORDER BY rule_at, match_pos) AS summary
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(matches, 0) AS matches, coalesce(matches, 0) < 3 AS needs_review,
  md5(coalesce(summary, '')) AS md5
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id""",
    ),
}
