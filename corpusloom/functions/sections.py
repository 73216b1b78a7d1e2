"""Splitting, reading, checking and filling sectioned texts.

Everything works inside one row: a text is split before its headers, so each
piece carries its own continuation paragraphs and no window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import WHITESPACE, col, is_blank, let, nonblank_lines, strip

# Section headers in their order.
HEADERS = [
    "Overview", "Objective", "Use Case", "Key Functionalities", "Workflow Summary",
    "Dependent Files",
]
CHUNK_HEADERS = HEADERS[:5]

# Headings a project summary must have, and its least number of words.
SUMMARY_HEADINGS = [
    "PROJECT OVERVIEW", "BUSINESS CONTEXT & OBJECTIVES", "SYSTEM ARCHITECTURE & APPROACH",
    "KEY CAPABILITIES & FEATURES", "WORKFLOW & PROCESS INTEGRATION",
    "BUSINESS VALUE & IMPACT", "TECHNICAL FOUNDATION",
]
SUMMARY_MIN_WORDS = 150

# Phrases that mark an output as not meaningful.
GENERIC_PATTERNS = [
    r"No business logic detected",
    r"utility file",
    r"This file (does|is|contains)",
    r"No explicit business logic",
    r"Error: LLM failed",
    r"Overview\s*\n\s*Objective\s*\n\s*Use Case",
]
GENERIC_MIN_LENGTH = 50
SECTION_MIN_LENGTH = 10

# Texts that stand in for a missing chunk section.
def chunk_defaults(language: Column) -> dict[str, Column]:
    lang = F.lower(language)
    return {
        "Overview": F.concat(F.lit("Supports "), lang, F.lit(" file operations.")),
        "Objective": F.concat(F.lit("To enable core "), lang, F.lit(" file functionality.")),
        "Use Case": F.concat(
            F.lit("Supports general business tasks in "), lang, F.lit(" applications.")
        ),
        "Key Functionalities": F.lit(
            "1. Basic Processing: Handles core tasks.\n\n2. Support Functions: Assists operations."
        ),
        "Workflow Summary": F.concat(
            F.lit("Contributes to the "), lang, F.lit(" file's workflow.")
        ),
    }


# Texts that stand in for a combined section without content.
def combined_defaults(language: Column) -> dict[str, Column]:
    lang = F.lower(language)
    return {
        "Overview": F.concat(F.lit("Supports "), lang, F.lit(" file operations.")),
        "Objective": F.concat(F.lit("To enable core "), lang, F.lit(" business functionality.")),
        "Use Case": F.concat(F.lit("Supports "), lang, F.lit(" business scenarios.")),
        "Workflow Summary": F.concat(F.lit("Integrates with "), lang, F.lit(" file workflows.")),
    }


def slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def tidy(text: Column | str, wording: str = "the code") -> Column:
    """One blank line between paragraphs and no talk of chunks or segments."""
    single = F.regexp_replace(col(text), r"\n(?U)\s*\n+", "\n\n")
    return F.regexp_replace(single, "(?i)this chunk|this segment", wording)


def split_strict(text: Column | str, headers: list[str] = CHUNK_HEADERS) -> Column:
    """Split where a blank line is followed by a header."""
    return F.split(col(text), r"\n\n(?=%s)" % "|".join(headers))


def split_loose(text: Column | str, headers: list[str] = CHUNK_HEADERS) -> Column:
    """Split before headers at line starts: any case, ``#`` marks allowed."""
    return F.split(col(text), r"(?iU)\n+\s*#*\s*(?=%s)" % "|".join(headers))


def normalize_header(header: Column | str) -> Column:
    h = strip(F.lower(col(header)))
    h = strip(F.ltrim(h, F.lit("#")))
    # Spelling variants and what they are read as.
    for variant, name in [
        ("functionality", "functionalities"),
        ("key functionality", "key functionalities"),
        ("dependent file", "dependent files"),
        ("use-case", "use case"),
    ]:
        h = F.replace(h, F.lit(variant), F.lit(name))
    return h


def _last(pieces: Column, test) -> Column:
    """The last piece that passes ``test``; null when none does."""
    return F.try_element_at(F.filter(pieces, test), F.lit(-1))


def _struct(headers: list[str], section) -> Column:
    return F.struct(*[section(h).alias(slug(h)) for h in headers])


def sections_strict(text: Column | str, headers: list[str] = CHUNK_HEADERS) -> Column:
    """Struct of section bodies, one field per header; null where there is none."""

    def build(pieces: Column) -> Column:
        def section(header: str) -> Column:
            piece = _last(pieces, lambda p: p.startswith(header))
            return strip(F.substring(piece, len(header) + 1, 1 << 30))

        return _struct(headers, section)

    return let(split_strict(text, headers), build)


def sections_loose(text: Column | str, headers: list[str] = CHUNK_HEADERS) -> Column:
    """The same for loose headers. Marks and spelling variants are cut off with the header."""
    # a header is decided by the start of its piece, long enough for any header and its variants
    most = 32 + max(map(len, headers), default=0)
    start = lambda p: F.regexp_extract(p, rf"(?sU)^\s*#*\s*(.{{0,{most}}})", 1)
    headed = F.transform(
        split_loose(text, headers),
        lambda p: F.struct(normalize_header(start(p)).alias("head"), p.alias("piece")),
    )

    def build(pieces: Column) -> Column:
        def section(header: str) -> Column:
            words = header.lower().replace(" ", "[ -]").replace("files", "files?")
            words = words.replace("functionalities", "functionalit(?:ies|y)")
            piece = _last(pieces, lambda p: p["head"].startswith(header.lower()))["piece"]
            return strip(F.regexp_replace(piece, rf"(?iU)^\s*#*\s*{words}", ""))

        return _struct(headers, section)

    return let(headed, build)


def header_blocks(text: Column | str) -> Column:
    """Blocks of a text, each starting at a header paragraph and running to the next one."""
    names = "|".join(HEADERS)
    blocks = F.split(strip(text), rf"\n\n(?=(?U:\s)*(?:{names}))")
    return F.filter(F.transform(blocks, strip), lambda b: b.rlike(f"^(?:{names})"))


def parse_sections(text: Column | str) -> Column:
    """Struct of six sections; a repeated header replaces the earlier one."""
    none = F.array().cast("array<string>")
    tail = lambda rows: F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    number_cut = lambda x: strip(F.regexp_replace(x, r"(?U)^\d+\. ", ""))

    def build(blocks: Column) -> Column:
        def block(name: str) -> Column:
            return _last(blocks, lambda b: b.startswith(name))

        def rows_of(name: str) -> Column:
            """Everything below the header, whatever the paragraph."""
            return F.coalesce(let(nonblank_lines(block(name)), tail), none)

        def keyed(paragraphs: Column) -> Column:
            first = let(nonblank_lines(F.get(paragraphs, F.lit(0))), tail)
            rest = F.flatten(F.transform(tail(paragraphs), nonblank_lines))
            chosen = let(
                first,
                lambda rows: let(
                    F.filter(rows, lambda x: x.rlike(r"(?U)^\d+\. ")),
                    lambda numbered: F.when(F.size(numbered) > 0, numbered).otherwise(rows),
                ),
            )
            return F.transform(F.concat(chosen, rest), number_cut)

        key_items = let(F.split(block("Key Functionalities"), "\n\n"), keyed)
        return F.struct(
            F.array_join(rows_of("Overview"), " ").alias("overview"),
            F.array_join(rows_of("Objective"), " ").alias("objective"),
            F.array_join(rows_of("Use Case"), " ").alias("use_case"),
            F.coalesce(key_items, none).alias("key_functionalities"),
            F.array_join(rows_of("Workflow Summary"), " ").alias("workflow_summary"),
            rows_of("Dependent Files").alias("dependent_files"),
        )

    return let(header_blocks(text), build)


def is_generic(text: Column | str) -> Column:
    """True when an output is empty, short, boiler-plate or unstructured."""
    text = F.coalesce(col(text), F.lit(""))
    boilerplate = text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in GENERIC_PATTERNS))
    return (
        (F.length(strip(text)) < GENERIC_MIN_LENGTH)
        | boilerplate
        | ~text.contains("Key Functionalities")
        | ~text.rlike(r"(?U)\d+\. ")
    )


def choose_output(first: Column | str, second: Column | str) -> Column:
    """The first output unless it is generic, then the second."""
    return F.when(is_generic(first), col(second)).otherwise(col(first))


def missing_sections(sections: Column, headers: list[str] = HEADERS) -> Column:
    """Required sections that are absent or too short, lower case."""
    lacking = [
        F.when(
            F.coalesce(F.length(sections[slug(h)]), F.lit(0)) < SECTION_MIN_LENGTH, F.lit(h.lower())
        )
        for h in headers
    ]
    return F.array_compact(F.array(*lacking))


def first_complete(outputs: list[Column | str], headers: list[str] = HEADERS) -> Column:
    """The first of several attempts that lacks no section: ``attempt`` (from 1), its ``sections`` and ``missing``.

    Where every attempt lacks some, ``attempt`` and ``sections`` are null and
    ``missing`` says what the last one lacks.
    """
    tried = [sections_strict(o, headers) for o in outputs]
    lacking = [missing_sections(s, headers) for s in tried]
    fine = [F.size(m) == 0 for m in lacking]
    attempt, sections = F.lit(None).cast("int"), F.lit(None)
    for k in reversed(range(len(outputs))):
        attempt = F.when(fine[k], k + 1).otherwise(attempt)
        sections = F.when(fine[k], tried[k]).otherwise(sections)
    none = F.array().cast("array<string>")
    missing = F.when(attempt.isNotNull(), none).otherwise(lacking[-1])
    return F.struct(attempt.alias("attempt"), sections.alias("sections"), missing.alias("missing"))


def fill_sections(
    text: Column | str, name: Column | str, language: Column | str, rules: Column | str
) -> Column:
    """All six sections as one text; short or failed ones get an explanation."""
    name, language, rules = col(name), col(language), F.coalesce(col(rules), F.lit(""))

    def default_of(header: str) -> Column:
        # The explanations.
        if header == "Dependent Files":
            return F.lit("No dependencies detected.")
        explained = F.format_string(
            "No explicit business logic was detected in the %s %s file for the '"
            + header
            + "' section. This may be because the file primarily contains UI components, "
            "configuration, or utility code, or lacks business rules, workflows, or domain "
            "logic. If this is a React component or similar, the file may focus on rendering "
            "or wiring rather than business processes.",
            name,
            language,
        )
        return F.when(rules != "", rules).otherwise(explained) if header == "Overview" else explained

    def build(found: Column) -> Column:
        parts = []
        for header in HEADERS:
            body = F.coalesce(found[slug(header)], F.lit(""))
            bad = (
                body.startswith("Error: LLM failed")
                | body.startswith("No business logic detected")
                | (F.length(body) < SECTION_MIN_LENGTH)
            )
            filled = F.when(bad, default_of(header)).otherwise(body)
            parts.append(F.concat(F.lit(header + "\n"), filled, F.lit("\n")))
        return F.concat_ws("\n", *parts)

    return let(sections_loose(text, HEADERS), build)


def format_chunk(text: Column | str, language: Column | str) -> Column:
    """A tidied chunk output with all five sections, functionalities one per paragraph."""
    defaults = chunk_defaults(col(language))

    def listed(items: Column) -> Column:
        return F.when(
            F.size(items) > 0, F.array_join(F.transform(items, strip), "\n\n")
        ).otherwise(defaults["Key Functionalities"])

    def build(found: Column) -> Column:
        parts = []
        for header in CHUNK_HEADERS:
            body = F.coalesce(F.nullif(found[slug(header)], F.lit("")), defaults[header])
            if header == "Key Functionalities":
                body = let(
                    F.filter(F.split(body, "\n"), lambda x: x.rlike(r"(?U)^\d+\.\s")), listed
                )
            parts.append(F.concat(F.lit(header + "\n"), body))
        return F.concat_ws("\n\n", *parts)

    return let(sections_strict(tidy(text)), build)


def sentences(text: Column | str) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space."""
    return F.split(col(text), r"(?U)(?<=[.!?])\s+")


def complete_sentences(text: Column | str) -> Column:
    """Drop a last sentence that does not end."""
    return let(
        sentences(text),
        lambda parts: F.when(F.element_at(parts, -1).rlike("[.!?]$"), col(text)).otherwise(
            F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")
        ),
    )


def summary_sections(text: Column | str) -> Column:
    """``## `` headings as ``array<struct<title, content, key>>``."""
    blocks = F.split(F.concat(F.lit("\n"), col(text)), r"\n(?=(?U:[^\S\n])*## )")
    blocks = F.filter(F.transform(blocks, strip), lambda b: b.startswith("## "))

    def section(rows: Column) -> Column:
        title = F.regexp_replace(F.element_at(rows, 1), "^## ", "")
        return F.struct(
            title.alias("title"),
            F.array_join(F.slice(rows, F.lit(2), F.size(rows)), " ").alias("content"),
            F.regexp_replace(F.lower(title), "[^a-z0-9]", "_").alias("key"),
        )

    rows_of = lambda b: F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != "")
    return F.transform(blocks, lambda b: let(rows_of(b), section))


def summary_missing(text: Column | str) -> Column:
    text = col(text)
    return F.filter(
        F.array(*[F.when(~text.contains(h), F.lit(h)) for h in SUMMARY_HEADINGS]),
        lambda h: h.isNotNull(),
    )


def summary_complete(text: Column | str) -> Column:
    """All headings present and at least 150 words."""
    words = F.size(F.split(F.btrim(col(text), F.lit(WHITESPACE)), r"(?U)\s+"))
    return (F.size(summary_missing(text)) == 0) & (words >= SUMMARY_MIN_WORDS)


def overview_body(text: Column | str, limit: int = 200) -> Column:
    """Body of the first paragraph that starts with ``overview``, lines joined by a space."""
    hits = F.filter(F.split(col(text), "\n\n"), lambda p: strip(F.lower(p)).startswith("overview"))
    rows = F.split(F.element_at(hits, 1), "\n")
    rows = F.filter(
        F.transform(F.slice(rows, F.lit(2), F.size(rows)), strip), lambda x: x != ""
    )
    return F.when(F.size(hits) > 0, F.substring(F.array_join(rows, " "), 1, limit))


def overview_head(text: Column | str, limit: int = 200) -> Column:
    """First paragraph without its first line, cut at ``limit``; null when empty."""
    first = F.element_at(F.split(col(text), "\n\n"), 1)
    return F.nullif(F.substring(F.regexp_replace(first, r"^[^\n]*\n", ""), 1, limit), F.lit(""))


def overview_snippet(text: Column | str) -> Column:
    """Three lines of Overview, else Key Functionalities, else the first section."""
    pieces = F.split(F.coalesce(col(text), F.lit("")), "\n\n")

    def first_with(prefix: str) -> Column:
        hits = F.filter(pieces, lambda p: p.startswith(prefix))
        return F.when(F.size(hits) > 0, F.element_at(hits, 1))

    target = F.coalesce(
        first_with("Overview"), first_with("Key Functionalities"), F.element_at(pieces, 1)
    )
    rows = F.filter(
        F.split(target, "\n"),
        lambda x: (strip(x) != "") & ~x.rlike(r"^(Overview|Key Functionalities)\z"),
    )
    joined = F.array_join(F.slice(rows, 1, 3), " ")
    snippet = F.when(
        F.length(joined) > 200, F.concat(F.substring(joined, 1, 200), F.lit("..."))
    ).otherwise(joined)
    return (
        F.when(is_blank(text), F.lit("No overview available."))
        .when(snippet == "", F.lit("No specific overview available."))
        .otherwise(snippet)
    )


def parse_dependent_files(text: Column | str) -> Column:
    """``array<struct<file_name, overview>>`` from the Dependent Files paragraph."""
    hits = F.filter(F.split(col(text), "\n\n"), lambda p: strip(p).startswith("Dependent Files"))
    block = F.replace(F.element_at(hits, 1), F.lit("\\n"), F.lit("\n"))
    rows = F.split(block, "\n")
    rows = F.filter(F.slice(rows, F.lit(2), F.size(rows)), lambda x: strip(x) != "")
    listed = r"(?U)^(?:\d+\.|-)\s*(.+?):\s*(.+)$"

    def entry(line: Column) -> Column:
        cut = F.locate(":", line)
        return F.struct(
            strip(
                F.when(line.rlike(listed), F.regexp_extract(line, listed, 1))
                .when(cut > 0, line.substr(F.lit(1), cut - 1))
                .otherwise(line)
            ).alias("file_name"),
            strip(
                F.when(line.rlike(listed), F.regexp_extract(line, listed, 2))
                .when(cut > 0, line.substr(cut + 1, F.length(line)))
                .otherwise(F.lit(""))
            ).alias("overview"),
        )

    none = (F.size(hits) == 0) | (
        F.coalesce(strip(F.element_at(rows, 1)), F.lit("")) == "No dependencies detected."
    )
    return F.transform(F.when(none, F.slice(rows, 1, 0)).otherwise(rows), entry)


def shows_dependency(overview: Column | str) -> Column:
    """False for cards that only repeat an import or have nothing to say."""
    overview = F.coalesce(col(overview), F.lit(""))
    low = F.lower(overview)
    return ~(
        (overview == "")
        | overview.rlike(r"(?i)^imports\b")
        | low.contains("providing components or utilities")
        | low.contains("no overview available")
    )


def numbered_items(text: Column | str) -> Column:
    """Numbered paragraphs, each reduced to what follows its first colon; others are left out."""
    items = F.filter(F.split(col(text), "\n\n"), lambda x: x.rlike(r"(?U)^\d+\.\s"))
    items = F.filter(items, lambda x: x.contains(":"))
    return F.transform(items, lambda x: strip(x.substr(F.locate(":", x) + 1, F.length(x))))


