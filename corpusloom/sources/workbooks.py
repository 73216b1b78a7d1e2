"""Workbook contents written as tagged lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.strings import let, strip

# The headings of the parts of a workbook text.
SHEET = r"--- Sheet: (.*) ---"
TOP_HEADINGS = r"--- Sheet: |=== |Pivot Tables in |External Links:|Data Connections:"
SUB_HEADINGS = r"Data Validations:|Conditional Formatting:|Named Ranges:"
KINDS = [
    ("cell", r"^CELL: "),
    ("formula", r"^FORMULA: "),
    ("data_validation", r"^DATA_VALIDATION: "),
    ("conditional_formatting", r"^CONDITIONAL_FORMATTING: "),
]
LIST_KINDS = [
    ("Named Ranges:", "named_range"),
    ("Pivot Tables in", "pivot"),
    ("External Links:", "external_link"),
    ("Data Connections:", "data_connection"),
]


def workbook_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per tagged line with its sheet, kind and fields.

    The text is cut before its headings inside its row, so a line knows its
    sheet without a window over the file.
    """
    cut = lambda part, names: F.split(part, rf"\n(?=\s*(?:{names}))")
    first_line = lambda part: strip(F.element_at(F.split(strip(part), "\n"), 1))

    def rows_of(top):
        return let(
            F.regexp_extract(first_line(top), SHEET, 1),
            lambda sheet: F.flatten(
                F.transform(
                    cut(top, SUB_HEADINGS),
                    lambda sub: let(first_line(sub), lambda heading: tagged(sub, sheet, heading)),
                )
            ),
        )

    def tagged(part, sheet, heading):
        return F.transform(
            F.split(part, "\n"),
            lambda line: F.struct(
                sheet.alias("sheet"), heading.alias("heading"), line.alias("line")
            ),
        )

    exploded = files.select(
        *keys,
        F.posexplode(F.flatten(F.transform(cut(F.col(text), TOP_HEADINGS), rows_of))).alias("line_no", "_r"),
    ).select(*keys, "line_no", "_r.sheet", "_r.heading", "_r.line")
    line, item = F.col("line"), strip("line")
    kind = None
    for name, pattern in KINDS:
        kind = F.when(line.rlike(pattern), name) if kind is None else kind.when(line.rlike(pattern), name)
    for heading, name in LIST_KINDS:
        kind = kind.when(item.startswith("- ") & F.col("heading").startswith(heading), name)
    rule = lambda label: F.nullif(
        F.regexp_extract(line, rf"(?:^|[:|] ){label}: (.*?)(?: \| |$)", 1), F.lit("")
    )
    assigned = F.col("kind").isin("cell", "formula")
    is_rule = F.col("kind").isin("data_validation", "conditional_formatting")
    entry = F.substring(item, 3, 1 << 30)
    return (
        exploded.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            *keys,
            F.nullif("sheet", F.lit("")).alias("sheet"),
            "line_no",
            "kind",
            F.when(assigned, F.regexp_extract(line, r"^\w+: (\S+) = ", 1))
            .when(~is_rule, F.substring_index(entry, ": ", 1))
            .alias("ref"),
            F.when(assigned, F.regexp_extract(line, r"^\w+: \S+ = (.*)$", 1))
            .when(~is_rule & entry.contains(": "), entry.substr(F.locate(": ", entry) + 2, F.length(entry)))
            .alias("value"),
            F.when(is_rule, rule("Range")).alias("cell_range"),
            F.when(is_rule, rule("Type")).alias("rule_type"),
            F.when(is_rule, F.coalesce(rule("Formula1"), rule("Formula"))).alias("formula1"),
            F.when(is_rule, rule("Formula2")).alias("formula2"),
        )
    )
