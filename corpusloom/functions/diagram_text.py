"""Checks on diagram source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import col, count_char, find_first, strip

# The two kinds of diagram that are made.
TARGET_DIAGRAMS = ["Entity Relationship Diagram", "Requirement Diagram"]

# Headers a drawable diagram may start with, and the type each stands for.
DIAGRAM_HEADERS = [
    ("graph", r"(?i)^graph\s+(TD|LR)"),
    ("graph", r"(?i)^flowchart\s+(TD|LR)"),
    ("sequenceDiagram", "(?i)^sequenceDiagram"),
    ("classDiagram", "(?i)^classDiagram"),
    ("stateDiagram", "(?i)^stateDiagram"),
    ("erDiagram", "(?i)^erDiagram"),
    ("requirementDiagram", "(?i)^requirementDiagram"),
]


def strip_fence(code: Column | str) -> Column:
    """The text inside a mermaid fence, or the text itself."""
    code = col(code)
    return F.coalesce(strip(find_first(code, r"```mermaid\s*([\s\S]*?)\s*```", 1)), code)


def checked_code(target: Column | str, output: Column | str) -> Column:
    """The diagram text, or a message that says what is wrong with it."""
    target, output = col(target), strip(output)
    code = strip_fence(output)
    known = F.lower(target).isin([t.lower() for t in TARGET_DIAGRAMS])
    return (
        F.when(~known, F.concat(F.lit("Unsupported graph type: "), target))
        .when(
            count_char(output, "\n") < 1,
            F.concat(F.lit("Error: Insufficient graph definition for "), target),
        )
        .when(
            ~code.startswith("graph"),
            F.lit("Error: Invalid graph type. Must start with 'graph TD' or 'graph LR'"),
        )
        .otherwise(code)
    )


def is_drawable(code: Column | str, expected: Column | str | None = None) -> Column:
    """Known header plus at least one node or connection.

    With ``expected`` the header's type name must also occur, as written, in
    the lower-cased expectation.
    """
    code = strip(code)
    header = F.lit(False)
    for kind, pattern in DIAGRAM_HEADERS:
        hit = code.rlike(pattern)
        if expected is not None:
            want = F.coalesce(col(expected), F.lit(""))
            hit = hit & ((want == "") | F.lower(want).contains(kind))
        header = header | hit
    nodes = (
        code.rlike(r"\[.*?\]")
        | code.rlike(r"\{.*?\}")
        | code.contains("requirement")
        | code.rlike('".*?"')
    )
    connections = code.contains("--")
    return header & (nodes | connections)


def type_mismatch(code: Column | str, expected: Column | str) -> Column:
    code, want = strip(code), F.lower(F.coalesce(col(expected), F.lit("")))
    return (
        F.when(want.contains("entity relationship"), ~code.rlike("(?i)^erDiagram"))
        .when(want.contains("requirement"), ~code.rlike("(?i)^requirementDiagram"))
        .otherwise(F.lit(False))
    )


def has_code(code: Column | str) -> Column:
    return F.coalesce(col(code) != "", F.lit(False))


def is_error(code: Column | str) -> Column:
    """Failed outputs start with ``Error`` or ``Generation Error``."""
    code = col(code)
    return code.startswith("Error") | code.startswith("Generation Error")
