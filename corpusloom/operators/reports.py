"""Prompt tables, fallbacks, history and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.sections import choose_output
from corpusloom.functions.strings import col, is_blank

HISTORY_ROWS = 10


def prompt(template: str, content: Column | str) -> Column:
    return F.concat(F.lit(template + "\n"), col(content))


def prompt_with_rules(template: str, rules: Column | str, content: Column | str) -> Column:
    return F.concat(
        F.lit(template + "\nDetected rules for context:\n"), col(rules), F.lit("\n\n"), col(content)
    )


def prompt_with_context(template: str, context: Column | str, content: Column | str) -> Column:
    return F.concat(
        F.lit(template + "\n\nHere is related context from the project:\n---\n"),
        F.coalesce(col(context), F.lit("")),
        F.lit("\n---\n"),
        col(content),
    )


def prompt_table(
    chunks: DataFrame, template: str, content: str = "content", context: str | None = None, rules: str | None = None
) -> DataFrame:
    """Add the first prompt and, with a context column, the second one."""
    first = prompt(template, content) if rules is None else prompt_with_rules(template, rules, content)
    out = chunks.withColumn("prompt", first)
    if context is not None:
        out = out.withColumn("retry_prompt", prompt_with_context(template, context, content))
    return out


def chosen_outputs(outputs: DataFrame, first: str = "output", second: str = "retry_output") -> DataFrame:
    return outputs.withColumn("requirements", choose_output(first, second))


# The texts that stand in for failed work.
def file_fallback(name: Column | str, language: Column | str, reason: Column | str, rules: Column | str) -> Column:
    lang = F.lower(col(language))
    return F.concat(
        F.lit("Overview\nLimited analysis for "), col(name), F.lit(" due to "), col(reason), F.lit(". "), col(rules),
        F.lit("\n\nObjective\nTo support core "), lang,
        F.lit(" business functions.\n\nUse Case\nGeneral "), lang,
        F.lit(
            " business processes.\n\nKey Functionalities\n1. Basic Processing: Performs core tasks.\n\n"
            "2. Support Functions: Assists operations.\n\nWorkflow Summary\nIntegrates with "
        ),
        lang, F.lit(" system workflow."),
    )


def chunk_fallback(name: Column | str, number: Column | str) -> Column:
    n = col(number).cast("string")
    return F.concat(
        F.lit("Overview\nFailed to process chunk "), n, F.lit(" of "), col(name),
        F.lit(
            ".\n\nObjective\nTo support chunk functionality.\n\nUse Case\nGeneral chunk operations.\n\n"
            "Key Functionalities\n1. Partial Processing: Supports chunk "
        ),
        n,
        F.lit(
            " operations.\n\n2. Fallback: Provides basic functionality.\n\n"
            "Workflow Summary\nProcesses available chunk data."
        ),
    )


def chunk_error(language: Column | str) -> Column:
    lang = F.lower(col(language))
    return F.concat(
        F.lit("Overview\nError analyzing "), lang,
        F.lit(
            " code segment.\n\nObjective\nUnable to determine specific objectives.\n\nUse Case\nGeneral "
        ),
        lang,
        F.lit(
            " file operations.\n\nKey Functionalities\n1. Basic Processing: Handles core tasks.\n\n"
            "2. Error Recovery: Provides fallback functionality.\n\nWorkflow Summary\nSupports basic "
        ),
        lang, F.lit(" file workflow."),
    )


def with_fallback(results: DataFrame, requirements: str = "requirements", error: str = "error") -> DataFrame:
    """One row per file, failed ones with a fallback text."""
    text = file_fallback("file_name", "language", error, F.lit(""))
    return results.withColumn(
        requirements, F.when(F.col(error).isNotNull(), text).otherwise(F.col(requirements))
    )


def with_text(results: DataFrame, requirements: str = "requirements") -> DataFrame:
    return results.where(~is_blank(requirements))


def by_path(results: DataFrame, path: str = "rel_path") -> DataFrame:
    return results.orderBy(path)


def recent(history: DataFrame, ts: str, rows: int = HISTORY_ROWS, tie: str | None = None) -> DataFrame:
    """The newest entries, newest first."""
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return history.orderBy(*order).limit(rows)


def export_rows(results: DataFrame, columns: tuple[str, ...] = ("file_name", "rel_path", "requirements")) -> DataFrame:
    """One JSON text per file."""
    return results.select(F.to_json(F.struct(*columns)).alias("value"))
