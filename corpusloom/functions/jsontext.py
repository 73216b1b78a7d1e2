"""JSON found inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import col, find_first, strip


def extract_json(text: Column | str) -> Column:
    """The first part that parses, as VARIANT: a json fence, any fence, the
    widest ``[...]``, the whole text; null when none does."""
    text = col(text)
    candidates = [
        strip(find_first(text, r"```json\s*([\s\S]*?)\s*```", 1)),
        strip(find_first(text, r"```[\w]*\s*([\s\S]*?)\s*```", 1)),
        find_first(text, r"(?s)\[.*\]", 0),
        text,
    ]
    return F.coalesce(*[F.try_parse_json(c) for c in candidates])


def extract_json_text(text: Column | str) -> Column:
    return F.to_json(extract_json(text))


def object_keys(text: Column | str) -> Column:
    """Top-level keys; null when the text is no JSON object."""
    return F.json_object_keys(col(text))
