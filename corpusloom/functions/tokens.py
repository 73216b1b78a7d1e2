"""Token counts, size classes, windows and cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import WHITESPACE, col

# Limits in tokens.
MAX_SAFE_TOKENS = 50_000
MAX_EMBEDDING_TOKENS = 8_192
EMBEDDING_BUFFER = 100
SMALL_FILE_TOKENS = 1_000
STORE_CHUNK_TOKENS = 2_000
MAX_LINES_PER_CHUNK = 2_000
MAX_SECTION_TOKENS = 1_000

# Fixed value: characters per token in the estimate.
CHARS_PER_TOKEN = 4


def token_count(text: Column | str) -> Column:
    """Estimated tokens: a quarter of the code points, rounded down."""
    return F.floor(F.length(col(text)) / CHARS_PER_TOKEN).cast("int")


def size_class(
    tokens: Column | str, small: int = SMALL_FILE_TOKENS, large: int = MAX_SAFE_TOKENS
) -> Column:
    tokens = col(tokens)
    return (
        F.when(tokens < small, F.lit("small"))
        .when(tokens <= large, F.lit("medium"))
        .otherwise(F.lit("large"))
    )


def token_windows(
    text: Column | str, max_tokens: int = MAX_EMBEDDING_TOKENS - EMBEDDING_BUFFER
) -> Column:
    """The whole text when it fits, else consecutive windows of ``max_tokens``.

    The pattern walks the text once, so long texts stay linear.
    """
    text = col(text)
    window = F.lit("(?s).{1,%d}" % (CHARS_PER_TOKEN * max_tokens))
    return F.when(token_count(text) <= max_tokens, F.array(text)).otherwise(
        F.regexp_extract_all(text, window, F.lit(0))
    )


def truncate_words(text: Column | str, max_words: int = MAX_EMBEDDING_TOKENS) -> Column:
    """The first ``max_words`` words joined by one space; a text that fits stays as it is."""
    text = col(text)
    words = F.split(F.btrim(text, F.lit(WHITESPACE)), r"(?U)[\s\x1c-\x1f]+")
    return F.when(
        F.size(words) > max_words, F.array_join(F.slice(words, 1, max_words), " ")
    ).otherwise(text)


def truncate_over_limit(
    text: Column | str, max_tokens: int = MAX_SAFE_TOKENS, keep_chars: int | None = None
) -> Column:
    """Texts over ``max_tokens`` keep their first three quarters of ``max_tokens`` characters."""
    text = col(text)
    keep = max_tokens * 3 // 4 if keep_chars is None else keep_chars
    return F.when(token_count(text) > max_tokens, F.substring(text, 1, keep)).otherwise(text)


def truncate_medium(text: Column | str, max_tokens: int = MAX_SAFE_TOKENS) -> Column:
    """Texts over half the limit keep the share of characters worth 0.3 of the limit."""
    text = col(text)
    tokens = token_count(text)
    keep = F.floor(F.length(text) * F.lit(max_tokens) * F.lit(0.3) / tokens).cast("int")
    return F.when(tokens > max_tokens // 2, text.substr(F.lit(1), keep)).otherwise(text)


def trim_context(chunk: Column | str, context: Column | str, max_tokens: int = MAX_SAFE_TOKENS) -> Column:
    """Shorten the context when chunk and context together pass the limit."""
    context = F.coalesce(col(context), F.lit(""))
    total = token_count(chunk) + token_count(context)
    return F.when(total > max_tokens, F.substring(context, 1, max_tokens // 4)).otherwise(context)


def first_window(text: Column | str, max_tokens: int = MAX_EMBEDDING_TOKENS) -> Column:
    """What is embedded of an over-long query: its first window."""
    text = col(text)
    return F.when(
        token_count(text) > max_tokens, F.substring(text, 1, CHARS_PER_TOKEN * max_tokens)
    ).otherwise(text)


def content_hash(text: Column | str) -> Column:
    """Cache key of a text."""
    return F.sha2(col(text), 256)


def chunk_hash(text: Column | str) -> Column:
    return F.md5(col(text))
