"""URL filtering: a blocked Bloom filter, then an exact join.

Whatever a URL could be listed under (its canonical form; each domain suffix
with each path prefix that a rule could have) is hashed and looked up in a
blocked Bloom filter. Possible hits, and only these, go to an exact hash join
with the list, which removes the false ones. Rules and listed URLs share the
filter, which has a fixed greatest size: a longer list makes more false hits,
never other results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import salted_join
from corpusloom.session import cut_lineage

from .common import is_small, join_facts, let

# A block is eight 64-bit words; a key sets one bit in each.
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20
SALTS = [0x47B6137B44974D91 + 2 * k * 0x1A2B3C4D5E6F7081 for k in range(8)]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between ``://`` and ``/ ? #``, in lower case; then up to ``? #``. Both empty for other texts."""
    rest = _rest(url)
    parts = "^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, parts, 1), UPPER, LOWER), F.regexp_extract(rest, parts, 2)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for the addresses of a page: no scheme, ``www.``/``m.``, query, fragment or last slash."""
    return F.concat(F.regexp_replace(host, "^(www|m)\\.", ""), F.regexp_replace(path, "/+$", ""))


# --- the filter ---


def _words(hashes: np.ndarray) -> np.ndarray:
    """The bit of each of the eight words, one row for a key."""
    low = (hashes.astype(np.uint64) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    with np.errstate(over="ignore"):
        bits = (low[:, None] * np.array([s & ((1 << 64) - 1) for s in SALTS], np.uint64)) >> np.uint64(58)
    return np.uint64(1) << bits


def _blocks(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    high = hashes.astype(np.uint64) >> np.uint64(32)
    return ((high * np.uint64(n_blocks)) >> np.uint64(32)).astype(np.int64)


def build_filter(keys: DataFrame, n_keys: int, most_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """The filter of the column ``key``: ``n_blocks x 8`` words, at most ``most_bytes``.

    Tasks set the bits of their keys; a block is put together from them in a
    shuffle by block, so no task holds more than its share of the keys.
    """
    n_blocks = max(1, min(-(-n_keys * BITS_PER_KEY // 512), most_bytes // 64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch["h"].to_numpy().view(np.uint64)
            words = _words(hashes).view(np.int64)
            yield pa.record_batch(
                [pa.array(_blocks(hashes, n_blocks)), *[pa.array(words[:, k]) for k in range(8)]],
                ["block", *[f"w{k}" for k in range(8)]],
            )

    schema = "block long, " + ", ".join(f"w{k} long" for k in range(8))
    set_bits = keys.select(F.xxhash64("key").alias("h")).mapInArrow(bits, schema)
    rows = set_bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]).toArrow()
    out = np.zeros((n_blocks, 8), np.int64)
    out[rows["block"].to_numpy()] = np.stack([rows[f"w{k}"].to_numpy() for k in range(8)], axis=1)
    return out.view(np.uint64)


def may_contain(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    wanted = _words(hashes)
    return ((table[_blocks(hashes, len(table))] & wanted) == wanted).all(axis=1)


def possible_hits(candidates: DataFrame, table: np.ndarray) -> DataFrame:
    """``page, key`` for each of the array ``keys`` that the filter lets through."""
    shared = candidates.sparkSession.sparkContext.broadcast(table)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["hashes"]
            hits = may_contain(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), shared.value)
            if not hits.any():
                continue
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))[hits]
            yield pa.record_batch(
                [batch["page"].take(pa.array(owner)), batch["keys"].flatten().filter(pa.array(hits))], ["page", "key"]
            )

    hashed = candidates.select("page", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"))
    return hashed.mapInArrow(probe, f"page {candidates.schema['page'].dataType.simpleString()}, key string")


# --- rules and lists ---


def rule_keys(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """What a rule that fits could be: up to ``most_labels`` last labels of the host, and a start of the path."""
    last = F.substring_index(host, ".", -most_labels)  # no rule's host has more

    def ends(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))

    suffixes = let(F.split(last, "\\."), ends)
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(starts, lambda n: F.concat(F.lit("rule "), s, F.substring(path, F.lit(1), n))),
        )
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame,
    id_column: str = "page_id",
    most_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    ``rules`` has ``rule`` (host and start of the path) and ``verdict``; the
    longest one that fits decides, then the one with the longer host. Without
    one, a URL is blocked if its canonical form is among ``url`` of
    ``listed``. Null texts and texts without ``://`` have an empty host and
    path, which no rule fits and no list has, so they are allowed. Repeated
    rows and ids are judged row by row; either list may be empty.
    """
    parsed = pages.select(F.col(id_column), F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parsed = parsed.select(id_column, host.alias("host"), path.alias("path")).withColumn(
        "_form", canonical(F.col("host"), F.col("path"))
    )
    rule_list = cut_lineage(
        rules.where("rule IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("rule_verdict"))
    )
    lengths = [
        r[0]
        for r in rule_list.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().orderBy("n").collect()
    ]
    rule_labels = F.size(F.split(F.substring_index("rule", "/", 1), "\\."))
    most_labels = rule_list.agg(F.max(rule_labels)).first()[0] or 1
    keys = rule_list.select(F.concat(F.lit("rule "), "rule").alias("key")).unionByName(
        listed.where("url IS NOT NULL").select(F.concat(F.lit("url "), "url").alias("key"))
    )
    exact = cut_lineage(keys.distinct())
    table = build_filter(exact, exact.count(), most_bytes)
    looked_up = F.unhex(F.sha2(F.concat_ws("\n", "host", "path").cast("binary"), 256))
    parsed = parsed.withColumn("page", looked_up)
    distinct = parsed.groupBy("page").agg(
        F.count(F.lit(1)).alias("_pages"), *[F.first(c).alias(c) for c in ("host", "path", "_form")]
    )
    own_form = F.array(F.concat(F.lit("url "), "_form"))
    candidates = distinct.where("host <> ''").select(
        "page", F.concat(rule_keys(F.col("host"), F.col("path"), lengths, most_labels), own_form).alias("keys")
    )
    hits = join_list(possible_hits(candidates, table), exact, "key", "inner")
    as_rule = F.when(F.col("key").startswith("rule "), F.substring("key", 6, 1 << 30))
    ranked = F.when(
        as_rule.isNotNull(),
        F.struct(F.length(as_rule).alias("n"), F.instr(as_rule, "/").alias("host_length"), as_rule.alias("rule")),
    )
    best = hits.groupBy("page").agg(
        F.max(ranked)["rule"].alias("rule"), F.max(F.col("key").startswith("url ")).alias("listed")
    )
    facts = join_list(best, rule_list, "rule", "left").join(distinct.select("page", "_pages"), "page")
    found = join_facts(parsed, facts, "page", "_pages", pages.count())
    is_listed = F.coalesce("listed", F.lit(False))
    return found.select(
        id_column, "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        is_listed.alias("listed"),
    )


def join_list(rows: DataFrame, listed: DataFrame, on: str, how: str) -> DataFrame:
    """The exact join with a list: sent to every task while it has few rows and bytes, else by key with hot keys split."""
    if is_small(listed, F.octet_length(on)):
        return rows.join(F.broadcast(listed), on, how)
    return salted_join(cut_lineage(rows), listed, [on], how)


# --- the registered query ---

# The rules, as host and start of the path.
RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
    ("com/de/", "block"),
]

# Names of hosts whose pages make up the list of blocked URLs.
LISTED_NAMES = ["casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x"]


def listed_pages(pages: DataFrame) -> DataFrame:
    """The canonical URLs of the pages on hosts with a label among ``LISTED_NAMES``."""
    host, path = host_and_path(F.col("url"))
    labels = F.split(host, "\\.")
    bad = F.arrays_overlap(labels, F.array(*[F.lit(n) for n in LISTED_NAMES]))
    return pages.where(bad).select(canonical(host, path).alias("url")).distinct()


def url_digest(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "rule string, verdict string")
    return judge_urls(pages, rules, listed_pages(pages))


_LETTERS = f"'{UPPER}', '{LOWER}'"
URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), {_LETTERS}) AS host,
    regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
forms AS (
  SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '') AS form,
    len(list_intersect(string_split(host, '.'), {LISTED_NAMES})) > 0 AS bad FROM parts),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.split('/')[0]}', '{r[r.index('/'):]}', '{v}')" for r, v in RULES)})
  AS t(rule_host, rule_path, rule_verdict)),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
    arg_max(rule_verdict, (length(rule_host || rule_path), length(rule_host))) AS rule_verdict
  FROM forms, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, host <> '' AND form IN (SELECT form FROM forms WHERE bad) AS listed,
  coalesce(rule_verdict, CASE WHEN host <> '' AND form IN (SELECT form FROM forms WHERE bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM forms LEFT JOIN fits USING (page_id)"""
