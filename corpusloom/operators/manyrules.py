"""Rules by the thousand, from a table.

A rule can only match where one of its literals stands. All literals together
are one automaton, which finds in a single pass over a text the rules that may
match it; only the patterns of those are tried. Rules for a single word match
exactly the text's own words that equal it, so these are looked up, and no
pattern is tried for them. Texts are read once, where they lie, whatever the
number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import FLAGS

# The rules of one pass are sent to every task. More bytes of them than this are handled in several passes.
PASS_BYTES = 32 << 20

# Words are looked up so many at a time, but those of a text together.
PART_WORDS = 500_000

_FIELDS = "domain string, pattern_id int, pattern string, description string, languages array<string>"
_HIT = "domain: string, pattern_id: int, match_pos: int, rule: string, description: string, source: string"

# Characters that mean something in a pattern, and those after which what stands before may be missing.
_SPECIAL, _OPTIONAL = set(".^$*+?{}[]\\|()"), ("*", "?", "{")


def required_literal(pattern: str) -> str | None:
    """The longest run of plain characters that every match of ``pattern`` holds, in small letters; None if there is none.

    Only characters outside groups and classes count, and none of a pattern
    with alternatives outside groups, or with something that is not followed here.
    """
    runs, depth, k = [""], 0, 0
    if re.search(r"\(\?[a-zA-Z-]*x|\\[^\WbBwWsSdDAzZ]|\[[^\]]*[\[\\&]", pattern):
        return None
    while k < len(pattern):
        c, literal = pattern[k], None
        if c == "\\":
            literal = None if pattern[k + 1 : k + 2].isalpha() else pattern[k + 1 : k + 2]
            k += 2
        elif c in "[{":
            end = pattern.find("]" if c == "[" else "}", k + 2)
            if end < 0:
                return None
            k = end + 1
        else:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                return None
            literal = None if c in _SPECIAL else c
            k += 1
        follows = pattern[k : k + 1]
        if depth or not literal or follows in _OPTIONAL:
            runs.append("")
            continue
        runs[-1] += literal
        if follows == "+":
            runs.append("")
    best = max(runs, key=len).lower()
    return best if best and best.isascii() else None  # other letters may have more than one small form


def with_needs(rules: DataFrame) -> DataFrame:
    """Rules with ``needs``: the given literals, or else what their pattern requires, as small letters.

    A rule without any (an empty array) is tried on every text.
    """
    found = F.udf(lambda p: [x] if (x := required_literal(p)) else [], "array<string>")  # once for each rule, not for each text
    given = F.col("needs") if "needs" in rules.columns else F.lit(None).cast("array<string>")
    return rules.withColumn("needs", F.coalesce(F.transform(given, F.lower), found("pattern")))


def single_word(rule: tuple) -> str | None:
    """The word that a rule is for, if its pattern is that word between word boundaries and it needs nothing else."""
    found = re.fullmatch(r"\\b([A-Za-z0-9_]+)\\b", rule[2] or "")
    word = found[1].lower() if found else None
    return word if word is not None and list(rule[5]) == [word] else None


# A word as the boundaries of patterns see it, a letter whose small form is longer than itself (the
# patterns take it for an i), and the other letters that patterns take for one of a-z.
WORD = r"(?U)\w+"
LONGER = "\u0130"
_FOLDED = {"\u017f": "s", "\u0131": "i", "\u212a": "k"}


class _Words:
    """The rules for single words, and their matches among the words of texts."""

    def __init__(self, rules: list, numbers: list[int]) -> None:
        of: dict[str, list[int]] = {}
        for k in numbers:
            of.setdefault(single_word(rules[k]), []).append(k)
        self.words = pa.array(list(of), pa.string())
        self.count = np.array([len(x) for x in of.values()], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.rules = np.array([k for x in of.values() for k in x], np.int64)
        self.total = len(rules)
        self.open = np.array([not r[4] for r in rules], bool)
        listed = [(x, k) for k in numbers for x in rules[k][4] or () if x is not None]
        code = {x: n for n, x in enumerate(dict.fromkeys(x for x, _ in listed))}
        self.languages = pa.array(list(code), pa.string())
        self.wanted = np.array([code[x] * self.total + k for x, k in listed], np.int64)

    def matches(self, texts: pa.ListArray, languages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Row, rule, number among those of its row and rule, and word of each match, by row and rule."""
        flat = texts.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy())
        folded = pc.ascii_lower(flat.dictionary)
        for letter, small in _FOLDED.items():
            folded = pc.replace_substring(folded, letter, small)
        known = pc.fill_null(pc.index_in(folded, self.words), -1).to_numpy().astype(np.int64)
        code = known[flat.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        at = np.flatnonzero(code >= 0)
        times = self.count[code[at]]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rule = self.rules[np.repeat(self.first[code[at]], times) + inside]
        at = np.repeat(at, times)
        language = pc.fill_null(pc.index_in(languages, self.languages), -1).to_numpy().astype(np.int64)[row[at]]
        fits = self.open[rule] | ((language >= 0) & np.isin(language * self.total + rule, self.wanted))
        at, rule = at[fits], rule[fits]
        key = row[at] * self.total + rule
        order = np.argsort(key, kind="stable")
        at, rule, key = at[order], rule[order], key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        number = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
        return row[at], rule, number, flat.dictionary.take(flat.indices.take(pa.array(at)))


def _slices(texts: pa.ListArray) -> Iterator[slice]:
    """Rows of up to ``PART_WORDS`` words, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PART_WORDS, "right")))
        yield slice(at, end)
        at = end


def _automaton(rules: list, numbers: list[int]):
    """What finds the candidates among the rules of these numbers: those without literals, and an automaton or None."""
    import ahocorasick

    words: dict[str, list[int]] = {}
    for k in numbers:
        for word in rules[k][5]:
            words.setdefault(word, []).append(k)
    automaton = ahocorasick.Automaton()
    for word, of in words.items():
        automaton.add_word(word, of)
    if words:
        automaton.make_automaton()
    return {k for k in numbers if not rules[k][5]}, automaton if words else None


def _candidates(rules: list, columns: list[str]):
    """Adds the matches of rules for single words, and the other rules of each text one of whose literals it holds.

    A text without ``_words`` has all its rules among the latter.
    """
    entry = pa.struct(
        [("domain", pa.string()), ("pattern_id", pa.int32()), ("pattern", pa.string()), ("description", pa.string()),
         ("languages", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([dict(zip([f.name for f in entry], r[:5])) for r in rules.value], entry)
        single = [k for k, r in enumerate(rules.value) if single_word(r) is not None]
        words, others = _Words(rules.value, single), sorted({*range(len(rules.value))} - {*single})
        some, every = _automaton(rules.value, others), None
        for whole in batches:
            for part in _slices(whole["_words"]):
                batch = whole.slice(part.start, part.stop - part.start)
                picked, ends = [], [0]
                for text, known in zip(batch["_folded"].to_pylist(), batch["_words"].is_valid().to_pylist()):
                    if text is not None:
                        if not known and every is None:
                            every = _automaton(rules.value, range(len(rules.value)))
                        always, automaton = some if known else every
                        found = set(always)
                        for _, of in automaton.iter(text) if automaton is not None and text else ():
                            found.update(of)
                        picked += sorted(found)
                    ends.append(len(picked))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(picked, pa.int64())))
                row, rule, number, word = words.matches(batch["_words"], batch["_language"])
                told = table.take(pa.array(rule))
                source = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(row), np.int32)), ["regex"]).cast(pa.string())
                hit = [told.field(0), told.field(1), pa.array(number.astype(np.int32)), word, told.field(3), source]
                begins = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]).astype(np.int32)
                hits = pa.StructArray.from_arrays(hit, ["domain", "pattern_id", "match_pos", "rule", "description", "source"])
                hits = pa.ListArray.from_arrays(pa.array(begins), hits)
                yield pa.record_batch([*(batch[c] for c in columns), lists, hits], [*columns, "_rules", "_hits"])

    return run


def detect_many_rules(
    df: DataFrame,
    rules: DataFrame,
    keys: list[str],
    text: str = "text",
    language: str | None = "language",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """One row per match, with the columns of ``detect_rules``, for any number of rules.

    ``rules`` has ``domain, pattern_id, pattern, description, languages`` and
    may have ``needs``: literals of which a match holds at least one. Rules
    are sent to every task in passes of up to ``pass_bytes``; each pass reads
    the texts once and shuffles nothing.
    """
    spark = df.sparkSession
    chosen = with_needs(rules).select(*(c.split()[0] for c in _FIELDS.split(", ")), "needs")
    size = F.octet_length(F.to_json(F.struct("*")))
    total = chosen.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    lang = F.lower(F.coalesce(F.col(language), F.lit(""))) if language is not None else F.lit("")
    rows = df.select(*keys, F.col(text).alias("_text"), lang.alias("_language"))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kind = "array<struct<" + ", ".join(": ".join(f.split()) for f in _FIELDS.split(", ")) + ">>"

    def hits(rule):
        found = F.regexp_extract_all("_text", F.concat(F.lit(FLAGS), rule["pattern"]), F.lit(0))
        wanted = (F.size(F.coalesce(rule["languages"], F.array())) == 0) | F.array_contains(rule["languages"], F.col("_language"))
        found = F.when(wanted, found).otherwise(F.array().cast("array<string>"))
        return F.transform(
            found,
            lambda hit, n: F.struct(
                rule["domain"].alias("domain"), rule["pattern_id"].alias("pattern_id"), n.alias("match_pos"),
                hit.alias("rule"), rule["description"].alias("description"), F.lit("regex").alias("source"),
            ),
        )

    out = None
    for k in range(passes):
        mine = chosen.where(F.pmod(F.xxhash64("domain", "pattern_id"), F.lit(passes)) == k) if passes > 1 else chosen
        listed = [tuple(r) for r in mine.orderBy("domain", "pattern_id").collect()]
        sent = spark.sparkContext.broadcast(listed)
        plain = any(single_word(r) is not None for r in listed)
        known = F.when(~F.contains("_text", F.lit(LONGER)), words) if plain else F.lit(None).cast("array<string>")
        # upper and then lower case is how the patterns compare letters
        folded = F.lower(F.upper("_text"))
        if all(single_word(r) is not None for r in listed):
            folded = F.when(F.contains("_text", F.lit(LONGER)), folded)
        marked = rows.withColumns({"_folded": folded, "_words": known}).mapInArrow(
            _candidates(sent, rows.columns), f"{fields}, _rules {kind}, _hits array<struct<{_HIT}>>"
        )
        found = marked.select(*keys, F.inline(F.concat("_hits", F.flatten(F.transform("_rules", hits)))))
        out = found if out is None else out.unionByName(found)
    return out
