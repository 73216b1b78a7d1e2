"""Quality rules: statistics of a text, and a decision list learned from labels.

The list is learned by sequential covering. Each rule is a short conjunction of
thresholds that is grown on two thirds of the labelled rows (by the gain in
information about junk), pruned on the other third, and kept only if it is
precise there; the rows it covers are then set aside. The result is an ordered
``CASE WHEN`` expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

from .common import count_chars_of, let, split_words, whole_text

# The characters that count as symbols, and the limits of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"

# The list is learned from at most this many labelled documents, chosen by a hash of the id.
MAX_LABELLED = 20_000

MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9  # of a rule, on rows it was not grown on
MIN_COVERED = 2  # junk rows that a rule must find there
CUTS = 24  # thresholds tried for each statistic

FEATURES = (
    "symbol_share", "repeat_share", "dup_line_share", "upper_share", "shout_share", "digit_share",
    "mean_word", "n_words",
)


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash within one text. A text without
    equal windows is done after one pass; the others sort their windows, take
    those that equal a neighbour, and add up what these cover.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
    )

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda rows: let(_equal_neighbours(rows), _cover))

    def _equal_neighbours(rows: Column) -> Column:
        same = F.filter(
            F.transform(
                rows,
                lambda r, k: F.when(
                    F.coalesce(r["h"] == F.get(rows, k - 1)["h"], F.lit(False))
                    | F.coalesce(r["h"] == F.get(rows, k + 1)["h"], F.lit(False)),
                    r["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(same)

    def _cover(places: Column) -> Column:
        state = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            state,
            lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
            lambda s: s["n"],
        )

    repeated = let(
        windows,
        lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            covered(hashes)
        ),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(repeated)


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the columns of :func:`statistics`, without a shuffle."""
    text = whole_text(F.col(text_column))
    words = let(
        split_words(text), lambda w: F.struct(F.size(w).alias("words"), _repeated_words(w).alias("repeated"))
    )
    has_word = "[^\\x20\\x09-\\x0D]"
    lines = let(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(has_word)),
        lambda rows: F.struct(
            F.size(rows).alias("lines"), (F.size(rows) - F.size(F.array_distinct(rows))).alias("repeated")
        ),
    )
    upper = count_chars_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out = docs.withColumns({"_words": words, "_lines": lines}).withColumns(
        {
            "n_words": F.col("_words.words").cast("long"),
            "word_chars": (F.length(text) - count_chars_of(text, " \t\n\x0b\x0c\r")).cast("long"),
            "n_symbols": count_chars_of(text, SYMBOLS),
            "n_dup_lines": F.col("_lines.repeated").cast("long"),
            "n_repeat_words": F.col("_words.repeated").cast("long"),
        }
    )
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_lines.lines"), F.lit(1)),
        "upper_share": upper / chars,
        "shout_share": count_chars_of(text, "!") / chars,
        "digit_share": count_chars_of(text, "0123456789") / chars,
        "mean_word": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    }
    return out.withColumns({k: v.cast("double") for k, v in shares.items()}).drop("_words", "_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # else at most
    threshold: float

    def expression(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def expression(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expression()
        return out

    def holds(self, row: dict[str, float]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _cuts(values: list[float]) -> list[float]:
    """Thresholds between neighbouring values, at even ranks and at both tails."""
    distinct = sorted(set(values))
    middles = [float(f"{(a + b) / 2:.4g}") for a, b in zip(distinct, distinct[1:])]
    if len(middles) <= CUTS:
        return middles
    ranks = {round(k * (len(middles) - 1) / (CUTS - 1)) for k in range(CUTS)}
    tails = {round((len(middles) - 1) * (1 - 2.0**-k)) for k in range(2, 9)}
    return sorted({middles[k] for k in ranks | tails})


def learn_rules(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """Ordered rules that recognise junk; ``rows`` are statistics and whether they are junk.

    Rows are handled as bits of integers, so trying a condition is one AND.
    """
    grow_on = [r for k, r in enumerate(rows) if k % 3]
    prune_on = [r for k, r in enumerate(rows) if not k % 3]

    def bits(part, holds) -> int:
        return sum(1 << k for k, r in enumerate(part) if holds(r))

    options = [
        Condition(f, above, cut)
        for f in FEATURES
        for cut in _cuts([r[f] for r, _ in grow_on])
        for above in (True, False)
    ]
    grown_bits = {c: int("0" + "".join("1" if c.holds(r) else "0" for r, _ in reversed(grow_on)), 2) for c in options}
    junk, fine = bits(grow_on, lambda r: r[1]), bits(grow_on, lambda r: not r[1])
    rules: list[Rule] = []
    while junk and len(rules) < MAX_RULES:
        covered, chosen = junk | fine, []
        while len(chosen) < MAX_CONDITIONS and covered & fine:
            p0, n0 = (covered & junk).bit_count(), (covered & fine).bit_count()

            def gain(c: Condition) -> float:
                p = (covered & grown_bits[c] & junk).bit_count()
                n = (covered & grown_bits[c] & fine).bit_count()
                return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0

            best = max(options, key=gain, default=None)
            if best is None or gain(best) <= 0:
                break
            chosen.append(best)
            covered &= grown_bits[best]
        if not chosen:
            break
        rule, junk_found, fine_found = _pruned(chosen, prune_on, rules)
        good = rule and junk_found >= MIN_COVERED and junk_found >= MIN_PRECISION * (junk_found + fine_found)
        if good:
            rules.append(rule)
        # what a rule covers is set aside, also when the rule is not good enough
        found = junk | fine
        for c in rule.conditions if good else chosen:
            found &= grown_bits[c]
        junk, fine = junk & ~found, fine & ~found
    return rules


def _tightest(conditions: list[Condition]) -> tuple[Condition, ...]:
    """The same conjunction with one threshold for each statistic and direction."""
    out: dict[tuple[str, bool], Condition] = {}
    for c in conditions:
        key = (c.feature, c.above)
        if key not in out or (c.threshold > out[key].threshold) == c.above:
            out[key] = c
    return tuple(out.values())


def _pruned(chosen: list[Condition], rows, earlier: list[Rule]) -> tuple[Rule | None, int, int]:
    """The start of the conjunction that is worth most on ``rows``, with the junk and fine rows it covers."""
    left = [r for r in rows if not any(rule.holds(r[0]) for rule in earlier)]
    best: tuple[float, int, Rule | None, int, int] = (0.0, 0, None, 0, 0)
    for size in range(1, len(chosen) + 1):
        rule = Rule(_tightest(chosen[:size]))
        hit = [is_junk for r, is_junk in left if rule.holds(r)]
        p = sum(hit)
        n = len(hit) - p
        if p and ((p - n) / (p + n), p) > best[:2]:
            best = ((p - n) / (p + n), p, rule, p, n)
    return best[2:]


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[dict, bool]]:
    """At most ``most`` labelled rows, one for each id, chosen by a hash of the id.

    Ids with different labels and null labels are left out, and so are texts
    that the base rule rejects anyway.
    """
    clear = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .where("_low = _high")
        .withColumn("_order", F.xxhash64("doc_id"))
        .orderBy("_order")
        .limit(most)
    )
    found = (
        stats.where(f"NOT ({BASE_FAILED})")
        .join(F.broadcast(clear), "doc_id")
        .groupBy("doc_id", "_order", "_low")
        .agg(F.min(F.struct(*FEATURES)).alias("s"))
        .orderBy("_order")
    )
    return [({f: float(r["s"][f]) for f in FEATURES}, r["_low"] == 0) for r in found.collect()]


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``base_failed``, ``rule`` (what rejected the text, else null) and ``kept``."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.expression(), F.lit(str(rule)))
    return (
        stats.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("rule", verdict)
        .withColumn("kept", F.col("rule").isNull())
    )


def apply_quality_rules(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``rule`` and ``kept`` of every document.

    The statistics are written once and serve for learning and for judging.
    Null and empty texts have no words and fail the base rule. Without usable
    labels there are no learned rules. Repeated rows are each judged.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = with_statistics(docs.select("doc_id", "text"))
    stats = cut_lineage(measured.select("doc_id", *names, *[f for f in FEATURES if f not in names]))
    return judge(stats, learn_rules(labelled_sample(stats, labels, most)))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    The rules are learned from the labelled texts among ``docs``; the verdict
    is then an expression over each row itself, so nothing is joined back.
    """
    sampled = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    clear = sampled.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_high"))
    chosen = clear.where("quality = _high").drop("_high").orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    labelled = with_statistics(
        docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    )
    rules = learn_rules(labelled_sample(labelled, chosen))
    rows = docs.select(F.struct("*").alias("_row"), "text")  # so that no column clashes with a statistic
    # a filter would be pushed below the statistics and compute them again for each rule
    kept = F.inline(F.when(F.col("kept"), F.array("_row")))
    return judge(with_statistics(rows), rules).select(kept)
