"""Personal data by weak supervision, with column functions only.

Four labelers look at each candidate span and vote for, against or not at all:
its pattern, its checksum or range, word lists, and the words before it. The
votes of all candidates are counted by pattern of votes (a table of bounded
size); expectation-maximisation estimates from them how far each labeler can
be trusted for each kind, and a logistic span classifier is trained on the
estimated labels. It becomes an expression over the votes and the span's shape.

Spans that meet a kind's base definition are always reported; the classifier
decides about the others: numbers without a plus sign, masked addresses, card
numbers with a wrong digit, and addresses of eight groups.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import running_sums
from corpusloom.session import cut_lineage

from .common import let, whole_text

KINDS = ("email", "ip", "card", "phone")  # in the order of ties
LABELERS = ("by_pattern", "by_check", "by_list", "by_context")

# Base patterns. They find what the plain definitions find, in linear time: a match can only begin
# where a run of its first characters begins (or where the match before it ended), and parts that
# cannot give characters back are possessive.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ of 12 digits or more          phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Further candidates.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]{2,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.(-])(?<![0-9+][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}

# Word lists of the labelers: a start or end that speaks for a kind.
LISTED = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|[1-9][0-9]?\.|1[0-9]{2}\.|2[01][0-9]\.|22[0-3]\.|fe80:|2001:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|\(?[2-9])",
}

# Words within CONTEXT characters before a span that speak for it, and against any.
CONTEXT = 40
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|login|logged|address|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|dial|contact)\b",
}
AGAINST = r"(?i)(?:\b(?:version|release|isbn|issn|order|invoice|serial|part|model|token|key|hash)\b[^\n]{0,8}$|[=#v]$)"

# Texts without any of these hold no candidate.
MAY_HOLD = r"[0-9@]|(?i:[\[(]at[\])])"

def found_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value, before>>`` of all matches, in code points.

    The pieces between matches and the matches alternate, so a match begins
    where all earlier pieces and matches end. ``before`` is the end of the
    piece before it.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(v: Column) -> Column:
        def spans(pieces: Column) -> Column:
            sizes = F.transform(v, lambda m, k: (F.length(F.get(pieces, k)) + F.length(m)).cast("long"))
            return let(
                running_sums(sizes),
                lambda before: F.transform(
                    v,
                    lambda m, k: let(
                        F.get(before, k) + F.length(F.get(pieces, k)),
                        lambda start: F.struct(
                            start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"),
                            F.right(F.get(pieces, k), F.lit(CONTEXT)).alias("before"),
                        ),
                    ),
                ),
            )

        return let(F.split(text, pattern, -1), spans)

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(placed(v)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def weight(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + weight(i)) % 10 == 0


def base_holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    n = F.length(digits_of(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), passes_luhn(digits_of(value))).otherwise(F.lit(False))


def _votes(kind: str, span: Column, is_base: bool) -> list[Column]:
    """One vote (1, 0 or -1) of each labeler."""
    value = span["value"]
    check = {
        "email": F.when(value.rlike(r"(?i)(?:\.|dot[\])] ?)[a-z]{2,24}$"), 1).otherwise(-1),
        "ip": F.when(value.rlike(OCTETS) | value.contains(":"), 1).otherwise(-1),
        "card": F.when(F.length(digits_of(value)) <= 19, F.when(passes_luhn(digits_of(value)), 1).otherwise(-1)).otherwise(-1),
        "phone": F.when(F.length(digits_of(value)).between(9, 15), 1).otherwise(-1),
    }[kind]
    against = F.when(span["before"].rlike(AGAINST), -1)
    return [
        F.lit(1 if is_base else 0).alias("by_pattern"),
        check.alias("by_check"),
        F.when(value.rlike(LISTED[kind]), 1).otherwise(0).alias("by_list"),
        against.when(span["before"].rlike(CUES[kind]), 1).otherwise(0).alias("by_context"),
    ]


def _labelled(kind: str, spans: Column, is_base: bool) -> Column:
    def one(s: Column) -> Column:
        length = s["end"] - s["start"]
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            s["end"].alias("end"),
            F.lit(is_base).alias("base"),
            *_votes(kind, s, is_base),
            F.when(length < 12, 0).when(length < 24, 1).otherwise(2).alias("size"),
        )

    return F.transform(spans, one)


def _before(marks: Column, asked: Column, equal: bool) -> Column:
    """For each number of ``asked``, in order, how many of ``marks`` are less (or ``equal``).

    Both are sorted together, and a running sum counts the marks.
    """
    first = F.lit(0 if equal else 1)

    def event(place: Column, turn: Column, weight: int, index: Column) -> Column:
        return F.struct(place.alias("place"), turn.alias("turn"), F.lit(weight).cast("long").alias("weight"), index.alias("index"))

    events = F.concat(
        F.transform(marks, lambda p: event(p, first, 1, F.lit(-1))),
        F.transform(asked, lambda p, k: event(p, 1 - first, 0, k)),
    )

    def counted(ordered: Column) -> Column:
        return let(
            running_sums(F.transform(ordered, lambda e: e["weight"])),
            lambda sums: F.transform(ordered, lambda e, k: F.struct(e["index"].alias("index"), F.get(sums, k).alias("n"))),
        )

    told = F.array_sort(F.filter(let(F.array_sort(events), counted), lambda e: e["index"] >= 0))
    return F.transform(told, lambda e: e["n"])


def _apart_from(sure: Column, loose: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``sure``.

    So many of ``sure`` overlap a span as begin before its end and do not end
    before its start, which takes sorting but no comparison of all with all.
    """
    begun = _before(F.transform(sure, lambda b: b["start"]), F.transform(loose, lambda s: s["end"]), equal=False)
    ended = _before(F.transform(sure, lambda b: b["end"]), F.transform(loose, lambda s: s["start"]), equal=True)
    kept = let(begun, lambda b: let(ended, lambda e: F.filter(loose, lambda s, k: F.get(b, k) == F.get(e, k))))
    return F.when((F.size(sure) == 0) | (F.size(loose) == 0), loose).otherwise(kept)


def candidates(text: Column) -> Column:
    """All candidate spans with their votes, base spans among them, sorted by place and kind."""

    def holds(kind: str):
        return lambda s: base_holds(kind, s["value"])

    base = F.concat(
        *[
            _labelled(kind, F.filter(found_spans(text, BASE[kind]), holds(kind)), True) for kind in KINDS
        ]
    )
    loose = F.concat(*[_labelled(k, found_spans(text, LOOSE[k]), False) for k in KINDS])
    apart = let(base, lambda sure: let(loose, lambda further: F.concat(sure, _apart_from(sure, further))))
    return F.array_sort(apart)


# --- what the votes are worth ---


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """The probability that a span with these votes is personal data, for each pattern of votes.

    Expectation-maximisation for labelers that err independently: the start is
    the majority, then the labelers' rates and the labels are estimated in turn.
    """
    patterns = sorted(counts)
    label = {p: 1 / (1 + math.exp(-sum(p))) for p in patterns}
    for _ in range(rounds):
        total = {y: 1.0 for y in (0, 1)}
        rate = {(k, v, y): 1.0 for k in range(len(LABELERS)) for v in (-1, 0, 1) for y in (0, 1)}
        for p in patterns:
            for y, share in ((1, label[p]), (0, 1 - label[p])):
                total[y] += counts[p] * share
                for k, v in enumerate(p):
                    rate[k, v, y] += counts[p] * share
        for p in patterns:
            score = {
                y: math.log(total[y]) + sum(math.log(rate[k, v, y] / (total[y] + 2)) for k, v in enumerate(p))
                for y in (0, 1)
            }
            label[p] = 1 / (1 + math.exp(max(-500.0, min(500.0, score[0] - score[1]))))
    return label


def _features(votes: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *map(float, votes), float(size == 1), float(size == 2)]


def train_classifier(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = 400) -> list[float]:
    """Logistic weights for one kind; ``rows`` are votes, size class and how many spans have both."""
    counts: dict[tuple[int, ...], int] = {}
    for votes, _, n in rows:
        counts[votes] = counts.get(votes, 0) + n
    label = reliabilities(counts)
    data = [(_features(votes, size), label[votes], n) for votes, size, n in rows]
    weights, total = [0.0] * len(data[0][0]), sum(n for _, _, n in data)
    for _ in range(rounds):
        slope = [0.0] * len(weights)
        for x, y, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
            for k, value in enumerate(x):
                slope[k] += n / total * (p - y) * value
        weights = [w - 0.5 * (s + 0.001 * w) for w, s in zip(weights, slope)]
    return weights


def span_classifier(counted: list[tuple]) -> dict[int, list[float]]:
    """Weights by kind, from rows of kind, votes, size and count."""
    rows = sorted((r[0], tuple(r[1:5]), r[5], r[6]) for r in counted)
    return {
        kind: train_classifier([(votes, size, n) for _, votes, size, n in part])
        for kind, part in groupby(rows, key=lambda r: r[0])
    }


def accepted(span: Column, weights: dict[int, list[float]]) -> Column:
    """The classifier as an expression; base spans are always accepted."""
    score = F.lit(-1.0)
    for kind, w in weights.items():
        value = F.lit(w[0])
        for k, name in enumerate(LABELERS):
            value = value + w[k + 1] * span[name]
        value = value + F.when(span["size"] == 1, w[-2]).when(span["size"] == 2, w[-1]).otherwise(0.0)
        score = F.when(span["kind"] == kind, value).otherwise(score)
    return span["base"] | (score > 0)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row.

    The counts and the checksum are about base spans; ``spans`` has all. Null
    and empty texts have none. Rows are handled one by one, so repeated and
    null ids and other columns make no difference; an empty table stays empty.
    Nothing is shuffled but the counts of vote patterns.
    """
    text = whole_text(F.col("text"))
    none = F.filter(candidates(F.lit("")), lambda s: F.lit(False))
    spans = F.when(text.rlike(MAY_HOLD), candidates(text)).otherwise(none)
    found = cut_lineage(docs.select("doc_id", spans.alias("found")))
    votes = ["kind", *LABELERS, "size"]
    counted = (
        found.where(F.size("found") > 0).select(F.inline("found")).groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    return describe(found, span_classifier([tuple(r) for r in counted]))


def describe(found: DataFrame, weights: dict[int, list[float]]) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
        return F.array_join(one, ",")

    out = found.withColumn("found", F.filter("found", lambda s: accepted(s, weights))).withColumn(
        "_base", F.filter("found", lambda s: s["base"])
    )
    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [
        F.size(F.filter("_base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        (F.size("found") - F.size("_base")).cast("long").alias("n_added"),
    )
