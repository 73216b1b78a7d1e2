import hashlib
import re
from collections import Counter

from fixtures import ODD_TEXTS, documents

from corpusloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = sorted(
        (m.start(), k, m.end())
        for k, kind in enumerate(pii.KINDS)
        for m in re.finditer(PLAIN[kind], text or "")
        if holds(kind, m.group())
    )
    listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return Counter(k for _, k, _ in spans), hashlib.sha256(listed.encode()).hexdigest(), listed


TEXTS = ODD_TEXTS + [
    "mail a.b+c@x-y.example.com, and é😀 q@r.st.", "a@b.c_d@e.f@g.h x@y @z.w a@b", "a@b.c%d@e.f", "..@-.-", "@a.b",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 1.2.3 9.9.9.9.9", "0000000000000000255.0.0.1",
    "4385344300752002 4385 3443 0075 2002 4385-3443-0075-2002 4385344300752003 1 2 3", "12 34  4385344300752002-1",
    "x4385344300752002y 4385.3443.0075.2002 00000000000000000000", "+1 (483) 555-1712 +49.30.1234567 +1 23 +12345678901234567 ++1-800-555-0199)",
    "call 483-555-1712 now (483) 555-1712", "name [at] host [dot] com", "card 4385 3443 0075 2003", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    "+1 (483) 555-1712 4385344300752002 65.157.240.40 saep.28@mail2.example.com", "1 " * 4000 + "x", "9" * 5000, "a" * 4000 + "@", "a." * 3000 + "@b.c",
    "a@" + "b." * 3000 + "c", "+1" + " " * 3000, "1." * 3000, " ".join(f"{k}.1.2.3 u{k}@h{k}.org" for k in range(700)),
]


def test_base_spans_against_plain_patterns(spark):
    rows = pii.find_personal_data(documents(spark, TEXTS)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        counts, digest, listed = brute(TEXTS[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [counts[k] for k in range(4)], TEXTS[r["doc_id"]][:80]
        assert r["base_sha256"] == digest
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed.split(",")) - {""} <= set(spans)
        assert len(spans) == sum(counts.values()) + r["n_added"]
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_cleaned_texts_have_no_more(spark):
    assert pii.find_personal_data(documents(spark, ["a"]).limit(0)).count() == 0
    rows = pii.find_personal_data(documents(spark, [None, "a 1", "a 1"], ids=[None, 3, 3])).collect()
    assert {r["spans"] for r in rows} == {""} and len(rows) == 3


def test_reliabilities_find_the_labeler_that_guesses():
    import random

    rng, counts = random.Random(3), Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        true = 1 if y else -1
        votes = tuple(true if rng.random() < q else -true for q in (0.95, 0.9, 0.9, 0.5))
        counts[votes] += 1
    label = pii.reliabilities(counts)
    assert label[1, 1, 1, -1] > 0.95 and label[-1, -1, -1, 1] < 0.05
    assert abs(label[1, 1, -1, 1] - label[1, 1, -1, -1]) < 0.15


def test_classifier_learns_from_votes_and_adds_spans(spark):
    good = [f"call {200 + k}-555-{1000 + k} today or +1 {200 + k} 555 {1000 + k}" for k in range(60)]
    bad = [f"version {100 + k}-100-{2000 + k}" for k in range(60)]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, good + bad)).collect()}
    assert sum(rows[k]["n_added"] for k in range(60)) >= 55
    assert sum(rows[k]["n_added"] for k in range(60, 120)) <= 5


def test_overlaps_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = []
    for n in (0, 1, 2, 5, 30, 300, 700):
        for m in (0, 1, 7, 600):
            spans = [[(a, a + r.randrange(1, 9)) for a in (r.randrange(10 * (n + 1)) for _ in range(k))] for k in (n, m)]
            rows.append((len(rows), *spans))
    kind = "array<struct<start: long, end: long>>"
    df = spark.createDataFrame(rows, f"k int, sure {kind}, loose {kind}")
    found = df.select("k", pii._apart_from(F.col("sure"), F.col("loose")).alias("kept")).collect()
    for (_, sure, loose), row in zip(rows, sorted(found, key=lambda x: x["k"])):
        want = [s for s in loose if not any(b[0] < s[1] and s[0] < b[1] for b in sure)]
        assert [tuple(s) for s in row["kept"]] == want


def test_a_text_of_very_many_spans(spark):
    n = 20_000
    text = " ".join(f"u{k}@h.org call 483-555-{k % 10_000:04}" for k in range(n))
    row = pii.find_personal_data(documents(spark, [text])).first()
    assert row["n_email"] == n and row["spans"].count("email") == n
