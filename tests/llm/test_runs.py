import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import ODD_TEXTS, documents

from corpusloom.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(words, least=12):
    """Every maximal stretch with every period; of equal stretches the smallest period."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def plant(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapse(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(doc_id, text):
    words = plant(doc_id, WORD.findall(text or ""))
    found = brute_force(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, found).encode()).hexdigest(),
    )


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def made():
    r = random.Random(3)
    for letters in (1, 2, 3, 5):
        for n in (0, 1, 2, 11, 12, 13, 40, 131):
            yield [r.randrange(letters) for _ in range(n)]
    for n in (24, 50, 200):
        yield fibonacci(n)
        yield [i.bit_count() & 1 for i in range(n)]
        p = r.randrange(1, n // 3)
        yield [i % p for i in range(n)]
        yield [0] * n + [1] + [0] * n
        yield ([0, 1] * n)[: n - 1] + ([0, 1] * n)[: n + 2]
    for _ in range(60):  # a few repeated parts at chance places
        x = []
        while len(x) < 90:
            x += [r.randrange(4) for _ in range(r.randrange(1, 9))] * r.randrange(1, 7)
        yield x


def test_equals_brute_force(monkeypatch):
    for cells in (1, 64, runs.CELLS):
        monkeypatch.setattr(runs, "CELLS", cells)
        for least in (2, 12):
            for x in made():
                found = zip(*(c.tolist() for c in runs.find_runs(np.array(x, np.int64), len(x), least)))
                assert [(a, b - a, q) for a, b, q in found] == brute_force(x, least), x


def test_hashes_are_not_trusted(monkeypatch):
    """With hashes that are all equal, or made of a two-valued word, the words decide."""
    x = [i % 7 for i in range(60)]
    monkeypatch.setattr(runs, "mix", lambda v: np.zeros_like(v))
    found = zip(*(c.tolist() for c in runs.find_runs(np.array(x, np.int64), len(x))))
    assert {(a, b - a, q) for a, b, q in found} <= set(brute_force(x))


def test_sum_hashes_that_collide():
    """A Thue-Morse word and its complement have the same running-sum hash, but are no repetition."""
    word = [i.bit_count() & 1 for i in range(2048)]
    x = np.array(word + [1 - w for w in word], np.int64)
    found = zip(*(c.tolist() for c in runs.find_runs(x, len(x))))
    assert all((x[a : b - q] == x[a + q : b]).all() for a, b, q in found)


TEXTS = ODD_TEXTS + [
    "x " * 700, "a b c " * 9 + "d " + "a b c " * 5, " ".join(map(str, fibonacci(300))), "new\nline\n" * 20,
    " ".join(str(k * k % 61) for k in range(400)), "é ü " * 30, "Ab ab " * 10,
]


def test_digest_equals_brute_force(spark):
    texts = TEXTS * 6
    rows = runs.runs_digest(documents(spark, texts)).collect()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows[0].asDict().keys() == {"doc_id", *names}
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in rows} == {k: digest(k, t) for k, t in enumerate(texts)}


def test_repeated_and_null_ids_and_no_rows(spark):
    docs = documents(spark, ["a " * 20, "a " * 20, None, "b c " * 9], ids=[1, 1, None, None])
    rows = runs.periodic_runs(docs).collect()
    found = sorted((r["doc_id"] or -1, r["collapsed"], [tuple(x) for x in r["runs"]]) for r in rows)
    assert found == [(-1, "", []), (-1, "b c", [(0, 18, 2)]), (1, "a", [(0, 20, 1)]), (1, "a", [(0, 20, 1)])]
    assert runs.runs_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("of", ["same ", "k%d "])
def test_very_long_text(spark, of):
    n = 300_000
    text = of * n if "%" not in of else "".join(of % (k % 70_000) for k in range(n))
    row = runs.periodic_runs(documents(spark, [text])).first()
    assert [tuple(x) for x in row["runs"]] == [(0, n, 1 if "%" not in of else 70_000)]
