import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ODD_TEXTS, documents

from corpusloom.llm import setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:]))


def brute_force(ids, texts, num=90, den=100):
    """All pairs, united one by one."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    smallest = {}
    for k, i in enumerate(ids):
        r = root(k)
        known = [x for x in (smallest.get(r), i) if x is not None]
        smallest[r] = min(known) if known else None
    return sorted(((i, len(s), smallest[root(k)]) for k, (i, s) in enumerate(zip(ids, sets))), key=str)


def found(docs, **how):
    rows = setjoin.similar_sets(docs, **how).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def near_texts(seed, n=400):
    """Groups of copies, chains of copies of copies, texts at the very threshold, passages shared by many."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(25)]
    originals = [[word() for _ in range(r.choice([20, 60, 150, 300]))] for _ in range(25)]
    out = [" ".join(o) for o in originals]
    while len(out) < n:
        words = list(r.choice(originals[:6] if r.random() < 0.6 else originals))
        if r.random() < 0.2:
            words = out[r.randrange(len(out))].split()
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            k = r.randrange(len(words))
            words[k : k + r.randrange(2)] = [word()] * r.randrange(3)
        if r.random() < 0.2:
            words += passage
        out.append(" ".join(words))
    return out


# a group with a third of all rows, of loosely similar texts
def loose_group(n=120):
    r = random.Random(5)
    base = [f"b{k}" for k in range(70)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(len(words))] = f"x{r.randrange(30)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, setjoin.BLOCK), (2, 8)])
def test_components_equal_all_pairs(spark, seed, block):
    texts = near_texts(seed) + loose_group() + ODD_TEXTS
    ids = random.Random(seed).sample(range(10_000), len(texts))
    assert found(documents(spark, texts, ids), block=block) == brute_force(ids, texts)


def test_without_families(spark):
    """Everything by lists and whole sets, and everything by families, give the same."""
    texts = near_texts(3, 150) + loose_group(40)
    docs, want = documents(spark, texts), brute_force(range(len(texts)), texts)
    assert found(docs, family=(90, 100)) == want
    assert found(docs, family=(30, 100)) == want


def test_at_the_threshold(spark):
    """19 common of 19 + 1 + 1 is below 0.9, of 20 + 1 is above."""
    base = [f"t{k}" for k in range(21)]  # 19 n-grams
    texts = [" ".join(base), " ".join(base + ["a"]), " ".join(base + ["b"]), " ".join(base + ["b", "c"]), " ".join(base[1:])]
    assert found(documents(spark, texts)) == brute_force(range(5), texts)
    assert found(documents(spark, texts), similarity=(95, 100)) == brute_force(range(5), texts, 95)


def test_case_repeated_rows_and_null_ids(spark):
    texts = ["A b C d", "a B c D", "É b", "é b", None, "", " \t", "x", "X", "x", "x y", "y x"]
    ids = [7, 7, 3, 2, 1, None, None, None, None, 5, None, None]
    assert found(documents(spark, texts, ids)) == brute_force(ids, texts)


def test_no_rows(spark):
    docs = documents(spark, ["a"])
    empty = setjoin.similar_sets(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(documents(spark, [None, ""])) == [(0, 0, 0), (1, 0, 1)]


def test_words_that_sums_confuse(spark):
    """Thue-Morse words and their complements have equal polynomial hashes, but are different words."""
    morse = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    texts = [f"{morse} x y", f"{other} x y", f"{morse} x y"]
    assert found(documents(spark, texts)) == brute_force(range(3), texts)


def test_long_text(spark):
    words = [f"w{k % 50_021}" for k in range(400_000)]
    texts = [" ".join(words), " ".join(words[:390_000] + ["z"] * 500), "short"]
    assert found(documents(spark, texts)) == brute_force(range(3), texts)


def test_histograms_never_differ_by_more_than_the_sets():
    r = np.random.default_rng(8)
    sets = []
    for n in (1, 40, 1200, 1290, 1300, 2500, 2600, 5000):
        base = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (1.0, 0.95, 0.5):
            sets.append(np.unique(np.concatenate([base[: int(n * share)], r.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)])))
    shapes = setjoin.Histograms([setjoin._histogram(s).tobytes() for s in sets])
    i, j = np.array([(a, b) for a in range(len(sets)) for b in range(len(sets)) if max(shapes.length[[a, b]]) <= 2 * min(shapes.length[[a, b]])]).T
    apart, bins = shapes.apart(i, j)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (apart <= true).all() and (apart[i == j] == 0).all() and set(bins.tolist()) >= {16, 32, 64}
    assert (apart > 0.3 * true).mean() > 0.5


@pytest.mark.parametrize("skip", [1, 3, 16])
def test_list_pairs_leave_out_nothing(monkeypatch, skip):
    monkeypatch.setattr(setjoin, "SKIP", skip)
    monkeypatch.setattr(setjoin, "PAIRS", 32)
    r = np.random.default_rng(skip)
    rows = {"list": np.sort(r.integers(0, 6, 200)), "n": r.integers(5, 60, 200), "pos": r.integers(0, 5, 200)}
    order = np.lexsort((rows["n"], rows["list"]))
    rows = {c: v[order] for c, v in rows.items()}
    got = {(int(i), int(j)) for a, b in setjoin.list_pairs(rows, (90, 100)) for i, j in zip(a, b)}
    want = set()
    for i in range(200):
        for j in range(i + 1, 200):
            n, m = int(rows["n"][i]), int(rows["n"][j])
            behind = min(n - rows["pos"][i], m - rows["pos"][j])
            if rows["list"][i] == rows["list"][j] and 10 * n >= 9 * m and 19 * behind >= 9 * (n + m):
                want.add((i, j))
    assert got == want


@pytest.mark.parametrize("blocks", [1, 2])
def test_a_family_of_classes_is_linked_without_all_its_pairs(blocks):
    """Forty sets that link with each other and not with their representative: fewer links than sets."""
    n = 40
    own = [np.arange(1, 7, dtype=np.uint64).tobytes()[:-8] + np.uint64(100 + k).tobytes() for k in range(n)]
    table = pa.table({
        "family": [0] * (n + 1), "node": range(n + 1), "n": pa.array([100] * (n + 1), pa.int32()), "class": range(n + 1),
        "home": [0] * (n + 1), "block": pa.array([k % blocks for k in range(n + 1)], pa.int32()),
        "difference": pa.array([None, *own], pa.binary()),
    })
    keys = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    parts = [setjoin._derived((97, 100))(tuple(map(pa.scalar, (0, *k))), table) for k in keys]
    links = [(a, b) for p in parts for a, b in zip(*p.to_pydict().values())]
    reached = {1}
    while more := {x for link in links if reached & {*link} for x in link} - reached:
        reached |= more
    assert reached == {*range(1, n + 1)} and len(links) < n * len(keys)
