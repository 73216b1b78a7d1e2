import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import ODD_TEXTS, documents
from pyspark.sql import functions as F

from corpusloom.llm import near


def plain_similarity(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys())
    return total


def test_similarity_against_its_definition():
    rng = random.Random(2)
    for _ in range(50):
        x, y = (Counter({k: rng.randint(1, 4) for k in rng.sample(range(30), 20)}) for _ in range(2))
        assert abs(near.probability_jaccard(x, y) - plain_similarity(x, y)) < 1e-12
    assert near.probability_jaccard(Counter("ab"), Counter("ab")) == 1 and not near.probability_jaccard(Counter(), Counter())


def test_similarity_is_exact_for_sets():
    """216 common of 270 elements are 0.8, not a little less."""
    x, y = Counter(range(242)), Counter([*range(216), *range(1000, 1028)])
    arrays = [tuple(np.array(v, np.int64) for v in zip(*sorted(c.items()))) for c in (x, y)]
    assert near.probability_jaccard(x, y) == near._answer(*arrays)[2] == 0.8


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8):
        hits = []
        for _ in range(40):
            common = rng.integers(1, 1 << 47, 200).astype(np.uint64)
            own = rng.integers(1, 1 << 47, (2, round(200 * (1 - share) / share / 2))).astype(np.uint64)
            weights = rng.integers(1, 4, 200)
            element = np.concatenate([common, own[0], common, own[1]])
            weight = np.concatenate([weights, np.full(own.shape[1], 2), weights, np.full(own.shape[1], 2)])
            text = np.repeat([0, 1], len(common) + own.shape[1])
            found = near.signatures(text, element, weight.astype(float), 2)
            x, y = (Counter(dict(zip(element[text == t].tolist(), weight[text == t].tolist()))) for t in (0, 1))
            hits.append((found[0] == found[1]).mean() - near.probability_jaccard(x, y))
        assert abs(np.mean(hits)) < 0.02


def brute_classes(texts):
    """Class number of each text, by comparing all."""
    shingles = [near.shingles(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or near.probability_jaccard(shingles[i], shingles[j]) >= near.SIMILARITY:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(texts))]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def near_texts(rng):
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = list(ODD_TEXTS)
    base = rng.choices(vocabulary, k=150)
    texts += [" ".join(edited(rng, base, rng.randrange(7))) for _ in range(120)]  # a large, loose group
    for _ in range(25):
        start = rng.choices(vocabulary, k=rng.randrange(6, 200))
        texts.append(" ".join(start))
        for _ in range(rng.randrange(4)):  # chains
            start = edited(rng, start, max(1, len(start) // 60))
            texts.append(" ".join(start))
    texts += [texts[-1], texts[-1] + " ", texts[40]]
    texts += ["all the same words again " * k for k in (8, 9, 10, 30, 31)]
    return texts


@pytest.mark.parametrize("block", [4096, 50])
def test_classes_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(7)
    texts = near_texts(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want = brute_classes(texts)
    rows = near.near_copies(documents(spark, texts, ids), carry=True).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    groups = defaultdict(list)
    for i, c in zip(ids, want):
        groups[c].append(i)
    for members in groups.values():
        for i in members:
            r = by_id[i]
            assert (r["class_id"], r["class_size"], r["kept"]) == (min(members), len(members), i == min(members))
            assert r["_row"]["text"] == texts[ids.index(i)] and r["_row"]["kept"] == "x"


def test_pair_is_proposed_when_an_earlier_band_agrees_by_chance(spark):
    members, sketches = [], []
    for name, first in ((b"x", 11), (b"y", 12), (b"z", 13)):  # all bytes agree, the hashes of the first band do not
        bands = [first, *range(100, 99 + near.BANDS)]
        sketches.append((bytearray(name), bands, bytearray(near.COMPONENTS)))
        members += [(bands[k], k, 3, bytearray(name), bytearray(name)) for k in range(1, near.BANDS)]
    members = spark.createDataFrame(members, "bucket long, band int, size long, node binary, class binary")
    sketches = spark.createDataFrame(sketches, "node binary, bands array<long>, sketch binary")
    found = near.proposed_pairs(members, sketches, 5).collect()
    assert sorted((bytes(r["a"]), bytes(r["b"])) for r in found) == [(b"x", b"y"), (b"x", b"z"), (b"y", b"z")]


@pytest.mark.parametrize("similarity, agreeing", [(0.8, 110), (0.7, 98)])
def test_pair_is_proposed_as_surely_as_it_shares_a_band(spark, similarity, agreeing):
    # so few or fewer are seen with a probability of 5e-4 and 1e-2 at the similarity
    sketches = [bytearray([0] * near.COMPONENTS), bytearray([0] * agreeing + [1] * (near.COMPONENTS - agreeing))]
    rows = [(bytearray(name), [7] * near.BANDS, sketch) for name, sketch in zip((b"x", b"y"), sketches)]
    members = [(7, 0, 3, name, name) for name, _, _ in rows]
    members = spark.createDataFrame(members, "bucket long, band int, size long, node binary, class binary")
    sketches = spark.createDataFrame(rows, "node binary, bands array<long>, sketch binary")
    assert near.proposed_pairs(members, sketches, 5, similarity).count() == 1


def test_equal_texts_are_grouped_before_they_are_sent(spark, monkeypatch):
    plans, cut = [], near.cut_lineage

    def seen(df, *args, **options):
        if df.columns == ["node", "text"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *args, **options)

    monkeypatch.setattr(near, "cut_lineage", seen)
    text = " ".join(f"w{k}" for k in range(60))
    assert near.near_copies(documents(spark, [text] * 9 + [text + " more"])).where("class_size = 10").count() == 10
    (plan,) = plans
    assert plan.index("Join") < plan.index("partial_first")  # the join is above the first step of the grouping


def test_a_node_with_many_pairs_is_split_on_either_side(spark, monkeypatch):
    monkeypatch.setattr(near, "ROWS_PER_SALT", 4)
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        names = [bytearray(b"%02d" % k) for k in range(41)]
        texts = spark.createDataFrame([(n, "the same words in every one") for n in names], "node binary, text string")
        for pairs in ([(names[0], n) for n in names[1:]], [(n, names[40]) for n in names[:40]]):
            pairs = spark.createDataFrame(pairs, "a binary, b binary")
            found = near.verified(pairs, texts, 0.8).select("a", "b", F.spark_partition_id().alias("task")).collect()
            assert len({(bytes(r["a"]), bytes(r["b"])) for r in found}) == len(found) == 40
            assert len({r["task"] for r in found}) > 1
    finally:
        for k in options:
            spark.conf.unset(k)


def test_similarity_from_differences():
    """Between two members of a family it follows from their differences to the central text."""
    rng = random.Random(4)
    for _ in range(60):
        centre = Counter({k: rng.randint(1, 3) for k in range(40)})
        members = []
        for _ in range(2):
            m = Counter(centre)
            for _ in range(rng.randrange(12)):
                k = rng.randrange(50)
                m[k] = max(0, m[k] + rng.choice([-3, -1, 1, 2]))
            members.append(+m)
        arrays = [tuple(np.array(x) for x in zip(*sorted(c.items()))) for c in (centre, *members)]
        answers = [near._answer(arrays[0], (m[0].astype(np.uint64), m[1])) for m in arrays[1:]]
        for m, a in zip(members, answers):
            assert a[:2] == (centre.total(), m.total()) and abs(a[2] - plain_similarity(centre, m)) < 1e-12
        table = tuple([a[c] for a in answers] for c in (3, 4, 5))
        assert abs(near._between(centre.total(), table, 0, 1) - plain_similarity(*members)) < 1e-12


def test_a_loose_group_needs_no_pairs(spark, monkeypatch):
    """Members of one family that are not linked to its central text are compared inside the family."""
    proposed, original = [], near.proposed_pairs
    monkeypatch.setattr(near, "proposed_pairs", lambda *a, **k: proposed.append(original(*a, **k)) or proposed[-1])
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)] * 3 + [" ".join(edited(rng, base, 1 + k % 5)) for k in range(150)]
    rows = near.near_copies(documents(spark, texts)).collect()
    want = brute_classes(texts)
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(want)) and len(set(want)) > 5
    assert sum(p.count() for p in proposed) < 300


def test_a_pair_alone_in_its_bucket_is_compared(spark):
    """Both lie in larger buckets too, whose central texts are others; a later bucket leaves the pair to the first."""
    words = [f"w{k}" for k in range(100)]
    texts = {b"x": " ".join(words), b"y": " ".join([*words, "z"])}
    texts |= {n: " ".join(f"{n.decode()}{k}" for k in range(60)) for n in (b"p1", b"p2", b"q1", b"q2")}
    shared = {b"x": {0: 1, 1: 2, 9: 8}, b"y": {0: 1, 1: 3, 9: 8}, b"p1": {1: 2, 2: 4, 3: 5, 9: 8}, b"p2": {1: 2, 2: 4, 3: 5}}
    shared |= {b"q1": {1: 3, 2: 6, 3: 7}, b"q2": {1: 3, 2: 6, 3: 7}}
    rng = np.random.default_rng(3)
    alike = rng.bytes(near.COMPONENTS)
    nodes = [
        (n, [shared[n].get(k, 1000 * (1 + i) + k) for k in range(near.BANDS)], alike if n in (b"x", b"y") else rng.bytes(near.COMPONENTS))
        for i, n in enumerate(texts)
    ]
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts.items())], "doc_id long, node binary, _text string")
    got = near.near_links(rows, spark.createDataFrame(nodes, "node binary, bands array<long>, sketch binary"), 0.8)
    assert {bytes(r["node"]): bytes(r["class"]) for r in got.collect()} == {b"x": b"x", b"y": b"x"}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = documents(spark, [text, text, text + " more", None, "", text], ids=[3, 3, None, None, None, 8])
    rows = near.near_copies(docs).collect()
    assert sorted((r["class_id"] or -1, r["class_size"], r["kept"]) for r in rows) == [
        (-1, 2, False), (-1, 2, True), (3, 4, False), (3, 4, False), (3, 4, False), (3, 4, True),
    ]
    assert near.drop_near_copies(docs).count() == 2 and near.drop_near_copies(docs).columns == docs.columns
    assert near.near_copies(docs.limit(0)).count() == 0
