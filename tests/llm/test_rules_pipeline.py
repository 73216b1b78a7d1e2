import random
import re
from collections import Counter

import pytest
from fixtures import ODD_TEXTS, documents
from test_near import brute_classes
from test_sharding_mixing import brute_copies

from corpusloom.llm import packing, rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in rules.SYMBOLS for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }


def texts_for_statistics():
    rng = random.Random(3)
    few = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(40)]
    lines = ["\n".join(rng.choice(["one two", " ", "", "three\r", "four"]) for _ in range(rng.randrange(12))) for _ in range(20)]
    return ODD_TEXTS + few + lines + ["la " * 60, "#a$ %b& |<>" * 9, "x" * 20000 + " y z " * 3000]


def test_statistics_against_brute_force(spark):
    texts = texts_for_statistics()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = rules.quality_digest(documents(spark, texts), labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_statistics(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, texts[r["doc_id"]][:60]
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)


def junk(rng, k):
    words = [f"w{rng.randrange(500)}" for _ in range(80)]
    return " ".join(w.upper() + "!!" for w in words) if k % 2 else " ".join(w + "###" for w in words)


def labelled(rng, n):
    good = [" ".join(f"word{rng.randrange(2000)}" for _ in range(80)) + "." for _ in range(n)]
    texts = good + [junk(rng, k) for k in range(n // 4)]
    return texts, [1] * n + [0] * (n // 4)


def test_learned_rules_hold_on_other_texts(spark):
    rng = random.Random(8)
    texts, quality = labelled(rng, 400)
    held, held_quality = labelled(rng, 200)
    docs = documents(spark, texts + held)
    rows = [(k, q, 0) for k, q in enumerate(quality)] + [(0, None, 0), (None, 0, 0), (3, 0, 1), (3, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in rules.quality_digest(docs, labels).collect()}
    right = [out[len(texts) + k]["kept"] == (q == 1) for k, q in enumerate(held_quality)]
    assert sum(right) >= 0.98 * len(right)
    assert {r["rule"] for r in out.values()} - {None, "base"}
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, r in out.items() if r["kept"])


def test_accuracy_on_held_out_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = rules.quality_digest(docs, train).join(test, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.98 * len(good)
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)


def test_learning_alone():
    rows = [({f: 0.0 for f in rules.FEATURES} | {"symbol_share": k / 100, "digit_share": (k * 7 % 10) / 10}, k >= 60) for k in range(100)] * 3
    learned = rules.learn_rules(rows)
    assert learned and learned[0].conditions[0].feature == "symbol_share"
    assert rules.learn_rules([]) == [] and rules.learn_rules([(rows[0][0], True)] * 5) == []


def test_no_rows_and_repeated_ids(spark):
    docs = documents(spark, ["a b"] * 3, ids=[1, 1, None])
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(rules.quality_digest(docs, labels).collect()) == 3
    assert rules.quality_digest(docs.limit(0), labels).count() == 0
    assert rules.keep_good(docs.limit(0), labels.limit(0)).count() == 0


# --- the pipeline ---


def test_pipeline_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randrange(55, 120))] for _ in range(60)]
    texts = [" ".join(w) for w in base] + ODD_TEXTS
    texts += [" ".join(base[k][:30] + ["changed"] + base[k][31:]) for k in range(20)]  # near copies
    texts += ["\n".join(base[k]) for k in range(25)] + [junk(rng, k) for k in range(40)]
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(70)) for _ in range(60)]
    is_junk = [t.count("!!") + t.count("###") > 50 for t in map(str, texts)]
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 0 if j else 1, 0) for k, j in enumerate(is_junk)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()

    stay = [k for k, t in enumerate(texts) if not is_junk[k] and (s := brute_statistics(t))["n_words"] >= 50
            and 2 * s["n_repeat_words"] <= s["n_words"]]
    groups = {}
    for k in stay:
        plain = re.sub(r"[\x20\x09-\x0D]", "", texts[k])
        groups[plain] = min(groups.get(plain, (0, k)), (-len(texts[k]), k))
    stay = sorted(k for _, k in groups.values())
    stay = [k for k, c in zip(stay, brute_classes([texts[k] for k in stay])) if stay[c] == k]
    share = Counter(f"s{k % 3}" for k in stay)
    power = sum(n**0.5 for n in share.values())
    want = {}
    for k in stay:
        n = share[f"s{k % 3}"]
        if copies := brute_copies(k, texts[k], len(stay) * n**0.5 / power / n):
            want[k] = copies
    found = Counter()
    for r in rows:
        found[r["doc_id"]] += 1
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert found == Counter({k: c * len(packing.binary_pieces(tokens[k])) for k, c in want.items()})
    assert len(want) > 60 and len(pipeline.STAGES) == 5


def test_every_stage_on_empty_tables_and_with_clashing_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, ["a b", None, "a b", ""])  # its further columns are called like those of results
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 4
    assert pipeline.run(spark, str(tmp_path)).count() == 0
