import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from fixtures import ODD_TEXTS, documents

from corpusloom.llm import common, mixing, sharding


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        there = sharding.permute(np.arange(n), n)
        assert sorted(there.tolist()) == list(range(n))
        assert sharding.unpermute(there, n).tolist() == list(range(n))
    assert sharding.permute(np.arange(1000), 1000, 1).tolist() != sharding.permute(np.arange(1000), 1000, 2).tolist()


def test_every_row_has_its_slot(spark):
    texts = ODD_TEXTS * 3
    ids = [None if k % 7 == 0 else k // 2 for k in range(len(texts))]  # null and repeated ids
    rows = sharding.shard_digest(documents(spark, texts, ids)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts)
    )
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) - len(rows) // 8 in (0, 1)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_places_can_be_computed_and_repeat(spark):
    docs = documents(spark, [f"t{k}" for k in range(100)])
    rows = sharding.assign_shards(docs.select("doc_id"), 8, ["doc_id"]).collect()
    places = sharding.permute(np.arange(100), 100)
    assert all((r["shard"], r["slot"]) == (places[r["doc_id"]] % 8, places[r["doc_id"]] // 8) for r in rows)
    again = sharding.assign_shards(docs.repartition(7).select("doc_id"), 8, ["doc_id"]).collect()
    assert sorted(rows) == sorted(again)
    assert sharding.shard_digest(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [f"t{k}" for k in range(100)])
    sharding.write_shards(sharding.assign_shards(docs, 4, ["doc_id"]), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and sorted({r["shard"] for r in back.select("shard").collect()}) == [0, 1, 2, 3]


def brute_copies(doc_id, text, rate):
    digest = hashlib.md5((text or "").encode()).hexdigest()
    who = f"{'' if doc_id is None else doc_id}|{digest}"
    draws, n = max(math.ceil(rate / mixing.RATE_PER_DRAW), 1), 0
    for i in range(1, draws + 1):
        u = int(hashlib.md5(f"{mixing.SEED}|{who}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, upto = 0, math.exp(-rate / draws), math.exp(-rate / draws)
        while upto <= u:
            k += 1
            p *= rate / draws / k
            upto += p
        n += k
    return n


def test_counts_are_inverse_poisson(spark):
    texts = ODD_TEXTS * 4
    ids = [None if k % 9 == 0 else k for k in range(len(texts))]
    sources = [None if k % 4 == 0 else ("big" if k % 2 else f"s{k}") for k in range(len(texts))]
    docs = documents(spark, texts, ids, sources)
    weights = {"big": 0.7, None: 0.2, "s2": 0.05, "absent": 9.0}
    rates = mixing.source_rates(docs, weights=weights, total=1200)
    rate = {r["_source"]: r["rate"] for r in rates.collect()}
    rows = mixing.replicate(docs, rates).collect()
    want = Counter()
    for i, t, s in zip(ids, texts, sources):
        copies = brute_copies(i, t, rate["" if s is None else f"={s}"])
        want.update({(i, t, copies, c): 1 for c in range(copies)} if copies else {})
    assert Counter((r["doc_id"], r["text"], r["copies"], r["copy"]) for r in rows) == want
    assert rate["=s6"] == 0 and abs(rate["=s2"] - 1200 * 0.05 / 0.95) < 1e-9 and mixing.RATE_PER_DRAW > 100
    keys = [r["shuffle_key"] for r in rows]
    assert keys == sorted(keys)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_high_rates_are_drawn_in_parts(spark):
    docs = documents(spark, ["a", "b"], sources=["x", "y"])
    rates = mixing.source_rates(docs, weights={"x": 1.0}, total=3000)
    rows = mixing.replicate(docs, rates).collect()
    assert len(rows) == brute_copies(0, "a", 3000.0) and {r["doc_id"] for r in rows} == {0}


def test_many_sources_are_joined_by_source(spark, monkeypatch):
    docs = documents(spark, [f"t{k}" for k in range(90)], sources=[f"s{k % 30}" for k in range(90)])
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(common, "SMALL_ROWS", 5)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix_sources(docs).collect()) == want


def test_shares_come_near_the_targets(spark):
    docs = documents(spark, [f"t{k}" for k in range(6000)], sources=["a" if k % 3 else "b" for k in range(6000)])
    rows = mixing.mix_sources(docs, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 3000) < 250 for r in rows)
