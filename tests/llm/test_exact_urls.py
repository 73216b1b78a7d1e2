import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ODD_TEXTS, documents
from pyspark.sql import functions as F

from corpusloom.llm import common, exact, near, packing, urls

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {
        content: (min(rows)[3], len(rows), hashlib.sha256(content.encode()).hexdigest())
        for content, rows in groups.items()
    }


TEXTS = ODD_TEXTS + ["same", "s a m e", "sam\te ", "copy " * 30] + ["copy " * 30] * 200 + [f"own {k} " * 9 for k in range(150)]


@pytest.mark.parametrize(("room", "fan_out"), [(48 << 20, 4000), (3000, 4000), (60, 4000), (3000, 2), (60, 3)])
def test_groups_against_brute_force(spark, room, fan_out):
    """One level, several levels, and more buckets than partitions."""
    ids = [None if k % 41 == 0 else 1000 - k for k in range(len(TEXTS))]
    want = brute(TEXTS, ids)
    docs = documents(spark, TEXTS, ids)
    rows = exact.exact_copies(docs, carry=True, table_bytes=room, bucket_bytes=room, fan_out=fan_out).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[SPACE.sub("", r["_row"]["text"] or "")]
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert kept == Counter({sha: 1 for _, _, sha in want.values()})
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_rows_that_are_there_twice(spark):
    docs = documents(spark, ["a b"] * 3 + ["ab", None, ""], ids=[5, 5, 7, 1, None, None])
    rows = exact.exact_copies(docs).collect()
    assert sorted((r["keep_id"] or -1, r["group_size"], r["kept"]) for r in rows) == [
        (-1, 2, False), (-1, 2, True), (5, 4, False), (5, 4, False), (5, 4, False), (5, 4, True),
    ]
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    assert exact.exact_copies(docs.limit(0)).count() == 0


def test_table_compares_contents_of_equal_hashes():
    table = exact.ContentTable(1 << 20)
    for k in range(200):
        assert table.add(7, b"content %d" % (k % 50), [1, 3, k, 1])
    assert sorted(table.contents) == sorted({b"content %d" % k for k in range(50)})
    assert all(f[0] == 4 and f[2] == int(c.split()[1]) for c, f in zip(table.contents, table.facts))
    full = exact.ContentTable(10)
    assert full.add(1, b"x" * 100, [1, 1, 1, 1]) and not full.add(2, b"y", [1, 1, 1, 1])
    assert full.add(1, b"x" * 100, [1, 1, 1, 1])


def test_late_copies_leave_a_task_once_for_each_filling():
    contents = [b"own %04d" % k for k in range(300)] + [b"late"] * 500
    ones = pa.array([1] * len(contents), pa.int64())
    numbers = pa.array(range(len(contents)), pa.int64())
    hashes = pa.array([hash(c) for c in contents], pa.int64())
    names = ["h", "content", "n", "best_length", "best_id", "n_best", "digest"]
    columns = [hashes, pa.array(contents), ones, ones, numbers, ones, pa.nulls(len(contents), pa.binary())]
    sent = exact._through_table(5000, finish=False)(iter([pa.record_batch(columns, names)]))
    found = [(r["content"], r["n"]) for b in sent for r in b.to_pylist()]
    assert sorted(found) == [(b"late", 500), *((c, 1) for c in contents[:300])]


def test_batches_to_a_worker_are_small_while_something_is_written(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    docs = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with common.batch_bytes(spark, 1 << 19):
        small = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        with common.batch_bytes(spark, 1 << 20):  # the smaller one stays
            assert int(spark.conf.get(name)) == 1 << 19
    assert max(small) < 1 << 20 and sum(small) > 4_000_000
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("run", [exact.exact_copies, packing.packing_digest])
def test_texts_are_written_in_small_batches(spark, monkeypatch, run):
    limits = []
    for module in (exact, common):
        def write(df, then=module.cut_lineage):
            limits.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
            return then(df)

        monkeypatch.setattr(module, "cut_lineage", write)
    run(documents(spark, ["a b", "c"] * 20)).collect()
    assert limits[0] == str(8 << 20)


def test_texts_are_packed_in_parts(monkeypatch):
    seen = []

    class Watched:
        def ids(self, texts):
            seen.append(texts.nbytes)
            return np.zeros(len(texts), np.uint32), np.arange(len(texts) + 1)

    monkeypatch.setattr(packing, "pieces_of", lambda name: Watched())
    texts = pa.array(["word " * 2000] * 900)  # 9 MB
    batch = pa.record_batch([pa.array(range(900), pa.int64()), texts], ["doc_id", "_text"])
    out = list(packing._decompose("word_bpe_49k.json", 2048, 1)(iter([batch])))
    assert sum(b.num_rows for b in out) == 900 and max(seen) < 3 << 20


def test_no_more_partitions_than_the_fan_out(spark):
    records = spark.range(1000).select(F.col("id").alias("h"))
    assert exact._dealt(records, 3, 8, 0).rdd.getNumPartitions() == 3
    many = exact._dealt(records, 64, 8, 0)
    assert many.rdd.getNumPartitions() == 8
    by_part = defaultdict(list)
    for r in many.withColumn("_part", F.spark_partition_id()).collect():
        by_part[r["_part"]].append(r["bucket"])
    assert all(b == sorted(b) and len(set(b)) == 8 for b in by_part.values()) and len(by_part) == 8


# --- URLs ---

URLS = [
    None, "", "no scheme", "://", "http://", "https://org", "https://ORG/", "http://a.org/x?y#z", "http://org?x/", "http://Example.ORG/es/1",
    "http://www.example.org/es", "http://x.example.org/en/12", "http://notexample.org/en/1", "http://example.org/en/2",
    "http://b.com/fr/a", "http://b.com/de/", "http://b.com/dex", "https://É.com/fr/", "x://y://z.org/", "http://m.bad.net/p/?q=1",
    "http://www.bad.net/p", "http://bad.net/p/x", "http://spam-farm.com/fr/1", "http://spam-farm.net/a/", "HTTP://c.com:80/de/",
    "http://a..com/fr/", "http://.org/", "ftp://u@example.org/es/#",
]
RULES = [*urls.RULES, ("net/zzz", "block"), (None, "block"), ("norule", "block")]
LISTED = ["bad.net/p", None, "bad.net/p"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in RULES:
        if rule and "/" in rule:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), len(h), rule, verdict))
    form = re.sub(r"^(www|m)\.", "", host) + re.sub(r"/+$", "", path)
    rule, verdict = max(fits)[2:] if fits else (None, "block" if host and form in LISTED else "allow")
    return host, path, rule, verdict


def pages(spark, listed=URLS):
    ids = [None if k % 5 == 0 else k // 2 for k in range(len(listed))]
    return spark.createDataFrame(list(zip(ids, listed, ["x"] * len(listed))), "page_id long, url string, host string")


@pytest.mark.parametrize(("most_bytes", "small"), [(64 << 20, 100_000), (64, 100_000), (64, 0)])
def test_urls_against_brute_force(spark, monkeypatch, most_bytes, small):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    many = URLS + [f"http://h{k}.net/p{k}" for k in range(300)]
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    listed = spark.createDataFrame([(u,) for u in LISTED] + [(f"fill{k}.net/",) for k in range(500)], "url string")
    rows = urls.judge_urls(pages(spark, many), rules, listed, most_bytes=most_bytes).collect()
    assert Counter((r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == Counter(map(brute_url, many))


def test_hosts_of_very_many_labels(spark):
    """Only as many last labels as some rule has are looked up."""
    long = ".".join(f"l{k}" for k in range(20_000))
    many = [f"http://{long}.example.org/es/x", f"http://{long}.com/de/", f"http://{long}/", "http://example.org/es/"]
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    rows = urls.judge_urls(pages(spark, many), rules, spark.createDataFrame([], "url string")).collect()
    assert Counter((r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == Counter(map(brute_url, many))


def test_long_lists_are_not_sent(spark, monkeypatch):
    listed = spark.createDataFrame([("x" * 1000,), ("y",)], "url string")
    assert common.is_small(listed, F.octet_length("url"))
    monkeypatch.setattr(common, "SMALL_BYTES", 1000)
    assert not common.is_small(listed, F.octet_length("url"))
    assert common.is_small(listed.limit(0), F.octet_length("url"))


def test_urls_without_rules_lists_or_pages(spark):
    none = pages(spark).limit(0)
    assert urls.url_digest(none).count() == 0
    rules = spark.createDataFrame([], "rule string, verdict string")
    rows = urls.judge_urls(pages(spark), rules, none.select("url")).collect()
    assert len(rows) == len(URLS) and {(r["rule"], r["verdict"]) for r in rows} == {(None, "allow")}


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(0, 2**64 - 1, 20_000, dtype=np.uint64) for _ in range(2))
    blocks = 20_000 * urls.BITS_PER_KEY // 512
    table = np.zeros((blocks, 8), np.uint64)
    np.bitwise_or.at(table, urls._blocks(keys, blocks), urls._words(keys))
    assert urls.may_contain(keys, table).all() and urls.may_contain(others, table).mean() < 0.01


@pytest.mark.parametrize("module", [exact, near])
def test_rows_without_copies_do_not_move(spark, monkeypatch, module):
    met, original = [], module.join_facts
    monkeypatch.setattr(module, "join_facts", lambda rows, *how: met.append(rows.count()) or original(rows, *how))
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(400)]
    docs = documents(spark, [*texts, texts[0], texts[1] + " "])
    kept = exact.drop_copies(docs) if module is exact else near.drop_near_copies(docs)
    assert kept.count() == 400 and kept.columns == docs.columns and met[-1] < 100
