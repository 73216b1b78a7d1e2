"""Archives by entry, paged listings, uploads with commit, versions, hash tables and trees."""

import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, lsh, retrieval
from corpusloom.sources import archives, files, snapshots, uploads, vectors


def listed(spark, folder):
    rows = [(p.name, str(p), p.stat().st_size) for p in sorted(folder.iterdir())]
    return spark.createDataFrame(rows, "rel_path string, uri string, length long")


def make_zip(path, entries, **how):
    with zipfile.ZipFile(path, "w", **how) as out:
        for name, data in entries.items():
            out.writestr(name, data)


@pytest.mark.parametrize("n", [2, 10_000])
def test_archive_by_entry_equals_the_library(spark, tmp_path, n):
    make_zip(tmp_path / "a.zip", {f"app/f{k:05}.txt": f"text {k} " * (k % 50) for k in range(n)}, compression=zipfile.ZIP_DEFLATED)
    groups = archives.entry_groups(listed(spark, tmp_path), group_bytes=20_000)
    assert (groups.count() > 10) == (n > 2)
    read = archives.read_groups(groups, 8)
    rows = read.withColumn("_task", F.spark_partition_id()).collect()
    assert n == 2 or len({r["_task"] for r in rows}) > 4  # several tasks read the one archive
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        want = {i.filename: z.read(i) for i in z.infolist()}
    assert {r["entry_path"]: bytes(r["content"]) for r in rows} == want and len(rows) == n
    assert {r["rel_path"] for r in rows} == {p[4:] for p in want} and not any(r["error"] for r in rows)


def test_archives_that_are_broken(spark, tmp_path):
    make_zip(tmp_path / "flat.zip", {"b.txt": "b", "a.txt": ""})
    make_zip(tmp_path / "empty.zip", {})
    (tmp_path / "no.zip").write_bytes(b"no zip")
    make_zip(tmp_path / "hurt.zip", {"x/one.txt": "1" * 100, "x/two.txt": "2" * 100, "y/three.txt": "3"})
    data = bytearray((tmp_path / "hurt.zip").read_bytes())
    data[data.index(b"2" * 100)] = ord("z")
    (tmp_path / "hurt.zip").write_bytes(data)
    make_zip(tmp_path / "odd.zip", {"x/lzma.txt": "text"}, compression=zipfile.ZIP_LZMA)
    rows = archives.archive_entries(listed(spark, tmp_path)).collect()
    got = {(r["zip_path"], r["entry_path"]): (r["rel_path"], r["content"] and bytes(r["content"]), bool(r["error"])) for r in rows}
    assert got == {
        ("flat.zip", "a.txt"): ("a.txt", b"", False), ("flat.zip", "b.txt"): ("b.txt", b"b", False), ("no.zip", None): (None, None, True),
        ("hurt.zip", "x/one.txt"): ("one.txt", b"1" * 100, False), ("hurt.zip", "x/two.txt"): ("two.txt", None, True),
        ("hurt.zip", "y/three.txt"): (None, b"3", False), ("odd.zip", "x/lzma.txt"): ("lzma.txt", None, True),
    }


def test_directory_and_groups_are_ranges(tmp_path):
    entries = [{"at": k * 10} for k in range(7)]
    groups = list(archives._grouped(entries, 25, 70))
    assert [(a, b, len(g)) for a, b, g in groups] == [(0, 20, 2), (20, 40, 2), (40, 60, 2), (60, 70, 1)]
    assert list(archives._grouped([], 25, 0)) == []


def test_a_folder_is_listed_in_pages(monkeypatch, tmp_path):
    for k in range(25):
        (tmp_path / f"f{k}").write_text("x")
    monkeypatch.setattr(files, "PAGE_ROWS", 10)
    pages = list(files._pages(str(tmp_path)))
    assert [len(p) for p in pages] == [10, 10, 5]
    assert {r for p in pages for r in p} == {(f"f{k}", files.UNKNOWN, False) for k in range(25)}


def test_a_flat_folder_is_asked_by_several_tasks(spark, tmp_path):
    for k in range(3_000):
        (tmp_path / f"f{k}.py").write_bytes(b"x" * (k % 7))
    (tmp_path / "lost.py").symlink_to(tmp_path / "nowhere")
    found = files.list_files(spark, str(tmp_path))
    rows = found.withColumn("_file", F.col("_metadata.file_name")).collect()
    assert {r["rel_path"]: r["length"] for r in rows} == {f"f{k}.py": k % 7 for k in range(3_000)} | {"lost.py": 0}
    assert len({r["_file"] for r in rows}) > 4


def test_inventory_of_a_store(spark):
    keys = ["data/a.py", "data/sub/_b.py", "data/", "data/node_modules/x.js", "other/c.py", "data/sub/"]
    inventory = spark.createDataFrame([(k, len(k)) for k in keys], "key string, size int")
    rows = files.listed_files(inventory, "s3://bucket/data/", "p").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("p", "a.py", "s3://bucket/data/a.py", 9), ("p", "sub/_b.py", "s3://bucket/data/sub/_b.py", 14)
    ]
    assert files.listed_files(inventory, "s3://bucket/data", prune=False).count() == 3
    assert files.listed_files(inventory, "s3://bucket").count() == 3


# --- uploads ---


def contents(spark, uri):
    rows = files.read_contents(uploads.uploaded(spark, uri)).collect()
    assert all(r["length"] == len(r["content"]) for r in rows)
    return {r["rel_path"]: bytes(r["content"]) for r in rows}


def test_upload_and_overwrite(spark, tmp_path):
    uri = str(tmp_path / "up")
    assert uploads.uploaded(spark, uri).count() == 0
    rows = spark.createDataFrame([(f"a\\b//f{k}.txt", f"t{k}") for k in range(50)], "rel_path string, text string")
    uploads.upload(rows.repartition(5), uri)
    assert contents(spark, uri) == {f"a/b/f{k}.txt": b"t%d" % k for k in range(50)}
    uploads.upload(spark.createDataFrame([("a/b/f3.txt", b"new"), ("_x", None)], "rel_path string, content binary"), uri)
    assert contents(spark, uri) == {f"a/b/f{k}.txt": b"t%d" % k for k in range(50)} | {"a/b/f3.txt": b"new", "_x": b""}
    uploads.upload(spark.createDataFrame([("z", "z")], "rel_path string, text string"), uri, "overwrite")
    assert contents(spark, uri) == {"z": b"z"}
    assert [m["files"] for _, m in uploads.manifests(uri)] == [50, 2, 1]


def test_failed_upload_leaves_nothing_visible(spark, tmp_path):
    uri = str(tmp_path / "up")
    uploads.upload(spark.createDataFrame([("a", "old")], "rel_path string, text string"), uri)
    before = sorted(os.listdir(f"{uri}/{uploads.OBJECTS}"))
    rows = [(f"f{k}", "x") for k in range(20)] + [("../out", "x")]
    with pytest.raises(Exception, match="not a relative path"):
        uploads.upload(spark.createDataFrame(rows, "rel_path string, text string").repartition(4), uri)
    assert contents(spark, uri) == {"a": b"old"} and len(uploads.manifests(uri)) == 1
    assert sorted(os.listdir(f"{uri}/{uploads.OBJECTS}")) == before and not (tmp_path / "out").exists()


def test_keys():
    assert [uploads.clean_key(k) for k in ("a/b", "\\a\\\\b", "./a/./b/")] == ["a/b"] * 3
    for bad in ("", "/", "..", "a/../b"):
        with pytest.raises(ValueError):
            uploads.clean_key(bad)


# --- versions ---


def test_versions_append_replace_and_fail(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10)
    assert snapshots.versions(spark, path) == []
    assert [snapshots.commit(rows, path), snapshots.commit(rows, path), snapshots.commit(rows.limit(3), path, "overwrite")] == [1, 2, 3]
    count = lambda v=None: snapshots.load(spark, path, v).count()
    assert [count(1), count(2), count(3), count()] == [10, 20, 3, 3]
    bad = rows.select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("half-way"))).cast("long").alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="half-way"):
            snapshots.commit(bad, path, mode)
    assert snapshots.versions(spark, path) == [1, 2, 3] and count() == 3
    with pytest.raises(ValueError):
        snapshots.load(spark, path, 9)
    snapshots.commit(rows, path)
    assert snapshots.compact(spark, path) == 5 and len(snapshots.parts(spark, path)) == 1 and count() == 13
    assert snapshots.vacuum(spark, path) == 6 and snapshots.versions(spark, path) == [5] and count() == 13


def test_a_number_is_given_once(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(spark.range(1), path)
    assert snapshots._publish(spark, path, 2, {"parts": []}) and not snapshots._publish(spark, path, 2, {"parts": [1]})
    system, claim = snapshots._path(spark, f"{path}/versions/{3:010}.claim")
    system.createNewFile(claim)  # a writer that died with a number
    assert snapshots.commit(spark.range(2), path) == 4 and snapshots.load(spark, path).count() == 2


def test_replacing_vectors_keeps_the_old_ones_until_it_is_done(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(k, "c", [1.0 + k, 0.0], "x") for k in range(4)], "chunk_id long, content string, embedding array<float>, p string")
    made = vectors.vector_documents(rows, {"language": "p"})
    assert vectors.append_vectors(made, path, 2) == 1
    bad = made.withColumn("content", F.raise_error(F.lit("half-way")).cast("string"))
    with pytest.raises(Exception, match="half-way"):
        vectors.replace_vectors(bad, path, 2)
    assert vectors.load_vectors(spark, path, 2).count() == 4
    assert vectors.replace_vectors(made.where("id = 1"), path, 2) == 2
    assert [vectors.load_vectors(spark, path, 2, version=v).count() for v in (1, 2)] == [4, 1]


# --- hash tables ---


def clustered(rng, clusters=40, each=50, width=24):
    centres = rng.normal(size=(clusters, width)) * 4
    return np.repeat(centres, each, axis=0) + rng.normal(size=(clusters * each, width)) * 0.3


def test_hash_tables_find_most_neighbours_among_few_candidates(spark):
    x = clustered(np.random.default_rng(3))
    x[100:700] = x[100]  # a third of all vectors are the same
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    queries, names = rows.where("vec_id % 50 = 0"), {"query_id": "vec_id", "doc_id": "vec_id"}
    exact = retrieval.nearest(queries, rows, 10, **names)
    shares = {}
    for probes in (0, 2):
        found = lsh.approximate_nearest(queries, rows, 10, probes=probes, **names).cache()
        share = lsh.recall(found, exact, 10).agg(F.avg("recall")).first()[0]
        candidates = found.where("query_id >= 700").select("query_id", "candidates").distinct().agg(F.avg("candidates")).first()[0]
        shares[probes] = share
        assert candidates < 0.2 * len(x)
        wrong = found.join(exact.select("query_id", "doc_id", F.col("distance").alias("_d")), ["query_id", "doc_id"])
        assert wrong.where("abs(distance - _d) > 1e-6").isEmpty()
        found.unpersist()
    assert shares[2] >= shares[0] and shares[2] >= 0.9


def test_buckets_follow_the_formula(spark):
    how = lsh.Projections(3, 2, 0.5)
    x = np.random.default_rng(1).normal(size=(20, 5))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    cell = np.floor(x @ how.matrix(5) / 0.5 + how.shift()).astype(int).reshape(20, 3, 2)
    want = {(k, t, ",".join(map(str, cell[k, t]))) for k in range(20) for t in range(3)}
    got = [(r["id"], r["table"], r["bucket"]) for r in lsh.bucketed(rows, "id", "v", how).collect()]
    assert set(got) == want and len(got) == 60
    probed = {(r["id"], r["table"], r["bucket"]) for r in lsh.bucketed(rows, "id", "v", how, probes=4).collect()}
    assert want < probed and len(probed) == 60 * 5  # with all four neighbours of a bucket of two intervals
    one = rows.limit(1)
    assert lsh.fit_length(one, how, 3, "v") == how
    assert lsh.approximate_nearest(one.limit(0), rows, 3, how, "id", "v", "id", "v").count() == 0


# --- trees and components ---


def walk(parents):
    out = {}
    for node in parents:
        at, depth, seen = node, 0, {node}
        while parents.get(at) is not None:
            at, depth = parents[at], depth + 1
            if at in seen:
                at = None
                break
            seen.add(at)
        out[node] = (at, depth if at is not None else None, at is None)
    return out


@pytest.mark.parametrize("salt", [500_000, 3])
def test_tree_to_root(spark, salt):
    r = random.Random(salt)
    parents = {k: r.choice([None, r.randrange(300), k // 2, 7, 1000]) for k in range(200)}
    parents |= {k: k - 1 for k in range(400, 600)} | {400: None, 650: 650, 651: 650, 660: 661, 661: 662, 662: 660}
    rows = spark.createDataFrame(list(parents.items()), "id long, parent long")
    found = graph.tree_to_root(rows, rows_per_salt=salt).collect()
    assert {x["id"]: (x["root"], x["depth"], x["cyclic"]) for x in found} == walk(parents) and len(found) == len(parents)


def test_tree_to_root_in_few_rounds_and_apart(spark, monkeypatch):
    rounds, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    n = 300
    rows = spark.createDataFrame([(p, k, k - 1 if k else None) for p in "ab" for k in range(n if p == "a" else 3)], "p string, id int, parent int")
    found = {(x["p"], x["id"]): (x["root"], x["depth"]) for x in graph.tree_to_root(rows, keep=("p",)).collect()}
    assert found == {("a", k): (0, k) for k in range(n)} | {("b", k): (0, k) for k in range(3)}
    assert len(rounds) <= 2 + n.bit_length()
    assert graph.tree_to_root(rows.limit(0)).count() == 0


@pytest.mark.parametrize("salt", [500_000, 5])
def test_components_with_hubs_and_lone_nodes(spark, salt):
    links = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 160)] + [(200, 59), (300, 301)]
    rows = spark.createDataFrame(links, "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in (5, 5, 100, 999)], "node long")
    found = {r["node"]: r["class"] for r in graph.connected_components(rows, nodes, salt).collect()}
    assert found == {k: 0 for k in range(60)} | {200: 0, 300: 300, 301: 300, 999: 999} | {k: 100 for k in range(100, 161)}
    assert graph.connected_components(rows.limit(0)).count() == 0
