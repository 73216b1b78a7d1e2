"""Operators on small frames, against hand-written rows or brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import (
    chunks, corpus, diagrams, graph, imports, merging, retrieval, rules, skew, summaries, symbols,
)
from corpusloom.plans.analysis import project_graph


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- chunks ---


def test_line_chunks_cover_all_lines_once(spark):
    text = "\n".join(f"line {i:03d} " + "x" * 20 for i in range(300))
    df = frame(spark, [("a", text), ("e", ""), ("s", "one")], "k string, text string")
    rows = chunks.line_chunks(df, ["k"], max_tokens=100, summary=None).orderBy("k", "chunk_index").collect()
    mine = [r for r in rows if r.k == "a"]
    assert mine[0].start_line == 1 and mine[-1].end_line == 300
    assert all(b.start_line == a.end_line + 1 for a, b in zip(mine, mine[1:]))
    assert "\n".join(r.content for r in mine) == text
    assert [(r.content, r.start_line, r.end_line) for r in rows if r.k == "e"] == [("", 1, 1)]


def test_very_long_line_is_split_and_nothing_is_lost(spark):
    text = "short\n" + "y" * 5000 + "\nend"
    df = frame(spark, [("a", text)], "k string, text string")
    rows = chunks.line_chunks(df, ["k"], max_tokens=100, summary=None).orderBy("chunk_index").collect()
    assert max(r.token_count for r in rows) <= 100
    assert "".join(r.content for r in rows).replace("\n", "") == text.replace("\n", "")
    assert {r.start_line for r in rows if r.content.startswith("yy")} == {2}


def test_store_chunks_choose_by_size(spark):
    df = frame(spark, [("s", "a\nb\n"), ("l", "row\n" * 100)], "k string, text string")
    rows = chunks.store_chunks(df, ["k"], small=50, max_tokens=40).collect()
    small = [r for r in rows if r.k == "s"]
    assert [(r.content, r.start_line, r.end_line, r.is_chunk) for r in small] == [("a\nb\n", 1, 3, False)]
    large = [r for r in rows if r.k == "l"]
    assert len(large) > 1 and all(r.content.startswith("File Summary:\nSummary unavailable.\n") for r in large)


def test_chunks_need_no_shuffle(spark):
    df = frame(spark, [("a", "b")], "k string, text string")
    assert "Exchange" not in plan_of(chunks.store_chunks(df, ["k"]))


# --- corpus ---


def test_decode_and_probe(spark):
    rows = [(1, "grün".encode()), (2, "grün".encode("latin-1")), (3, b""), (4, ("ä" * 3000).encode())]
    df = frame(spark, rows, "id int, content binary")
    got = {r.id: (r.t, r.ok) for r in df.select(
        "id", corpus.decode_text("content").alias("t"), corpus.probe_utf8("content").alias("ok")).collect()}
    assert got[1] == ("grün", True) and got[2] == ("grün", False)
    assert got[3] == ("", True) and got[4] == ("ä" * 3000, True)


def test_select_files(spark):
    paths = ["a.py", "x.css", "node_modules/b.py", "node_modules/w.xlsm", "about/c.py", "D.JSON", "e.bin", "w.xlsx"]
    df = frame(spark, [(p,) for p in paths], "rel_path string")
    tagged = corpus.tag_files(df)
    kept = {r.rel_path for r in corpus.select_files(tagged).collect()}
    assert kept == {"a.py", "D.JSON", "w.xlsx"}
    kept = {r.rel_path: r.language for r in corpus.select_files(tagged, workbooks=True).collect()}
    assert kept == {"a.py": "Python", "D.JSON": "", "w.xlsx": "Excel", "node_modules/w.xlsm": "VBA"}


# --- rules ---


def test_stock_rules(spark):
    text = "def calculate_loan(x):\n  IF income > 3 then APPROVE it\nFORMULA: A1 = SUM(B1)\n"
    df = frame(spark, [("p", "Python", text), ("x", "Excel", text)], "k string, language string, text string")
    rows = rules.detect_rules(df, ["k"]).collect()
    assert sorted((r.domain, r.pattern_id) for r in rows if r.k == "p") == [("financial", 1), ("financial", 2)]
    assert ("excel", 0) in {(r.domain, r.pattern_id) for r in rows if r.k == "x"}
    flags = {r.k: (r.matches, r.needs_review) for r in rules.rule_summary(df, ["k"]).collect()}
    assert flags == {"p": (2, True), "x": (3, False)}


def test_rule_table(spark):
    table = frame(
        spark, [("d", 0, r"\bü\w+", "umlaut", None), ("d", 1, "x", "only java", ["java"])],
        "domain string, pattern_id int, pattern string, description string, languages array<string>",
    )
    df = frame(spark, [("k", "über x\nübel", "Java")], "k string, text string, language string")
    rows = rules.detect_rules(df, ["k"], rules=rules.rules_from_table(table)).collect()
    assert [(r.pattern_id, r.match_pos, r.rule) for r in rows] == [(0, 0, "über"), (0, 1, "übel"), (1, 0, "x")]


# --- skew helpers ---


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    rng = random.Random(1)
    left = frame(spark, [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}") for i in range(3000)], "id int, k string")
    right = frame(spark, [(f"k{i}", i) for i in range(0, 50, 2)] + [("hot", -1), ("hot", -2)], "k string, v int")
    got = skew.salted_join(left, right, ["k"], how, rows_per_salt=100)
    want = left.join(right, "k", how)
    assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=repr) == sorted(
        map(tuple, want.select("id", "k", "v").collect()), key=repr)
    hot = {r.k: r._salts for r in skew.hot_keys(left, ["k"], 100).collect()}
    assert set(hot) == {"hot"} and hot["hot"] >= 10


def test_number_within_equals_row_number(spark):
    rng = random.Random(2)
    rows = [("big" if i % 3 else f"g{i % 7}", f"n{rng.random():.8f}") for i in range(2000)]
    df = frame(spark, rows, "g string, n string")
    got = sorted(map(tuple, graph.number_within(df, ["g"], ["n"], "no").select("g", "n", "no").collect()))
    want, last = [], {}
    for g, n in sorted(rows):
        last[g] = last.get(g, 0) + 1
        want.append((g, n, last[g]))
    assert got == want


# --- imports ---


def files_of(spark, files):
    rows = [("p", path, text) for path, text in files.items()]
    df = frame(spark, rows, "project_id string, rel_path string, text string")
    return corpus.tag_files(df)


def test_import_resolution_rules(spark):
    files = files_of(spark, {
        "a/util.py": "", "b/util.py": "", "main.py": "from util import x\nimport os\nimport util, sys\n",
        "web/app.js": "import { a } from './lib/helper';\nimport React from 'react';\nrequire('./style.css')\n",
        "web/helper.jsx": "", "web/view.ts": "import { H } from '../web/helper';\n",
        "Main.java": "import com.acme.util;\n", "x.c": "import { a } from './helper';\n",
        "tool.rb": "require 'util'\n", "P.cs": "using System.Text;\n using util;\n",
    })
    got = {(r.src_path, r.target_path): r.reason
           for r in imports.resolve_imports(imports.extract_imports(files), files).collect()}
    assert set(got) == {
        ("main.py", "b/util.py"),  # the last path wins
        ("web/app.js", "web/helper.jsx"), ("web/view.ts", "web/helper.jsx"),
        ("tool.rb", "b/util.py"), ("P.cs", "b/util.py"),
    }
    assert got["main.py", "b/util.py"] == "Imports util module, providing functionality for main.py."


def test_normal_path(spark):
    for path, want in {"a/./b//c": "a/b/c", "a/../b": "b", "../../x": "../../x", ".": ".", "a/..": "."}.items():
        assert spark.range(1).select(imports.normal_path(F.lit(path))).first()[0] == want


def test_containment_equals_substring_search(spark):
    rng = random.Random(3)
    parts = ["src", "app", "util", "ab", "a", "main.py", "core"]
    files = [("p", "/".join(rng.choices(parts, k=rng.randint(1, 4))) + str(i)) for i in range(80)]
    names = ["util", "a", "", "os.app", "zz", "x.", "src/app", "main.py", "b"]
    found = [("p", f"s{i % 9}", i, n) for i, n in enumerate(names * 3)]
    got = imports.containment_edges(
        frame(spark, found, "project_id string, src_path string, import_pos int, import_name string"),
        frame(spark, files, "project_id string, rel_path string"))
    want = [(s, t) for _, s, _, n in found for _, t in files if n in t or n.split(".")[-1] in t]
    assert sorted((r.source, r.target) for r in got.collect()) == sorted(want)
    plan = plan_of(got)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_dependents_by_path_and_name(spark):
    deps = frame(spark, [("p", "m.py", "b/u.py", "u.py", "r")],
                 "project_id string, src_path string, target_path string, file_name string, reason string")
    res = frame(spark, [("p", "m.py", "m.py", "Overview\nMain."), ("p", "a/u.py", "u.py", "x"), ("p", "b/u.py", "u.py", "Overview\n  Util\n it \n\nz")],
                "project_id string, rel_path string, file_name string, requirements string")
    got = imports.dependents(deps, res).collect()
    assert [(r.rel_path, r.relative_path, r.reason) for r in got] == [("b/u.py", "m.py", "Main.")]
    assert {r.rel_path for r in imports.dependents(deps, res, by="name").collect()} == {"a/u.py", "b/u.py"}
    counts = {r.rel_path: r.dependents for r in imports.attach_dependents(res, imports.dependents(deps, res)).collect()}
    assert counts == {"m.py": 0, "a/u.py": 0, "b/u.py": 1}
    assert imports.enrich_reasons(deps, res).first().reason == "Util it"
    texts = {r.rel_path: r.requirements for r in imports.append_dependency_text(res, deps).collect()}
    assert texts["m.py"] == "Overview\nMain.\n\nDependent Files\nu.py\\nr"
    assert texts["a/u.py"].endswith("Dependent Files\nNo dependencies detected.")


# --- symbols ---


def test_counted_containment_equals_the_listed_edges(spark):
    rng = random.Random(8)
    words = ["a", "ab", "bca", "abc", "cab", "bcab", "", "d.ab"]
    paths = ["/".join(rng.choice(words) for _ in range(3)) for _ in range(60)]
    files = frame(spark, [(rng.choice("pq"), p) for p in [*paths, *paths[:9], None]], "project_id string, rel_path string")
    asked = [(rng.choice("pq"), rng.choice(paths), i, rng.choice([*words, None])) for i in range(150)]
    found = frame(spark, asked, "project_id string, src_path string, import_pos int, import_name string")
    listed = imports.containment_edges(found, files).groupBy("project_id", "source").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("target").alias("targets"), F.min("target").alias("first")
    )
    counted = imports.containment_edges(found, files, counted=True)
    assert counted.columns == listed.columns and sorted(counted.collect()) == sorted(listed.collect())


def test_counted_containment_lists_no_pairs_of_sources_and_targets(spark, monkeypatch):
    """Each of 60 sources has a name of each of 60 files and one of all: 7,200 edges to 3,600 different targets."""
    monkeypatch.setattr(imports, "BLOCK_NAMES", 700)
    monkeypatch.setattr(imports, "LEAST_BLOCK_NAMES", 90)
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    files = frame(spark, [(p, f"Z{n}Z") for p in "pq" for n in names], "project_id string, rel_path string")
    asked = [(p, f"s{i}", k, n) for p in "pq" for i in range(60) for k, n in enumerate([*names, "Z"])]
    found = frame(spark, asked, "project_id string, src_path string, import_pos int, import_name string")
    counted = imports.containment_edges(found, files, counted=True)
    assert sorted(map(tuple, counted.collect())) == sorted((p, f"s{i}", 120, 60, "ZaaZ") for p in "pq" for i in range(60))
    assert "cogroup" in plan_of(counted).lower()
    counted = imports.containment_edges(found.drop("project_id"), files.drop("project_id"), keep=(), counted=True)
    assert sorted(map(tuple, counted.collect())) == sorted((f"s{i}", 480, 60, "ZaaZ") for i in range(60))


def test_counted_graph_edges_equal_the_listed_ones_without_listing_imports(spark, monkeypatch):
    monkeypatch.setattr(imports, "BLOCK_NAMES", 6)
    monkeypatch.setattr(imports, "LEAST_BLOCK_NAMES", 4)
    names = ["ab", "abc", "b", "util", "til"]
    text = lambda i: f"import {names[i % 5]}\nimport {names[i % 3]}\ndef f_{i % 2}(x):\n    f_{i % 2}(x)\n"
    rows = [(p, f"src/{names[i % 5]}{i % 7}.py", "Python", text(i)) for p in "pq" for i in range(12)]
    files = frame(spark, rows, "project_id string, rel_path string, language string, text string")
    listed = project_graph(files)[1].groupBy("project_id", "source", "type").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("target").alias("targets"), F.min("target").alias("first")
    )
    counted = project_graph(files, counted=True)[1]
    assert "FlatMapCoGroupsInArrow" in plan_of(counted)
    assert sorted(map(tuple, counted.select(*listed.columns).collect())) == sorted(map(tuple, listed.collect()))


def test_targets_met_equals_a_plain_count(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    pick = lambda most: rng.sample(words[: rng.choice([3, 90])], rng.randint(1, min(most, 3)))
    lists = lambda rows: pa.chunked_array([pa.array(part, pa.list_(pa.string())) for part in (rows[:2], rows[2:])])
    for n, room in [(1, 64), (64, 64), (65, 1024), (400, 1 << 22), (400, 1024)]:
        monkeypatch.setattr(imports, "_BITS", room)
        classes, sources = [pick(9) for _ in range(n)], [pick(5) + ["else"] * (i % 2) for i in range(70)] + [["else"]]
        sizes = [rng.choice([1, 1, 3, 1000]) for _ in range(n)]
        want = [sum(size for names, size in zip(classes, sizes) if set(names) & set(s)) for s in sources]
        assert imports.targets_met(lists(sources), lists(classes), pa.chunked_array([sizes])).tolist() == want


def test_counted_dependents_equal_the_listed_ones(spark):
    rng = random.Random(6)
    names = ["u.py", "v.py", None]
    results = [("p", f"d{i % 40}/{i}" if i % 9 else None, rng.choice(names), "x") for i in range(60)]
    results += results[:7]
    deps = [("p", rng.choice(results)[1], rng.choice(names), rng.choice(results)[1]) for _ in range(200)]
    res = frame(spark, results, "project_id string, rel_path string, file_name string, requirements string")
    dep = frame(spark, deps, "project_id string, src_path string, file_name string, target_path string")
    for by in ("path", "name"):
        listed = imports.dependents(dep, res, by=by).groupBy("project_id", "rel_path").agg(F.count(F.lit(1)).alias("edges"))
        counted = imports.dependents(dep, res, by=by, counted=True)
        assert sorted(map(repr, counted.collect())) == sorted(map(repr, listed.collect()))


def test_python_facts():
    source = (
        "import os, sys\nfrom . import a\nfrom x.y import z\n"
        "class K:\n    def m(self):\n        def inner():\n            foo()\n        self.bar(inner())\n"
        "async def skipped():\n    baz()\n"
    )
    facts = symbols.python_facts(source)
    assert [f[1] for f in facts if f[0] == "import"] == ["os", "sys", "x.y"]
    assert [f[1] for f in facts if f[0] == "function"] == ["m", "inner"]
    assert sorted((f[2], f[1]) for f in facts if f[0] == "call") == [
        ("inner", "foo"), ("m", "bar"), ("m", "foo"), ("m", "inner")]


def test_facts_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(symbols, "FACT_ROWS", 3)
    files = frame(
        spark, [(f"f{i}", "Python", "\n".join(f"import m{k}" for k in range(i))) for i in range(8)] + [("n", "Python", None)],
        "rel_path string, language string, text string",
    )
    got = [(r.rel_path, r.kind, r.name, r.caller, r.pos) for r in symbols.python_symbols(files, keep=()).collect()]
    assert sorted(got) == sorted((f"f{i}", "import", f"m{k}", None, k) for i in range(8) for k in range(i))


def test_python_facts_with_syntax_error():
    source = "import lost\ndef good():\n    run()\ndef bad(:\n    pass\nclass C:\n    def ok(self): pass\n"
    assert [(k, n) for k, n, _, _ in symbols.python_facts(source)] == [
        ("function", "good"), ("call", "run"), ("function", "ok")]


def test_javascript_symbols(spark):
    text = (
        "import a from './a.js'; import './b'\nfunction f(x) { g(x); if (x) { h() } k() }\n"
        "function f() { other() }\nfunction open( {"
    )
    rows = symbols.javascript_symbols(files_of(spark, {"m.js": text})).collect()
    assert [r.name for r in rows if r.kind == "import"] == ["./a.js", "./b"]
    assert [r.name for r in rows if r.kind == "function"] == ["f", "f", "open"]
    # the first body, up to its first closing brace, once per declaration
    assert [(r.caller, r.name) for r in rows if r.kind == "call"] == [("f", n) for n in ["g", "if", "h"] * 2]


# --- graph ---


def test_hierarchy_with_root(spark):
    df = frame(spark, [("p", "a/x.py"), ("p", "a/b/y.py"), ("p", "node_modules/z.js")], "project_id string, rel_path string")
    rows = {r.id: (r.name, r.type, r.parent, r.depth) for r in graph.hierarchy(df, root="my proj/").collect()}
    assert rows == {
        "": ("my_proj", "directory", None, 0), "a": ("a", "directory", "", 1),
        "a/x.py": ("x.py", "file", "a", 2), "a/b": ("b", "directory", "a", 2), "a/b/y.py": ("y.py", "file", "a/b", 3),
    }


def test_chain_matches_breadth_first_search(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(50)] + [("hub", f"n{i}") for i in range(0, 30)]
    edges = frame(spark, [(a, b, "import") for a, b in pairs] + [("n1", "far", "hierarchy")], "source string, target string, type string")
    starts = frame(spark, [("n1",), ("n50",), ("alone",)], "node string")
    got = {(r.start, r.node): r.hops for r in graph.dependency_chain(edges, starts, rows_per_salt=5).collect()}
    want = {}
    for start in ("n1", "n50", "alone"):
        level, seen, hops = {start}, {start: 0}, 0
        while level:
            hops += 1
            level = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in level and y not in seen}
            seen.update({n: hops for n in level})
        want.update({(start, n): h for n, h in seen.items()})
    assert got == want


def test_merge_nodes(spark):
    tree = graph.hierarchy(frame(spark, [("p", "a.py")], "project_id string, rel_path string"))
    files = frame(spark, [("p", "a.py"), ("p", "lone.py")], "project_id string, rel_path string")
    facts = frame(spark, [("p", "a.py", "function", "Restart", None, 0), ("p", "a.py", "function", "go", None, 1)],
                  "project_id string, rel_path string, kind string, name string, caller string, pos int")
    rows = {r.id: (r.type, r.parent, r.important) for r in graph.merge_nodes(tree, files, facts).collect()}
    assert rows == {
        "a.py": ("file", None, False), "lone.py": ("file", None, False),
        "a.py:Restart": ("important_function", "a.py", True), "a.py:go": ("function", "a.py", False),
    }


# --- retrieval ---


def brute_force(q, d, k, q_keys=None, d_keys=None):
    out = {}
    for i, x in enumerate(q):
        ranked = sorted((float(((x - y) ** 2).sum()), j) for j, y in enumerate(d)
                        if q_keys is None or q_keys[i] == d_keys[j])
        out[i] = [j for _, j in ranked[:k]]
    return out


def block_pairs(monkeypatch):
    """The document sides of the block paths, as they are entered."""
    seen, original = [], retrieval._pair_up

    def spy(left, right, group, k, fields):
        seen.append(right)
        return original(left, right, group, k, fields)

    monkeypatch.setattr(retrieval, "_pair_up", spy)
    return seen


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_nearest_equals_brute_force(spark, monkeypatch, blocks, keyed):
    rng = np.random.default_rng(5)
    d = rng.normal(size=(300, 8)).round(1).astype(np.float32)
    d[100:200] = d[0]  # a third of all vectors are the same
    q = np.vstack([d[:20], rng.normal(size=(20, 8)).astype(np.float32)])
    q_keys, d_keys = [i % 2 for i in range(40)], [0 if j < 200 else 1 for j in range(300)]
    docs = frame(spark, [(j, v.tolist(), d_keys[j]) for j, v in enumerate(d)], "doc_id long, embedding array<float>, g int")
    queries = frame(spark, [(i, v.tolist(), q_keys[i]) for i, v in enumerate(q)], "query_id long, embedding array<float>, g int")
    monkeypatch.setattr(retrieval, "MAX_PIVOTS", 16)
    groups = block_pairs(monkeypatch)
    few = {"max_broadcast": 10, "block_rows": 16} if blocks else {}
    hits = retrieval.nearest(queries, docs, k=7, filter_key="g" if keyed else None, **few).collect()
    if blocks:  # several blocks on either side have met
        for side in ("qb", "db"):
            assert groups[0].select(side).distinct().count() > 1
    else:
        assert not groups
    got = {}
    for r in sorted(hits, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.doc_id)
    q64, d64 = q.astype(np.float64), d.astype(np.float64)
    assert got == brute_force(q64, d64, 7, *((q_keys, d_keys) if keyed else ()))


def test_cells_leave_out_far_documents(spark, monkeypatch):
    """Three clusters far apart: queries of one meet no documents of the others."""
    rng = np.random.default_rng(7)
    d = np.concatenate([rng.normal(size=(60, 4)) + 100 * c for c in range(3)])
    docs = frame(spark, [(j, v.tolist()) for j, v in enumerate(d)], "doc_id long, embedding array<double>")
    queries = frame(spark, [(j, v.tolist()) for j, v in enumerate(d[:60])], "query_id long, embedding array<double>")
    monkeypatch.setattr(retrieval, "MAX_PIVOTS", 12)
    groups = block_pairs(monkeypatch)
    got = {}
    for r in retrieval.nearest(queries, docs, k=5, max_broadcast=10).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_force(d[:60], d, 5)
    assert {r.doc_id for r in groups[0].select("doc_id").collect()} <= set(range(60))


@pytest.mark.parametrize("keyed", [False, True])
def test_a_vector_is_sent_to_few_blocks(spark, monkeypatch, keyed):
    """Without near neighbours every cell matters, but a query goes to a block once, and blocks are few."""
    x = np.random.default_rng(4).normal(size=(1200, 16))
    x[600:900] = x[0]
    rows = frame(spark, [(j, v.tolist(), 0) for j, v in enumerate(x)], "id long, embedding array<double>, g int")
    seen, original = [], retrieval._pair_up
    monkeypatch.setattr(retrieval, "_pair_up", lambda *a: (seen.append(a[:2]), original(*a))[1])
    hits = retrieval.nearest(
        rows, rows, k=3, query_id="id", doc_id="id", filter_key="g" if keyed else None, max_broadcast=50, block_rows=8
    ).collect()
    for side, name in zip(seen[0], ("query_id", "doc_id")):
        assert side.groupBy(name).count().agg(F.max("count")).first()[0] <= 20
    got = {}
    for r in sorted(hits, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_force(x, x, 3)


def test_post_filter_may_return_fewer(spark):
    docs = frame(spark, [(i, [float(i)], i % 4) for i in range(20)], "doc_id long, embedding array<float>, g int")
    queries = frame(spark, [(0, [0.0], 3)], "query_id long, embedding array<float>, g int")
    post = retrieval.nearest(queries, docs, k=3, filter_key="g", mode="post").orderBy("rank").collect()
    assert [r.doc_id for r in post] == [3]  # only the nearest six are looked at
    pre = retrieval.nearest(queries, docs, k=3, filter_key="g").orderBy("rank").collect()
    assert [r.doc_id for r in pre] == [3, 7, 11]
    assert pre[0].score == pytest.approx(0.25)


def test_ranking_keeps_k_rows_per_task(spark):
    docs = frame(spark, [(i, [float(i)]) for i in range(9)], "doc_id long, embedding array<float>")
    queries = frame(spark, [(0, [0.0])], "query_id long, embedding array<float>")
    assert "WindowGroupLimit" in plan_of(retrieval.nearest(queries, docs, k=2))


def test_null_keys_meet_nothing_on_either_path(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)], None if i % 2 else i % 4) for i in range(20)]
    docs = frame(spark, rows, "doc_id int, embedding array<double>, g int")
    queries = docs.withColumnRenamed("doc_id", "query_id")
    few = retrieval.nearest(queries, docs, k=2, filter_key="g").collect()
    many = retrieval.nearest(queries, docs, k=2, filter_key="g", max_broadcast=5).collect()
    assert len(few) == 20 and sorted(few) == sorted(many)


def test_equal_vectors_do_not_pile_up():
    import numpy as np

    top = retrieval._TopK(np.ones((50, 4)), None, 3)
    sizes, merge = [], top._merge
    top._merge = lambda found: (merge(found), sizes.append(len(top.best)))
    top.add(np.arange(400_000), np.ones((400_000, 4)), None)
    assert len(sizes) > 5 and max(sizes) == 150 and sorted(set(top.best["doc_id"])) == [0, 1, 2]


def test_hashed_embedding(spark):
    df = frame(spark, [(1, "alpha beta"), (2, "alpha beta"), (3, "")], "id int, text string")
    rows = {r.id: r.embedding for r in retrieval.hashed_embedding(df, dimension=32).collect()}
    assert rows[1] == rows[2] and sum(x * x for x in rows[1]) == pytest.approx(1, abs=1e-5)
    assert set(rows[3]) == {0.0}


def test_components_of_a_chain(spark):
    links = frame(spark, [(k, k + 1) for k in range(40)] + [(90, 91)], "a int, b int")
    rows = graph.connected_components(links).collect()
    assert {(r["node"], r["class"]) for r in rows} == {(k, 0) for k in range(41)} | {(90, 90), (91, 90)}


# --- merging ---


def greedy(parts, budget):
    used, kept = 0, []
    for s in parts:
        if used < budget and used + len(s) // 4 <= budget:
            used += len(s) // 4
            kept.append(s)
    return used, kept


def test_budget_in_rounds_equals_one_fold(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(6):
        parts = ["w" * rng.randint(1, 90) for _ in range(rng.choice([3, 40, 300]))]
        rows += [(g, i, s, len(s) // 4, 50) for i, s in enumerate(parts)]
        want[g] = greedy(parts, 50)
    df = frame(spark, rows, "g int, i int, sentence string, tokens int, budget int")
    got = {r.g: (r.used, r.kept) for r in merging.budget_sentences(df, ["g"], ["i"], round_sentences=7).collect()}
    for g, (used, kept) in want.items():
        assert got[g] == (used, kept)


def test_budget_takes_any_number_of_short_sentences(spark):
    df = frame(spark, [(1, i, "ab", 0, 1) for i in range(100)], "g int, i int, sentence string, tokens int, budget int")
    for size in (10, 1000):
        rows = merging.budget_sentences(df, ["g"], ["i"], round_sentences=size).collect()
        assert [(r.used, len(r.kept)) for r in rows] == [(0, 100)]


def test_every_project_has_a_context(spark):
    rows = [("a", "1", "f", "Overview\nhas one"), ("b", "1", "f", "nothing shown"), ("c", "1", "f", ""), ("c", "2", "f", None)]
    df = frame(spark, rows, "project_id string, rel_path string, file_name string, requirements string")
    got = {r.project_id: r.context for r in merging.project_context(df).collect()}
    assert got["b"] == merging.CONTEXT_TITLE and got["c"] == merging.NO_CONTENT
    assert got["a"] == merging.CONTEXT_TITLE + "\nf:\n  Overview: has one\n"


def test_combine_sections(spark):
    def out(n, last):
        return (f"Overview\nFile part {n}.\n\nObjective\nSame goal.\n\nUse Case\nUse {n}.\n\n"
                f"Key Functionalities\n1. A: alpha\n\n2. B{n}: beta {n}\n\n3. no colon\n\nWorkflow Summary\n{last}")
    rows = [("f", 0, out(0, "Flow.")), ("f", 1, out(1, "Flow.")), ("f", 2, "Overview\nonly this"), ("g", 0, "junk")]
    df = frame(spark, [(*r, "Ruby") for r in rows], "k string, chunk_index int, text string, language string")
    got = {r.k: r.requirements for r in merging.combine_sections(df, ["k"]).collect()}
    assert got["f"] == (
        "Overview\nFile part 0. File part 1.\n\nObjective\nSame goal.\n\nUse Case\nUse 0. Use 1.\n\n"
        "Key Functionalities\n1. alpha\n\n2. beta 0\n\n3. beta 1\n\nWorkflow Summary\nFlow.")
    assert got["g"].startswith("Overview\nSupports ruby file operations.\n\nObjective\nTo enable core ruby")


# --- summaries and diagrams ---


def test_vba_modules_and_workbook(spark):
    text = ("--- VBA Module: M ---\nSub old()\n--- VBA Module: N ---\n--- VBA Module: M ---\n' note\nsub Go (a, b)\n"
            "FORMULA: A1 = SUM(B1)\n  External Link: x")
    rows = spark.range(1).select(summaries.vba_modules(F.lit(text)).alias("m")).first().m
    assert [(m.module, m.parameters, m.comments) for m in rows] == [("M ---", "Go(a, b)", "note")]
    got = spark.range(1).select(summaries.workbook_summary(F.lit(text))).first()[0]
    assert "Formula in A1: SUM(B1)" in got and got.endswith("External Link: x")
    none = spark.range(1).select(summaries.workbook_summary(F.lit("CELL: A1 = 2"))).first()[0]
    assert none == "No business logic, rules, or automation found in the file."


def test_technical_summary_by_extension(spark):
    files = files_of(spark, {
        "a.csproj": '<ProjectReference Include="x.csproj" />', "b.json": "[1]", "c.yml": "# c\nk: v\n j : w",
        "d.html": "<b><i></b><b>", "e.sql": "select", "f.py": "x", "g.ts": "@Component() class A {}",
        "h.cs": "class C { public static int Run(int a) { return 1; } }",
    })
    got = {r.rel_path: r.summary for r in summaries.technical_summary(files, ["rel_path"]).collect()}
    assert got["a.csproj"] == "Project References: x.csproj"
    assert got["b.json"] == "JSON config file; unable to parse."
    assert got["c.yml"] == "YAML config file; top-level keys: k, j."
    assert got["d.html"] == "HTML template file; main tags: b, i."
    assert got["f.py"] is None and got["g.ts"] == "Decorators: Component. Classes: A."
    assert "- 'Run(int a)': Extension method" in got["h.cs"]


def test_diagram_labels_may_follow(spark):
    df = frame(spark, [(1, "graph TD\nA --> B[Bee]\nA[Ay] ---|x| C\ntext")], "id int, generated_code string")
    rows = diagrams.diagram_edges(df, ["id"]).orderBy("line_no").collect()
    assert [(r.src_label, r.arrow, r.dst_label) for r in rows] == [("Ay", "-->", "Bee"), ("Ay", "---", "C")]


def test_cache_needs_both_diagrams(spark):
    requests = frame(spark, [("x",), ("x",), ("y",), ("z",)], "text string")
    sha = lambda t: F.sha2(F.lit(t), 256)
    a, b = diagrams.TARGET_DIAGRAMS
    cache = spark.range(1).select(F.inline(F.array(*[
        F.struct(sha(t).alias("content_hash"), F.lit(g).alias("target_graph")) for t, g in [("x", a), ("x", b), ("y", a), ("y", a)]])))
    assert [r.requests for r in diagrams.cache_hits(requests, cache).collect()] == [2]
    assert diagrams.cache_misses(requests, cache).count() == 2


def test_nodes_are_computed_once_for_their_ways_to_the_root(spark):
    rows = [("p", "", "root", "directory", None), ("p", "a", "a", "directory", ""), ("p", "a/f.py", "f.py", "file", "a")]
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    schema = "project_id string, id string, name string, type string, parent string"
    nodes = frame(spark, rows, schema).mapInArrow(counted, schema)
    got = {(r.id, r.step, r.on_path) for r in graph.path_to_root(nodes).collect()}
    assert got == {("", 0, ""), ("a", 0, "a"), ("a", 1, ""), ("a/f.py", 0, "a/f.py"), ("a/f.py", 1, "a"), ("a/f.py", 2, "")}
    assert passed.value == 3
