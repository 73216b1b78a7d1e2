"""Sources, sinks, plans and the ingest stream on temporary folders."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import analysis
from corpusloom.sources import diagrams, files, results, vectors, workbooks
from corpusloom.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    content = {
        "pkg/__init__.py": b"from util import x\n",
        "pkg/_private.py": b"def start(): helper()\ndef helper(): pass\n",
        "pkg/util.py": b"import os, sys\n",
        "web/app.js": b"import './x';\nfunction go() { go() }\n",
        "node_modules/dep.js": b"no",
        "node_modules/book.xlsm": b"\xd0\xcf\x11\xe0",
        "style.css": b"a{}",
        "bad.py": "grün".encode("latin-1"),
        ".env": b"X=1",
        "notes.md": b"# hi",
    }
    for name, data in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def test_scan_sees_underscore_names(spark, tree):
    got = {r.rel_path: r.language for r in files.scan_folder(spark, str(tree), "p").collect()}
    assert got == {
        "pkg/__init__.py": "Python", "pkg/_private.py": "Python", "pkg/util.py": "Python",
        "web/app.js": "JavaScript", "notes.md": "",
    }
    with_books = {r.rel_path: r for r in files.scan_folder(spark, f"file://{tree}", workbooks=True).collect()}
    book = with_books["node_modules/book.xlsm"]
    assert (book.text, book.error) == (None, "binary workbook") and "node_modules/dep.js" not in with_books


def test_files_that_cannot_be_read_have_a_row(spark, tree, monkeypatch):
    (tree / "web/lost.js").symlink_to(tree / "nowhere.js")
    (tree / "web/long.js").write_bytes(b"x" * 500)
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 400)
    rows = {r.rel_path: r for r in files.scan_folder(spark, str(tree), "p").collect()}
    assert {p for p, r in rows.items() if r.error} == {"web/lost.js", "web/long.js"}
    assert len(rows) == 7 and rows["web/lost.js"].text is None and rows["web/app.js"].error is None


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("app/main.py", "x = 1")
        z.writestr("app/sub/__init__.py", "")
        z.writestr("other/skip.py", "")
        z.writestr("top.py", "")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("app/main.py", "y = 2")
    rows = files.scan_archives(spark, str(tmp_path)).collect()
    got = {r.rel_path: r.text for r in rows if r.error is None}
    assert got == {"a/main.py": "x = 1", "a/sub/__init__.py": "", "b/main.py": "y = 2"}
    assert [r.rel_path for r in rows if r.error] == ["broken.zip"] and len(rows) == 4
    listed = files.read_contents(files.list_files(spark, str(tmp_path)))
    errors = files.expand_archives(listed).where("error IS NOT NULL").collect()
    assert [r.zip_path for r in errors] == ["broken.zip"]


def test_whole_analysis(spark, tree):
    corpus = files.scan_folder(spark, str(tree), "p")
    out = analysis.analyse(corpus)
    deps = [(r.src_path, r.target_path) for r in out.dependencies.collect()]
    assert deps == [("pkg/__init__.py", "pkg/util.py")]
    assert [(r.rel_path, r.relative_path) for r in out.dependents.collect()] == [("pkg/util.py", "pkg/__init__.py")]
    assert out.chunks.count() == 4 and out.rule_summaries.where("needs_review").count() == 4
    nodes, edges = analysis.project_graph(corpus, root="proj")
    ids = {r.id: r.type for r in nodes.collect()}
    assert ids["pkg/_private.py:start"] == "important_function" and ids["pkg"] == "directory"
    rows = [tuple(r) for r in edges.select("source", "target", "type").collect()]
    assert ("pkg/_private.py:start", "pkg/_private.py:helper", "call") in rows
    assert ("pkg/__init__.py", "pkg/util.py", "import") in rows
    assert {s for s, _, _ in rows} | {t for _, t, _ in rows} <= set(ids)


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "vectors")
    chunks = spark.createDataFrame(
        [(1, "a", [1.0, 0.0], "x.py", "Python"), (2, "b", [0.0, 0.0], "y.py", "Python"), (3, "c", [1.0], "z.js", "JavaScript"),
         (4, "d", [0.5, 0.5], "z.js", "JavaScript")],
        "chunk_id long, content string, embedding array<float>, path string, lang string")
    docs = vectors.vector_documents(chunks, {"file_path": "path", "language": "lang", "kind": "lang"})
    assert vectors.load_vectors(spark, path, 2).count() == 0
    vectors.append_vectors(docs, path, 2)
    vectors.append_vectors(docs.where("id = 1"), path, 2)
    assert vectors.load_vectors(spark, path, 2).count() == 3
    assert vectors.load_vectors(spark, path, 3).count() == 0  # another width starts empty
    python = vectors.load_vectors(spark, path, 2, {"language": "Python", "kind": "Python"})
    assert {r.content for r in python.collect()} == {"a"}
    plan = python._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language,Python)" in plan
    vectors.replace_vectors(docs.where("id = 4"), path, 2)
    assert [r.id for r in vectors.load_vectors(spark, path, 2).collect()] == [4]
    vectors.clear_vectors(spark, path, 2)
    assert vectors.load_vectors(spark, path, 2).count() == 0


def test_drop_zero_vectors(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<float>").write.parquet(source)
    vectors.drop_zero_vectors(spark, source, target)
    assert [r.id for r in spark.read.parquet(target).collect()] == [2]


def test_diagram_cache(spark, tmp_path):
    for h in ("aa11", "bb22"):
        (tmp_path / "in" / h).mkdir(parents=True)
        body = {"target_graph": "Requirement Diagram", "generated_code": "graph TD\n A --> B"}
        (tmp_path / "in" / h / "Requirement_Diagram.json").write_text(json.dumps(body, indent=2))
    rows = diagrams.read_diagram_folders(spark, str(tmp_path / "in"))
    assert {r.content_hash for r in rows.collect()} == {"aa11", "bb22"}
    diagrams.write_diagrams(rows, str(tmp_path / "out"))
    back = diagrams.read_diagrams(spark, str(tmp_path / "out")).collect()
    assert {(r.content_hash, r.generated_code) for r in back} == {("aa11", "graph TD\n A --> B"), ("bb22", "graph TD\n A --> B")}


def test_workbook_lines(spark):
    text = ("=== WORKSHEET DATA ===\n\n--- Sheet: One ---\nCELL: A1 = 5\nFORMULA: B2 = A1 = 3\n\n  Data Validations:\n"
            "DATA_VALIDATION: Range: C1 | Type: list | Formula1: x\n\n  Named Ranges:\n  - rate: One!$A$1\n"
            "\nPivot Tables in One:\n  - Name: p\n    Data Source: A1:B2\n\nExternal Links:\n  - http://x")
    df = spark.createDataFrame([("w", text)], "k string, text string")
    rows = workbooks.workbook_lines(df, ["k"]).orderBy("line_no").collect()
    assert [(r.kind, r.sheet, r.ref, r.value, r.cell_range, r.formula1) for r in rows] == [
        ("cell", "One", "A1", "5", None, None), ("formula", "One", "B2", "A1 = 3", None, None),
        ("data_validation", "One", None, None, "C1", "x"), ("named_range", "One", "rate", "One!$A$1", None, None),
        ("pivot", None, "Name", "p", None, None), ("external_link", None, "http://x", None, None, None),
    ]


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.py", "x/a.py", "text")], "file_name string, rel_path string, requirements string")
    results.write_result_text(rows, str(tmp_path / "r"))
    line = spark.read.text(str(tmp_path / "r")).first().value
    assert json.loads(line) == {"file_name": "a.py", "rel_path": "x/a.py", "requirements": "text"}


SCHEMA = "doc_id long, lang string, text string"


def test_ingest_stream_skips_seen_content(spark, tmp_path):
    source, table, hashes, check = (str(tmp_path / n) for n in ("in", "chunks", "hashes", "check"))

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        writer = ingest.ingest_stream(stream, table, hashes, check, "doc_id", ["lang"], small=5)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()

    add([(1, "en", "alpha"), (2, "en", "alpha"), (3, "fr", "beta " * 20)])
    run()
    add([(4, "en", "alpha"), (5, "de", "gamma")])
    run()
    rows = spark.read.parquet(table)
    assert {r.doc_id for r in rows.collect()} == {1, 3, 5}
    assert ingest.read_hashes(spark, hashes).count() == 3


def test_ingest_batch_can_be_repeated(spark, tmp_path):
    table, hashes = str(tmp_path / "c"), str(tmp_path / "h")
    batch = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], SCHEMA)
    for _ in range(2):
        ingest.ingest_batch(batch, 0, table, hashes, "doc_id", ["lang"], "text")
    assert spark.read.parquet(table).count() == 2
    ingest.ingest_batch(batch, 1, table, hashes, "doc_id", ["lang"], "text")
    assert spark.read.parquet(table).count() == 2


def test_watermark_dedup(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string")
    rows.withColumn("ts", F.current_timestamp()).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id int, text string, ts timestamp").parquet(source)
    query = ingest.drop_recent_copies(stream, "ts").writeStream.format("memory").queryName("recent_copies").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("recent_copies").count() == 2


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    from corpusloom.session import cut_lineage, ensure_checkpoint_dir, scratch

    before = set(os.listdir(ensure_checkpoint_dir(spark)))
    with scratch(spark):
        cut_lineage(spark.range(5)).write.parquet(str(tmp_path / "kept"))
        assert len(set(os.listdir(ensure_checkpoint_dir(spark))) - before) == 1
    assert set(os.listdir(ensure_checkpoint_dir(spark))) == before
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
