"""The plan from chunks to prompts against a plain search, VARIANT filters and the stored model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metadata
from corpusloom.operators import embedding_model, retrieval
from corpusloom.operators.rules import Rule
from corpusloom.plans import prompting

FILES = [
    ("p", "a.py", "Python", "discount rate\nalpha beta gamma"), ("p", "b.py", "Python", "alpha beta delta price"),
    ("p", "c.py", "Python", "omega psi chi"), ("p", "d.js", "JavaScript", "alpha beta gamma"), ("p", "e.js", "JavaScript", "x y"),
    ("p", "blank.py", "Python", " \n "), ("q", "long.py", "Python", "\n".join(f"line{k} alpha{k % 5} word" for k in range(120))),
    ("q", "none.xyz", None, "alpha beta"),
]
RULES = [Rule("shop", 0, r"discount|price", "Prices")]


@pytest.mark.parametrize("broadcast", [None, 1])
def test_prompts_equal_a_plain_search(spark, broadcast):
    files = spark.createDataFrame(FILES, "project_id string, rel_path string, language string, text string")
    how = {"small": 100, "max_tokens": 150}
    rows = prompting.chunk_prompts(files, "Go.", 2, dimension=32, rule_list=RULES, max_broadcast=broadcast, **how).collect()
    from corpusloom.operators.chunks import store_chunks

    chunks = store_chunks(files, ["project_id", "rel_path", "language"], **how)
    made = retrieval.hashed_embedding(chunks, "content", 32).collect()
    assert len(rows) == len(made) and len({r["rel_path"] for r in made}) < len(made)
    vector = {(r["project_id"], r["rel_path"], r["chunk_index"]): np.array(r["embedding"], np.float64) for r in made}
    by_key = {k: r for k, r in zip(vector, made)}
    for r in rows:
        me = (r["project_id"], r["rel_path"], r["chunk_index"])
        own = by_key[me]
        others = [k for k in vector if by_key[k]["language"] == own["language"] is not None and vector[k].any()]
        ranked = sorted(others, key=lambda k: (((vector[k] - vector[me]) ** 2).sum(), "\x1f".join(map(str, k))))[:2] if vector[me].any() else []
        if own["language"] is None:
            ranked = []
        files_of = list(dict.fromkeys(k[1] for k in ranked))
        assert (r["related_files"], r["best_file"]) == (len(files_of), files_of[0] if files_of else None), me
        blocks = []
        for f in files_of:
            mine = [k for k in ranked if k[1] == f]
            first = by_key[mine[0]]
            lines = [f"File: {f}", f"Language: {first['language']}", f"Lines: {first['start_line']}-{first['end_line']}"]
            lines += [f"Chunk: {first['chunk_index'] + 1}/{first['total_chunks']}"] if first["is_chunk"] else []
            blocks.append("\n".join([*lines, "Content:", *[by_key[k]["content"] for k in mine], "---"]))
        context = "\n".join(blocks)
        if len(own["content"]) // 4 + len(context) // 4 > 150:
            context = context[: 150 // 4]
        assert r["context"] == context, me
        content = own["content"][:112] if len(own["content"]) // 4 > 112 else own["content"]
        found = sum(own["content"].count(w) for w in ("discount", "price"))
        noted = "\n".join(["Detected shop rule (regex): Prices"] * found)
        facts = f"{prompting.CONTEXT_TITLE}{context}\n\nContext Metadata:\n- Total related files: {len(files_of)}\n- Most relevant file: {files_of[0]}" if context else ""
        assert r["rules"] == noted and r["prompt"] == (
            f"Go.{prompting.RULES_TITLE}{noted}{facts}{prompting.SEGMENT_TITLE}{own['language'] or ''}\n{content}\n```"
        )


def test_prompts_of_nothing(spark):
    files = spark.createDataFrame([], "project_id string, rel_path string, language string, text string")
    assert prompting.chunk_prompts(files, "Go.").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_and_vectors_are_made_once(spark):
    """No filter builds the text, its pieces or the vectors a second time."""
    from corpusloom.operators.chunks import store_chunks, token_chunks

    files = spark.createDataFrame(FILES, "project_id string, rel_path string, language string, text string").repartition(2)
    made = files.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda l: F.reverse(l)), "\n"))
    chunks = store_chunks(made, ["project_id", "rel_path", "language"], small=100, max_tokens=150)
    assert plan_of(chunks).count("reverse(") == 1
    nothing = made.withColumn("text", F.when(F.col("rel_path") == "a.py", F.col("text")))
    assert [r["rel_path"] for r in token_chunks(nothing, ["rel_path"]).collect()] == ["a.py"]
    vectors = plan_of(prompting.embedded_chunks(chunks.withColumn("_id", F.col("rel_path")), None, 32))
    assert vectors.count("ArrowEvalPython") == 1 and "array_remove" not in vectors


def test_contents_meet_their_query_once(spark):
    files = spark.createDataFrame(FILES, "project_id string, rel_path string, language string, text string")
    rows = prompting.chunk_prompts(files, "Go.", 2, dimension=32, rule_list=RULES, small=100, max_tokens=150)
    assert plan_of(rows).count("Exchange hashpartitioning(query_id") == 1


def test_vectors_are_those_of_counted_words(spark):
    import hashlib
    import re

    texts = ["Alpha beta alpha", "", None, "É_1 é_1 – ½ x", " \n", "w" * 5000, " ".join(f"w{k % 700}" for k in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    for r in retrieval.hashed_embedding(df, dimension=16).collect():
        counts = np.zeros(16, np.int64)
        for w in re.findall(r"[^\W]+", (r["text"] or "").lower().replace("½", " ")):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        norm = max(int((counts * counts).sum()), 1) ** 0.5
        assert r["embedding"] == [float(np.float32(c / norm)) for c in counts], r["id"]


@pytest.mark.parametrize("offset, scale", [(0, 1), (1000, 1), (0, 1e-25), (1e18, 1e17), (0, 1e-4)])
def test_products_in_single_precision_lose_no_neighbour(offset, scale):
    """Norms far above the distances, and numbers too small or large for single precision."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)) * scale + offset
    x[50:60] = x[0]
    x[60:80] = x[0] * (1 + 1e-9 * rng.normal(size=(20, 12)))
    top = retrieval._TopK(x[:90], None, 3)
    for at in range(0, 700, 350):
        top.add(np.arange(at, at + 350), x[at : at + 350], None)
    for q, rows in top.best.groupby("q"):
        best = sorted((d, j) for j, d in enumerate(np.einsum("ij,ij->i", x[q] - x, x[q] - x)))[:3]
        assert list(zip(rows["d2"], rows["doc_id"])) == best, q
    assert len(top.best) == 270


def test_vectors_of_several_widths_stop_a_search():
    import pyarrow as pa

    with pytest.raises(ValueError):
        retrieval._rows_of(pa.chunked_array([pa.array([[1.0, 2.0], [1.0, 2.0, 3.0], [4.0]])]))


# --- metadata of any shape ---


def test_typed_filters(spark):
    rows = [
        (1, '{"size": 10, "name": "10", "on": true, "at": {"x": [1, 2.5]}, "none": null}'), (2, '{"size": 9.5, "name": "b"}'),
        (3, '{"size": "10"}'), (4, "[1]"), (5, "broken"), (6, None), (7, '{"size": 1e3, "on": "true", "at": {"x": []}}'),
    ]
    df = spark.createDataFrame(rows, "k int, t string").select("k", metadata.from_json_text("t").alias("m"))

    def kept(filters):
        return [r.k for r in df.where(metadata.matches("m", filters)).orderBy("k").collect()]

    assert kept({"size": (">", 9)}) == [1, 2, 7] and kept({"size": 10}) == [1] and kept({"size": "10"}) == [3]
    assert kept({"size": ("in", [9.5, 1000])}) == [2, 7] and kept({"name": ("<>", "b")}) == [1]
    assert kept({"on": True}) == [1] and kept({"on": "true"}) == [7] and kept({"at.x[1]": 2.5}) == [1]
    assert kept({"none": None}) == [1, 2, 3, 4, 5, 6, 7] and kept({"name": ("<>", None)}) == [1, 2]
    assert kept({"size": (">=", 10), "name": "10"}) == [1] and kept({}) == [1, 2, 3, 4, 5, 6, 7]
    for bad in ({"a b": 1}, {"size": ("~", 1)}, {"size": ("in", [1, "x"])}):
        with pytest.raises(ValueError):
            metadata.matches("m", bad)


# --- the stored model ---


def test_a_reloaded_model_gives_the_same_neighbours(spark, tmp_path):
    texts = [f"word{k % 9} common word{k % 5} text{k % 13}" for k in range(60)] + ["", None, "unseen"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = embedding_model.fit(df.where("id < 60"), dimension=64)
    embedding_model.save(model, str(tmp_path / "m"))
    embedding_model.save(model, str(tmp_path / "m"))  # in place of the first
    again = embedding_model.embed(df, embedding_model.load(str(tmp_path / "m")))
    first = embedding_model.embed(df, model)
    assert first.columns == ["id", "text", "embedding"]
    assert [r.embedding for r in first.orderBy("id").collect()] == [r.embedding for r in again.orderBy("id").collect()]
    x = np.array([r.embedding for r in again.orderBy("id").collect()])
    norms = (x**2).sum(1)
    assert np.allclose(norms[:60], 1, atol=1e-5) and (norms[60:62] == 0).all()
    vectors = retrieval.clean_vectors(again, dimension=64)
    hits = retrieval.nearest(vectors, vectors, 3, query_id="id", doc_id="id").collect()
    d = x.astype(np.float64)
    for r in hits:
        best = sorted((((d[r.query_id] - d[j]) ** 2).sum(), j) for j in range(len(d)) if norms[j] > 0)
        assert abs(r.distance**2 - best[r["rank"] - 1][0]) < 1e-9


def test_counts_taken_while_writing(spark, tmp_path):
    from corpusloom.streaming import ingest

    table, hashes = str(tmp_path / "c"), str(tmp_path / "h")
    rows = [(1, "en", "a"), (2, "en", "a"), (3, "en", "word " * 300), (4, "en", "b")]
    batch = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    counts = ingest.ingest_batch(batch, 0, table, hashes, "doc_id", ["lang"], "text", small=50, max_tokens=100)
    stored = spark.read.parquet(table)
    extra = stored.where("chunk_index > 0").count()
    assert counts == {"added": 3, "skipped": 1, "extra_chunks": extra} and extra > 0
    assert stored.agg(F.countDistinct("doc_id")).first()[0] == 3
    counts = ingest.ingest_batch(batch, 1, table, hashes, "doc_id", ["lang"], "text")
    assert counts == {"added": 0, "skipped": 4, "extra_chunks": 0}
