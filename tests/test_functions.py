"""Column functions on literal values, expected results written by hand."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays, diagram_text, jsontext, paths, tokens, vectors
from corpusloom.functions import sections as S
from corpusloom.functions import strings


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "path,ignored",
    [
        ("src/app.py", False),
        ("about/page.html", True),  # ends in "out"
        ("a/node_modules/x/index.js", True),
        ("src/.hidden/x.py", True),
        ("src/my.environment.py", True),  # ".env" anywhere
        ("src/environment.py", False),
        ("checkout/a.py", True),
        ("outer/a.py", False),
        ("img/logo.png", True),
        ("README.md", True),
        ("docs/guide.md", False),
    ],
)
def test_ignore(spark, path, ignored):
    assert one(spark, paths.is_ignored("p"), p=path) is ignored


@pytest.mark.parametrize(
    "path,ext,stem,language",
    [
        ("a/b.PY", ".py", "b", "Python"),
        ("a/.env", "", ".env", ""),
        ("a..b", ".b", "a.", ""),
        ("a/b.tar.gz", ".gz", "b.tar", ""),
        ("noext", "", "noext", ""),
        ("x.tsx", ".tsx", "x", "TypeScript"),
    ],
)
def test_extension(spark, path, ext, stem, language):
    got = one(spark, F.array(paths.extension("p"), paths.stem("p"), paths.language("p")), p=path)
    assert got == [ext, stem, language]


def test_folder_names(spark):
    assert one(spark, paths.clean_folder_name("p"), p="/my app-/") == "my_app"
    assert one(spark, paths.clean_folder_name("p"), p="--") == "project-root"
    assert one(spark, paths.clean_folder_name("p", drop_main=True), p="team/tool-main/") == "tool"
    assert one(spark, paths.clean_folder_name(F.lit(None).cast("string"))) == "project-root"


def test_urls_and_windows_paths(spark):
    assert one(spark, paths.is_github_url("u"), u="https://GitHub.com/a/b") is True
    assert one(spark, paths.is_github_url("u"), u="https://gist.github.com/a") is False
    assert one(spark, paths.is_github_url("u"), u="not a url") is False
    assert one(spark, paths.is_windows_path("u"), u="C:\\a\\b.txt") is True
    assert one(spark, paths.is_windows_path("u"), u="/a/b") is False


def test_lines(spark):
    assert one(spark, strings.lines("t"), t="a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, strings.lines("t"), t="") == []
    assert one(spark, strings.lines("t"), t="\n") == [""]
    assert one(spark, strings.strip("t"), t="\u3000 a b\x1f\n") == "a b"


def test_ellipsis(spark):
    assert one(spark, strings.ellipsis("t", 3), t="abcd") == "abc..."
    assert one(spark, strings.ellipsis("t", 3), t="abc") == "abc"
    assert one(spark, strings.ellipsis("t", 3), t="") == "No description available."


def test_token_windows(spark):
    text = "x" * 35
    assert [len(w) for w in one(spark, tokens.token_windows("t", 4), t=text)] == [16, 16, 3]
    # 19 characters are 4 tokens, so they fit
    assert one(spark, tokens.token_windows("t", 4), t="y" * 19) == ["y" * 19]
    assert one(spark, tokens.token_windows("t", 4), t="") == [""]
    emoji = "\U0001f600\n" * 20
    assert "".join(one(spark, tokens.token_windows("t", 4), t=emoji)) == emoji


def test_truncation(spark):
    assert one(spark, tokens.truncate_words("t", 2), t=" a  b\tc ") == "a b"
    assert one(spark, tokens.truncate_words("t", 3), t=" a  b\tc ") == " a  b\tc "
    assert len(one(spark, tokens.truncate_over_limit("t", 10), t="x" * 50)) == 7
    assert len(one(spark, tokens.truncate_medium("t", 40), t="x" * 100)) == int(100 * 40 * 0.3 / 25)
    assert one(spark, tokens.size_class(F.lit(999))) == "small"
    assert one(spark, tokens.size_class(F.lit(50_000))) == "medium"
    assert one(spark, tokens.size_class(F.lit(50_001))) == "large"


FULL = (
    "Intro\n\nOverview\nIt holds.\nMore.\n\nstill overview\n\nKey Functionalities\n1. First\nnote\n2. Second\n\n"
    "plain later\n\nDependent Files\na.py\nb.py"
)


def test_parse_sections(spark):
    got = one(spark, S.parse_sections("t"), t=FULL)
    assert got.overview == "It holds. More. still overview"
    assert got.key_functionalities == ["First", "Second", "plain later"]
    assert got.dependent_files == ["a.py", "b.py"]
    assert (got.objective, got.use_case, got.workflow_summary) == ("", "", "")


def test_parse_sections_unnumbered_and_repeated(spark):
    got = one(spark, S.parse_sections("t"), t="Key Functionalities\nalpha\nbeta\n\nOverview\none\n\nOverview\ntwo")
    assert got.key_functionalities == ["alpha", "beta"]
    assert got.overview == "two"
    empty = one(spark, S.parse_sections("t"), t="nothing here")
    assert empty.overview == "" and empty.key_functionalities == []


def test_loose_sections_take_marks_and_case(spark):
    got = one(spark, S.sections_loose("t"), t="# overview\nBody one.\n\n## Objective: goal\n###use case\nX")
    assert got.overview == "Body one."
    assert got.objective == ": goal"
    assert got.use_case == "X"
    assert got.workflow_summary is None


def test_fill_sections(spark):
    text = "Overview\nToo few\n\nObjective\nA long enough objective."
    got = one(spark, S.fill_sections("t", F.lit("a.py"), F.lit("Python"), F.lit("R1")), t=text)
    assert got.startswith("Overview\nR1\n")
    assert "Objective\nA long enough objective.\n" in got
    assert "in the a.py Python file for the 'Use Case' section" in got
    assert got.endswith("Dependent Files\nNo dependencies detected.\n")


@pytest.mark.parametrize(
    "text,generic",
    [
        ("", True),
        ("Key Functionalities\n1. short", True),
        ("Key Functionalities\n1. " + "word " * 20, False),
        ("Key Functionalities\nno numbers " + "word " * 20, True),
        ("Key Functionalities\n1. this file IS " + "word " * 20, True),
        ("1. " + "word " * 20, True),
        ("Overview\n \nObjective\nUse Case\nKey Functionalities\n1. " + "w " * 30, True),
    ],
)
def test_generic(spark, text, generic):
    assert one(spark, S.is_generic("t"), t=text) is generic


def test_summary(spark):
    text = "pre\n## PROJECT OVERVIEW\na\n\n b \n ## Next-One\nc"
    got = [tuple(s) for s in one(spark, S.summary_sections("t"), t=text)]
    assert got == [("PROJECT OVERVIEW", "a b", "project_overview"), ("Next-One", "c", "next_one")]
    assert one(spark, S.summary_complete("t"), t=text) is False
    whole = "\n".join(f"## {h}\n" + "w " * 30 for h in S.SUMMARY_HEADINGS)
    assert one(spark, S.summary_complete("t"), t=whole) is True


def test_snippet_and_dependent_files(spark):
    assert one(spark, S.overview_snippet("t"), t="x\n\nOverview\na\n\n") == "a"
    assert one(spark, S.overview_snippet("t"), t="") == "No overview available."
    long = one(spark, S.overview_snippet("t"), t="Overview\n" + "a" * 250)
    assert long == "a" * 200 + "..."
    text = "z\n\nDependent Files\\n1. a.py: does: things\n- b.py: more\nc.py : rest\nd.py"
    got = [tuple(d) for d in one(spark, S.parse_dependent_files("t"), t=text)]
    assert got == [("a.py", "does: things"), ("b.py", "more"), ("c.py", "rest"), ("d.py", "")]
    assert one(spark, S.parse_dependent_files("t"), t="Dependent Files\nNo dependencies detected.") == []


def test_json(spark):
    assert one(spark, jsontext.extract_json_text("t"), t='x ```json\n[{"a":1}]\n``` y') == '[{"a":1}]'
    assert one(spark, jsontext.extract_json_text("t"), t="```json\nbroken\n``` then [1,2]") == "[1,2]"
    assert one(spark, jsontext.extract_json_text("t"), t='{"b":2}') == '{"b":2}'
    assert one(spark, jsontext.extract_json_text("t"), t="nothing") is None


def test_vectors(spark):
    a, b = F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))
    assert one(spark, vectors.score(a, b)) == pytest.approx(1 / 6)
    assert one(spark, vectors.score(a, b, "squared_l2")) == pytest.approx(1 / 26)
    assert one(spark, vectors.is_zero(F.array(F.lit(0.0), F.lit(0.0)))) is True
    with pytest.raises(Exception, match="dimension mismatch"):
        one(spark, vectors.require_dimension(a, 3))


def test_diagram_checks(spark):
    target = F.lit("Requirement Diagram")
    good = "```mermaid\ngraph TD\n A[x] --> B\n```"
    assert one(spark, diagram_text.checked_code(target, "t"), t=good) == "graph TD\n A[x] --> B"
    assert one(spark, diagram_text.checked_code(target, "t"), t="graph TD").startswith("Error: Insufficient")
    assert one(spark, diagram_text.checked_code(target, "t"), t="pie\nx").startswith("Error: Invalid")
    assert one(spark, diagram_text.checked_code(F.lit("pie"), "t"), t=good) == "Unsupported graph type: pie"
    assert one(spark, diagram_text.is_drawable("t"), t="graph LR\nA --- B") is True
    assert one(spark, diagram_text.is_drawable("t"), t="graph XX\nA --- B") is False
    assert one(spark, diagram_text.is_error("t"), t="Generation Error: Timeout") is True
    assert one(spark, diagram_text.type_mismatch("t", F.lit("Entity Relationship")), t="erDiagram x") is False


def test_running_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 4)
    for n in (0, 1, 3, 4, 5, 8, 21):
        values = spark.createDataFrame([([k * k + 1 for k in range(n)],)], "v array<long>")
        sums = values.select(arrays.running_sums(F.col("v"))).first()[0]
        assert sums == [sum(k * k + 1 for k in range(m)) for m in range(n)]
