"""Functions, calls and imports of Python and JavaScript files.

Output rows: ``rel_path, kind (import|function|call), name, caller, pos``.
"""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.strings import find_all, let

SYMBOL_FIELDS = "kind string, name string, caller string, pos int"

# Facts are handed to Spark so many at a time.
FACT_ROWS = 20_000


Fact = tuple[str, str, str | None]


def _in_source_order(tree: ast.AST) -> Iterator[ast.AST]:
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        yield node
        waiting.extend(reversed(list(ast.iter_child_nodes(node))))


def _called_names(function: ast.FunctionDef) -> Iterator[str]:
    for node in ast.walk(function):
        match node:
            case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
                yield name


def _facts(source: str) -> list[Fact] | None:
    """Facts of a piece of source, or null when it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    facts: list[Fact] = []
    for node in _in_source_order(tree):
        match node:
            case ast.Import(names=names):
                facts += [("import", alias.name, None) for alias in names]
            case ast.ImportFrom(module=str(module)):
                facts.append(("import", module, None))
            case ast.FunctionDef(name=name):
                facts.append(("function", name, None))
                facts += [("call", called, name) for called in _called_names(node)]
    return facts


def numbered_facts(source: str) -> Iterator[tuple[str, str, str | None, int]]:
    """Facts of one file, numbered per kind; with a syntax error, those of its blocks that parse.

    Calls inside a nested function count for it and for the functions around
    it. Asynchronous functions are no functions here.
    """
    facts = _facts(source)
    if facts is None:
        blocks = re.split(r"^(?=def |class )", source, flags=re.MULTILINE)[1:]
        facts = [fact for block in blocks for fact in _facts(block) or []]
    counters = {kind: itertools.count() for kind in ("import", "function", "call")}
    return ((kind, name, caller, next(counters[kind])) for kind, name, caller in facts)


def python_facts(source: str) -> list[tuple[str, str, str | None, int]]:
    return list(numbered_facts(source))


def python_symbols(
    files: DataFrame, path: str = "rel_path", text: str = "text", keep: tuple[str, ...] = ("project_id",)
) -> DataFrame:
    """Parse each Python file in the task that holds it.

    Spark has no expression that parses Python, so this is an Arrow job. No
    shuffle: rows in, rows out, partition by partition.
    """
    columns = [*keep, path]

    names = [*columns, "kind", "name", "caller", "pos"]

    def piece(batch: pa.RecordBatch, owners: list[int], facts: list[tuple]) -> pa.RecordBatch:
        keys = [c.take(pa.array(owners, pa.int32())) for c in batch.columns[:-1]]
        found = zip(*facts) if facts else [[]] * 4
        texts = [pa.array(c, kind) for c, kind in zip(found, (pa.string(), pa.string(), pa.string(), pa.int32()))]
        return pa.record_batch([*keys, *texts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch may hold thousands of files: one text at a time is a Python object, and facts leave in pieces
        for batch in batches:
            owners, facts = [], []
            for at in range(len(batch)):
                for fact in numbered_facts(batch.column(len(columns))[at].as_py() or ""):
                    owners.append(at)
                    facts.append(fact)
                    if len(facts) >= FACT_ROWS:
                        yield piece(batch, owners, facts)
                        owners, facts = [], []
            yield piece(batch, owners, facts)

    source = files.where(F.col("language") == "Python").select(*columns, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{fields}, {SYMBOL_FIELDS}").withColumnRenamed(path, "rel_path")


# Patterns for JavaScript imports, function headers and calls.
JS_IMPORT = r"""import\s+(?:[\w*{}, ]+\s+from\s+)?['"]([\w\-/\.]+)['"]"""
JS_FUNCTION = r"function\s+(\w+)\s*\("
JS_FUNCTION_WITH_BODY = r"function\s+(\w+)(?=\s*\([^)]*\)\s*\{([^}]*)\})"
JS_CALL = r"(\w+)\s*\("


def javascript_symbols(
    files: DataFrame, path: str = "rel_path", text: str = "text", keep: tuple[str, ...] = ("project_id",)
) -> DataFrame:
    """Regex facts of JavaScript files.

    A function's body is what follows its first header up to the first
    closing brace. A body may hold further headers, so it is matched as a
    look-ahead and the scan goes on right after the header's name. A name
    declared twice reads its body twice. Imports and declarations are found
    inside each row; bodies are brought to their names by one aggregation, as
    looking each name up in a list of bodies would be quadratic.
    """
    source = files.where(F.col("language") == "JavaScript").select(
        *keep, F.col(path).alias("rel_path"), F.col(text).alias("_text")
    )
    keys = [*keep, "rel_path"]

    def facts(kind: str, names: Column) -> Column:
        nobody = F.lit(None).cast("string")
        return F.transform(
            names,
            lambda n, i: F.struct(F.lit(kind).alias("kind"), n.alias("name"), nobody.alias("caller"), i.alias("pos")),
        )

    names = find_all("_text", JS_FUNCTION, 1)
    found = source.select(
        *keys,
        F.inline(F.concat(facts("import", find_all("_text", JS_IMPORT, 1)), facts("function", names))),
    )
    none = F.lit(None).cast("string")
    uses = F.concat(
        F.transform(names, lambda n, i: F.struct(n.alias("caller"), i.alias("at"), none.alias("body"))),
        F.zip_with(
            find_all("_text", JS_FUNCTION_WITH_BODY, 1),
            F.transform(find_all("_text", JS_FUNCTION_WITH_BODY, 2), lambda b, i: F.struct(b.alias("b"), i.alias("i"))),
            lambda n, x: F.struct(n.alias("caller"), x["i"].alias("at"), x["b"].alias("body")),
        ),
    )
    bodies = (
        source.select(*keys, F.inline(uses))
        .groupBy(*keys, "caller")
        .agg(
            F.count_if(F.col("body").isNull()).cast("int").alias("_times"),
            F.min(F.when(F.col("body").isNotNull(), F.struct("at", "body")))["body"].alias("_body"),
        )
    )
    called = F.flatten(F.array_repeat(find_all("_body", JS_CALL, 1), F.col("_times")))
    calls = bodies.select(*keys, "caller", F.posexplode(called).alias("pos", "name"))
    return found.unionByName(calls.select(*keys, F.lit("call").alias("kind"), "name", "caller", "pos"))


def symbols(files: DataFrame, **options) -> DataFrame:
    return python_symbols(files, **options).unionByName(javascript_symbols(files, **options))


# A call is repeated in pieces of so many, as an array in one row has its bounds.
_REPEATS = 10_000


def counted_call_edges(facts: DataFrame, keep: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Calls of functions declared in the same file, one row for each caller and name, with how many ``times``.

    Both sides are counted first, so the join meets a name once per caller of
    its own file; a call met m times to a name declared n times counts m * n.
    """
    calls = (
        facts.where(F.col("kind") == "call")
        .groupBy(*keep, "rel_path", "name", "caller")
        .agg(F.count(F.lit(1)).alias("_calls"))
    )
    functions = (
        facts.where(F.col("kind") == "function")
        .groupBy(*keep, "rel_path", "name")
        .agg(F.count(F.lit(1)).alias("_declared"))
    )
    return calls.join(functions, [*keep, "rel_path", "name"]).select(
        *keep,
        F.concat_ws(":", "rel_path", "caller").alias("source"),
        F.concat_ws(":", "rel_path", "name").alias("target"),
        F.lit("call").alias("type"),
        (F.col("_calls") * F.col("_declared")).alias("times"),
    )


def call_edges(facts: DataFrame, keep: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """The same with a row for each time."""
    edges = counted_call_edges(facts, keep).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {_REPEATS}")))
    )
    of_piece = F.least(F.lit(_REPEATS).cast("long"), F.col("times") - F.col("_piece") * _REPEATS).cast("int")
    return edges.withColumn("_n", F.explode(F.array_repeat(F.lit(0), of_piece))).drop("_n", "_piece", "times")
