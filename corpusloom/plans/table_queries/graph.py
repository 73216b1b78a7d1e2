"""Folder trees, project graph and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import graph
from corpusloom.plans.analysis import graph_nodes, project_graph

from .base import SQL_DEPENDENCIES, Query, code_files, sql_text, table
from .code import SQL_PYTHON, dependency_table, javascript_files, python_files


def _page_paths(spark, sf_dir):
    """Addresses as paths: host, then folders."""
    path = F.rtrim(F.regexp_extract("url", "^https?://([^?#]*)", 1), F.lit("/"))
    return table(spark, sf_dir, "pages").select(path.alias("rel_path"))


_IGNORE = sql_text("|".join(f"(?:{p})" for p in paths.IGNORE_PATTERNS))
_SQL_TREE = f"""
page_paths AS (SELECT rtrim(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS path FROM pages),
prefixes AS (
  SELECT path, n, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS id
  FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM page_paths)),
ignored AS (
  SELECT DISTINCT path FROM prefixes
  WHERE regexp_matches(id, {_IGNORE}) OR starts_with(regexp_replace(id, '^.*/', ''), '.')),
tree AS (
  SELECT id, regexp_replace(id, '^.*/', '') AS name,
    CASE WHEN bool_or(id <> path) THEN 'directory' ELSE 'file' END AS type,
    CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') END AS parent, min(n) AS depth
  FROM prefixes WHERE path NOT IN (SELECT path FROM ignored) GROUP BY id)"""


def hierarchy(spark, sf_dir):
    return graph.hierarchy(_page_paths(spark, sf_dir), keep=())


def child_order(spark, sf_dir):
    nodes = graph.hierarchy(_page_paths(spark, sf_dir), keep=())
    return graph.numbered_children(nodes, keep=()).select("parent", "id", "child_no")


def path_to_root(spark, sf_dir):
    nodes = graph.hierarchy(_page_paths(spark, sf_dir), keep=())
    return graph.path_to_root(nodes, keep=()).select("id", "step", "on_path")


def _dependency_edges(spark, sf_dir):
    deps = dependency_table(spark, sf_dir)
    project = lambda c: F.concat_ws("/", "project_id", c)
    return deps.select(
        project("src_path").alias("source"), project("target_path").alias("target"), F.lit("import").alias("type")
    )


def neighbours(spark, sf_dir):
    return graph.neighbours(_dependency_edges(spark, sf_dir)).select("node", "neighbour")


def reachability(spark, sf_dir):
    """What the first file of each project reaches."""
    starts = code_files(spark, sf_dir).groupBy("project_id").agg(F.min("rel_path").alias("p"))
    starts = starts.select(F.concat_ws("/", "project_id", "p").alias("node"))
    walk = graph.dependency_chain(_dependency_edges(spark, sf_dir), starts)
    return walk.select("start", "node", "hops")


def reachability_hubs(spark, sf_dir):
    """The same walk with nodes of more than 20 edges spread over several tasks."""
    starts = code_files(spark, sf_dir).groupBy("project_id").agg(F.min("rel_path").alias("p"))
    starts = starts.select(F.concat_ws("/", "project_id", "p").alias("node"))
    walk = graph.dependency_chain(_dependency_edges(spark, sf_dir), starts, rows_per_salt=20)
    return walk.select("start", "node", "hops")


def components(spark, sf_dir):
    links = _dependency_edges(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b"))
    return graph.connected_components(links).select("node", F.col("class").alias("component"))


def _graph_files(spark, sf_dir):
    """German and Spanish files as Python, the others as JavaScript."""
    python = python_files(spark, sf_dir).where(F.col("rel_path").rlike("^(de|es)/"))
    script = javascript_files(spark, sf_dir).where(~F.col("rel_path").rlike("^(de|es)/"))
    return python.unionByName(script)


def project_nodes(spark, sf_dir):
    return graph_nodes(_graph_files(spark, sf_dir))


def path_to_root_graph(spark, sf_dir):
    nodes = graph_nodes(_graph_files(spark, sf_dir), root="proj")
    return graph.path_to_root(nodes).select("project_id", "id", "step", "on_path")


def project_edges(spark, sf_dir):
    return project_graph(_graph_files(spark, sf_dir), counted=True)[1]


_SQL_EDGES = SQL_DEPENDENCIES + """,
edges AS (SELECT project_id || '/' || src_path AS source, project_id || '/' || target_path AS target FROM dependencies),
ends AS (SELECT source AS node, target AS other FROM edges UNION SELECT target, source FROM edges)"""

_SQL_GRAPH = SQL_PYTHON + f""",
all_facts AS (
  SELECT project_id, rel_path, kind, name, caller FROM facts WHERE regexp_matches(rel_path, '^(de|es)/')
  UNION ALL
  SELECT project_id, rel_path, kind, CASE WHEN kind = 'import' THEN './' || substr(name, 3) ELSE name END, caller
  FROM facts WHERE NOT regexp_matches(rel_path, '^(de|es)/')),
parts AS (
  SELECT project_id, rel_path, n, array_to_string(list_slice(string_split(rel_path, '/'), 1, n), '/') AS id
  FROM (SELECT project_id, rel_path, unnest(range(1, len(string_split(rel_path, '/')) + 1)) AS n FROM code_files)),
dropped AS (
  SELECT DISTINCT project_id, rel_path FROM parts
  WHERE regexp_matches(id, {_IGNORE}) OR starts_with(regexp_replace(id, '^.*/', ''), '.')),
tree AS (
  SELECT project_id, id, regexp_replace(id, '^.*/', '') AS name,
    CASE WHEN bool_or(id <> rel_path) THEN 'directory' ELSE 'file' END AS type,
    CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') END AS parent
  FROM parts p WHERE NOT EXISTS (
    SELECT 1 FROM dropped d WHERE d.project_id = p.project_id AND d.rel_path = p.rel_path)
  GROUP BY project_id, id)"""
_IMPORTANT = "regexp_matches(lower(name), 'main|run|start|init|entry|execute')"

_SQL_NODES = f"""
SELECT project_id, id, name, type, parent, false AS important FROM tree
UNION ALL SELECT project_id, rel_path, rel_path, 'file', NULL, false FROM dropped
UNION ALL SELECT DISTINCT project_id, rel_path || ':' || name, name,
  CASE WHEN {_IMPORTANT} THEN 'important_function' ELSE 'function' END, rel_path, {_IMPORTANT}
FROM all_facts WHERE kind = 'function'"""

_SQL_WALK = f"""WITH RECURSIVE {_SQL_EDGES},
walk AS (
  SELECT project_id || '/' || min(rel_path) AS start, project_id || '/' || min(rel_path) AS node, 0 AS hops
  FROM code_files GROUP BY project_id
  UNION
  SELECT w.start, e.other, w.hops + 1 FROM walk w JOIN ends e ON e.node = w.node WHERE w.hops < 30)"""

QUERIES = {
    "components": Query(
        components,
        f"""WITH RECURSIVE {_SQL_EDGES},
reach AS (
  SELECT node, node AS other FROM ends
  UNION
  SELECT r.node, e.other FROM reach r JOIN ends e ON e.node = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node""",
    ),
    "hierarchy": Query(hierarchy, f"WITH {_SQL_TREE} SELECT id, name, type, parent, depth FROM tree"),
    "child_order": Query(
        child_order,
        f"""WITH {_SQL_TREE}
SELECT parent, id, row_number() OVER (PARTITION BY parent ORDER BY name) AS child_no
FROM tree WHERE parent IS NOT NULL""",
    ),
    "path_to_root": Query(
        path_to_root,
        f"""WITH {_SQL_TREE}
SELECT id, len(string_split(id, '/')) - n AS step,
  array_to_string(list_slice(string_split(id, '/'), 1, n), '/') AS on_path
FROM (SELECT id, unnest(range(1, len(string_split(id, '/')) + 1)) AS n FROM tree)""",
    ),
    "neighbours": Query(
        neighbours, f"WITH {_SQL_EDGES} SELECT node, other AS neighbour FROM ends"
    ),
    "reachability": Query(
        reachability,
        _SQL_WALK
        + """
SELECT start, node, min(hops) AS hops FROM walk GROUP BY start, node""",
    ),
    "reachability_hubs": Query(
        reachability_hubs,
        _SQL_WALK
        + """
SELECT start, node, min(hops) AS hops FROM walk GROUP BY start, node""",
    ),
    "project_nodes": Query(project_nodes, f"WITH {_SQL_GRAPH} {_SQL_NODES}"),
    "path_to_root_graph": Query(
        path_to_root_graph,
        f"""WITH RECURSIVE {_SQL_GRAPH},
nodes AS ({_SQL_NODES}),
linked AS (
  SELECT project_id, id, CASE WHEN parent IS NULL AND (project_id, id) NOT IN (SELECT project_id, rel_path FROM dropped)
    THEN '' ELSE parent END AS parent FROM nodes
  UNION ALL SELECT DISTINCT project_id, '', NULL FROM code_files),
walk AS (
  SELECT project_id, id, 0 AS step, id AS on_path, parent FROM linked
  UNION ALL
  SELECT w.project_id, w.id, w.step + 1, n.id, n.parent
  FROM walk w JOIN linked n ON n.project_id = w.project_id AND n.id = w.parent)
SELECT project_id, id, step, on_path FROM walk""",
    ),
    "project_edges": Query(
        project_edges,
        f"""WITH {_SQL_GRAPH},
edges AS (
  SELECT project_id, parent AS source, id AS target, 'hierarchy' AS type FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT project_id, rel_path, rel_path || ':' || name, 'hierarchy' FROM all_facts WHERE kind = 'function'
  UNION ALL SELECT i.project_id, i.rel_path, f.rel_path, 'import' FROM all_facts i JOIN code_files f
    ON i.kind = 'import' AND f.project_id = i.project_id
    AND contains(f.rel_path, list_last(string_split(i.name, '.')))
  UNION ALL SELECT c.project_id, c.rel_path || ':' || c.caller, c.rel_path || ':' || c.name, 'call'
  FROM all_facts c JOIN all_facts f ON c.kind = 'call' AND f.kind = 'function'
    AND f.project_id = c.project_id AND f.rel_path = c.rel_path AND f.name = c.name)
SELECT project_id, source, type, count(*) AS edges, count(DISTINCT target) AS targets, min(target) AS first
FROM edges GROUP BY project_id, source, type""",
    ),
}

