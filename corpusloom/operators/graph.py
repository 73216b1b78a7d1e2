"""Folder, file and function graph: building it and walking it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.session import cut_lineage

from .skew import ROWS_PER_SALT, hot_keys, salted_join

# A function whose name contains one of these is important.
IMPORTANT_NAMES = ["main", "run", "start", "init", "entry", "execute"]

# Rounds of a walk after which the tables written so far become one.
ROUNDS_PER_MERGE = 10


def hierarchy(
    files: DataFrame, path: str = "rel_path", root: str | None = None, keep: tuple[str, ...] = ("project_id",)
) -> DataFrame:
    """Tree rows ``id, name, type, parent, depth`` of all folders and files.

    Ignored paths are left out. Each path brings its ancestors; the
    aggregation removes repeated folders before anything is shuffled. With
    ``root`` a root row with that name is the parent of top-level entries.
    """
    own = F.col(path)
    exploded = files.where(~paths.is_ignored(path)).select(
        *keep,
        own.alias("_path"),
        F.posexplode(paths.ancestors(path)).alias("_at", "id"),
    )
    rows = exploded.groupBy(*keep, "id").agg(
        F.min("_at").cast("int").alias("_at"), F.max(F.col("id") != F.col("_path")).alias("_folder")
    )
    top = F.lit("") if root is not None else F.lit(None).cast("string")
    rows = rows.select(
        *keep,
        "id",
        paths.file_name("id").alias("name"),
        F.when(F.col("_folder"), "directory").otherwise("file").alias("type"),
        F.coalesce(paths.parent("id"), top).alias("parent"),
        (F.col("_at") + 1).alias("depth"),
    )
    if root is None:
        return rows
    name = paths.clean_folder_name(F.lit(root))
    roots = files.select(*keep).distinct() if keep else files.sparkSession.range(1).select()
    return rows.unionByName(
        roots.select(
            *keep,
            F.lit("").alias("id"),
            name.alias("name"),
            F.lit("directory").alias("type"),
            F.lit(None).cast("string").alias("parent"),
            F.lit(0).alias("depth"),
        )
    )


def hierarchy_edges(nodes: DataFrame, keep: tuple[str, ...] = ("project_id",)) -> DataFrame:
    return nodes.where(F.col("parent").isNotNull()).select(
        *keep, F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("hierarchy").alias("type")
    )


def merge_nodes(
    tree: DataFrame, files: DataFrame, facts: DataFrame, keep: tuple[str, ...] = ("project_id",)
) -> DataFrame:
    """Tree nodes, files missing from the tree, and functions; functions win.

    One row per id by a partial aggregation on the priority, flagged when the
    function's name is an important one.
    """
    base = tree.select(*keep, "id", "name", "type", "parent", F.lit(1).alias("_prio"))
    lone = files.select(
        *keep,
        F.col("rel_path").alias("id"),
        F.col("rel_path").alias("name"),
        F.lit("file").alias("type"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(0).alias("_prio"),
    )
    functions = facts.where(F.col("kind") == "function").select(
        *keep,
        F.concat_ws(":", "rel_path", "name").alias("id"),
        F.substring_index("name", ":", -1).alias("name"),
        F.lit("function").alias("type"),
        F.col("rel_path").alias("parent"),
        F.lit(2).alias("_prio"),
    )
    merged = (
        base.unionByName(lone)
        .unionByName(functions)
        .groupBy(*keep, "id")
        .agg(F.max_by(F.struct("name", "type", "parent"), "_prio").alias("_n"))
        .select(*keep, "id", "_n.*")
    )
    important = (F.col("type") == "function") & F.lower("name").rlike("|".join(IMPORTANT_NAMES))
    return merged.withColumn("important", important).withColumn(
        "type", F.when(F.col("important"), "important_function").otherwise(F.col("type"))
    )


def function_edges(facts: DataFrame, keep: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """File to function, once per declaration."""
    return facts.where(F.col("kind") == "function").select(
        *keep,
        F.col("rel_path").alias("source"),
        F.concat_ws(":", "rel_path", "name").alias("target"),
        F.lit("hierarchy").alias("type"),
    )


def all_edges(*parts: DataFrame) -> DataFrame:
    """Union with duplicates."""
    return reduce(DataFrame.unionByName, parts)


def both_ways(edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every edge seen from both of its ends: ``node, other``."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("other")),
    )
    rest = [c for c in edges.columns if c not in ("source", "target", *keep)]
    return edges.select(*keep, F.inline(ends), "source", "target", *rest)


def neighbours(edges: DataFrame, nodes: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nodes one edge away, either direction, any type; for given nodes or for all."""
    pairs = both_ways(edges, keep).select(*keep, "node", "other").distinct()
    if nodes is not None:
        pairs = pairs.join(nodes.select(*keep, "node").distinct(), [*keep, "node"], "left_semi")
    return pairs.withColumnRenamed("other", "neighbour")


def path_to_root(nodes: DataFrame, keep: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """All nodes on the way from each node up to the root.

    Above a folder or file are the folders of its path, above any other node,
    such as a function, its ``parent`` and what is above that. The last one is
    the root row (its id is empty), where the project has one. A node without
    a parent, such as a file that the tree leaves out, is a root itself.
    Nodes are written once, as finding the roots reads them once more.
    """
    nodes = cut_lineage(nodes)
    has_root = F.lit(False)
    roots = nodes.where(F.col("id") == "").select(*keep).distinct()
    if keep:
        nodes = nodes.join(roots.withColumn("_root", F.lit(True)), [*keep], "left")
        has_root = F.coalesce("_root", F.lit(False))
    elif not roots.isEmpty():
        has_root = F.lit(True)
    in_tree = F.col("type").isin("directory", "file")
    to_root = F.when(has_root, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    above = F.when(paths.is_ignored("parent"), F.array("parent")).otherwise(
        F.concat(F.reverse(paths.ancestors("parent")), to_root)
    )
    chain = (
        F.when(F.col("parent").isNull(), F.array("id"))
        .when(in_tree, F.concat(F.reverse(paths.ancestors("id")), to_root))
        .otherwise(F.concat(F.array("id"), above))
    )
    return nodes.select(*keep, "id", F.posexplode(chain).alias("step", "on_path"))


def numbered_children(nodes: DataFrame, keep: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Children of each folder numbered in the order of their names."""
    rows = nodes.where(F.col("parent").isNotNull())
    return number_within(rows, [*keep, "parent"], ["name"], "child_no")


def number_within(df: DataFrame, group: list[str], by: list[str], output: str) -> DataFrame:
    """``row_number`` per group that also holds for groups of any size.

    Rows are range-partitioned by group and order, so a large group lies in
    many partitions. Each row is numbered inside its partition, and the sizes
    of the group's earlier partitions are added. The partitioned rows are
    written once, because both steps must see the same ranges.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*group, *by).withColumn("_part", F.spark_partition_id())
    )
    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*by))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, [*group, "_part"])
        .withColumn(output, F.col("_before") + F.col("_inside"))
        .drop("_part", "_inside", "_before")
    )


def connected_components(links: DataFrame, nodes: DataFrame | None = None, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``node, class`` of all nodes in links ``a, b``: the smallest node that can be reached.

    For reachability between all nodes at once, where a walk from every start
    would give the square of a component. Labels go to neighbours, then each
    label is replaced by its own label, so long chains shrink by half in each
    round. The many links of a hub are shared out by a salt, and its one label
    is repeated for each. ``nodes``, a table with a column ``node``, adds those
    without links: each is a class of its own.
    """
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = cut_lineage(links.select("a", "b").unionByName(turned).distinct())
    hubs = hot_keys(edges, ["a"], rows_per_salt).collect()
    kind = edges.schema["a"].dataType.simpleString()
    hot = edges.sparkSession.createDataFrame(hubs, f"a {kind}, _salts int")
    labels = cut_lineage(
        edges.groupBy("a").agg(F.min("b").alias("near")).select(
            F.col("a").alias("node"), F.least("a", "near").alias("class")
        )
    )
    while True:
        told = salted_join(edges, labels.toDF("a", "heard"), ["a"], hot=hot)
        heard = told.groupBy("b").agg(F.min("heard").alias("heard"))
        nearer = cut_lineage(
            labels.join(heard.withColumnRenamed("b", "node"), "node", "left").select(
                "node", F.least("class", "heard").alias("class"), F.col("class").alias("old")
            )
        )
        if nearer.where("class <> old").isEmpty():
            break
        further = nearer.select(F.col("node").alias("class"), F.col("class").alias("next"))
        labels = cut_lineage(
            salted_join(nearer, further, ["class"], "left", rows_per_salt).select(
                "node", F.coalesce("next", "class").alias("class")
            )
        )
    if nodes is None:
        return labels
    alone = nodes.select("node").distinct().join(labels, "node", "left_anti")
    return labels.unionByName(alone.select("node", F.col("node").alias("class")))


def tree_to_root(
    nodes: DataFrame, id: str = "id", parent: str = "parent", keep: tuple[str, ...] = (), rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """``id, root, depth, cyclic`` of every node of a forest given by the parent of each node.

    Ids may be of any type and say nothing about the tree. Each round replaces
    a node's pointer by the pointer of what it points to, so the way to the root
    is walked in doubling steps: as many rounds as the depth has binary digits,
    whatever its shape. ``root`` is the last id on the way up; a parent that
    has no row of its own is one. Nodes that never come to an end lie on a
    cycle or below one: ``cyclic``, with null root and depth. Trees of
    different ``keep`` are apart; ids must be unique inside each.
    """
    up = F.coalesce(F.col(parent), F.col(id))
    rows = nodes.select(
        *keep, F.col(id).alias("id"), up.alias("up"),
        F.col(parent).isNotNull().cast("long").alias("steps"), F.col(parent).isNull().alias("done"),
    )
    current = cut_lineage(rows)
    total, reach = current.count(), 1
    while reach <= 2 * total:
        active = current.where("NOT done")
        if active.isEmpty():
            break
        further = current.select(
            *keep, F.col("id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("done").alias("_done")
        )
        # by shuffle: a side that is small enough to be sent whole would go through the driver in every round
        moved = salted_join(active, further.hint("merge"), [*keep, "up"], "left", rows_per_salt).select(
            *keep, "id", F.coalesce("_up", "up").alias("up"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_done", F.lit(True)).alias("done"),
        )
        current = cut_lineage(current.where("done").unionByName(moved))
        reach *= 2
    done = F.col("done")
    return current.select(
        *keep, "id", F.when(done, F.col("up")).alias("root"), F.when(done, F.col("steps")).alias("depth"),
        (~done).alias("cyclic"),
    )


def dependency_chain(
    edges: DataFrame,
    starts: DataFrame,
    types: tuple[str, ...] | None = ("import", "call"),
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Everything reachable from each start over edges in either direction.

    ``starts`` has a column ``node``. Result: ``start, node, hops`` and the
    edge the node was discovered by (null for the start itself). Each round
    joins the frontier with the edges, drops what was seen, and is written to
    the checkpoint folder, so plans stay short and lost executors do not
    restart the walk. Edges of hub nodes are salted once, and the few
    frontier rows that meet a hub are repeated per salt.
    """
    if types is not None:
        edges = edges.where(F.col("type").isin(list(types)))
    ends = both_ways(edges).groupBy("node", "other").agg(
        F.min(F.struct("source", "target")).alias("_e")
    )
    ends = cut_lineage(ends)
    hubs = hot_keys(ends, ["node"], rows_per_salt).collect()
    salts = F.coalesce("_salts", F.lit(1))
    if hubs:
        hub_salts = F.broadcast(ends.sparkSession.createDataFrame(hubs, "node string, _salts int"))
        ends = cut_lineage(
            ends.join(hub_salts, "node", "left").select(
                "node",
                F.pmod(F.xxhash64("other"), salts.cast("long")).cast("int").alias("_salt"),
                "other",
                "_e",
            )
        )
    frontier = cut_lineage(
        starts.select(
            F.col("node").alias("start"),
            "node",
            F.lit(0).alias("hops"),
            F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("string").alias("target"),
        ).distinct()
    )
    seen, before = frontier, None
    hops = 0
    while not frontier.isEmpty():
        # edges go both ways, so a step leads to the round before, the same round, or to something new
        recent = frontier if before is None else frontier.unionByName(before)
        hops += 1
        asking = frontier.select("start", "node")
        if hubs:
            asking = asking.join(hub_salts, "node", "left").select(
                "start", "node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
            )
        reached = (
            asking.join(ends, ["node", "_salt"] if hubs else ["node"])
            .groupBy("start", F.col("other").alias("node"))
            .agg(F.min("_e").alias("_e"))
            .join(recent.select("start", "node"), ["start", "node"], "left_anti")
            .select("start", "node", F.lit(hops).alias("hops"), "_e.source", "_e.target")
        )
        before, frontier = frontier, cut_lineage(reached)
        seen = seen.unionByName(frontier)
        if hops % ROUNDS_PER_MERGE == 0:
            seen = cut_lineage(seen)
    return seen
