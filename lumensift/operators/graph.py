"""Reachability and chains over call graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.operators import joins as J
from lumensift.operators.tables import settled


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hops): everything from which a seed can be reached (src of src ... of a seed), seeds included.

    One stored table and two joins a hop; it ends when a hop finds nothing new, as it must in a finite graph. edges are
    read in every hop: give them as a table, not as a plan that is computed anew.
    """
    edges = edges.select("src", "dst")
    seen = settled(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in count(1):
        step = edges.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = settled(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if hop % 8 == 0:
            seen = settled(seen)


def chains(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(start, chain): from each start along its smallest caller, at most depth nodes, until a node comes again."""
    caller = edges.where("src <> dst").groupBy("dst").agg(F.min("src").alias("caller"))
    caller = settled(caller)
    rows = starts.select(F.col("node").alias("start"), F.array("node").alias("chain"), F.col("node").alias("at"))
    for _ in range(depth - 1):
        step = rows.join(caller, rows["at"] == caller["dst"], "left")
        go = F.col("caller").isNotNull() & ~F.array_contains("chain", F.coalesce("caller", F.col("at")))
        rows = step.select("start", F.when(go, F.array_append("chain", F.col("caller"))).otherwise(F.col("chain")).alias("chain"), F.when(go, F.col("caller")).alias("at"))
    return rows.select("start", "chain")


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between names as edges between node ids; names that several nodes have multiply."""
    a = nodes.select(F.col("name").alias("src"), F.col("node_id").alias("from_id"))
    b = nodes.select(F.col("name").alias("dst"), F.col("node_id").alias("to_id"))
    return edges.join(a, "src").join(b, "dst").select("from_id", "to_id")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes.select("node")
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, callers): names that call it."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


def descendants(tree: DataFrame, kind: str) -> DataFrame:
    """(root, id): all nodes of a kind below each node of a tree (id, parent, type)."""
    pairs = tree.where("parent is not null").select(F.col("parent").alias("root"), "id", "type")
    out, front = pairs, pairs
    while True:
        child = tree.select(F.col("parent").alias("_p"), F.col("id").alias("_i"), F.col("type").alias("_t"))
        front = settled(front.join(child, front["id"] == child["_p"]).select("root", F.col("_i").alias("id"), F.col("_t").alias("type")))
        if front.isEmpty():
            return out.where(F.col("type") == kind).select("root", "id")
        out = out.unionByName(front)


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first by order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("_first")).select("_first.*")


def per_file(rows: DataFrame, name: str, order: list[str], file: str = "file") -> DataFrame:
    """(file, name): each file's rows as a list, in order."""
    others = [c for c in rows.columns if c != file]
    listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in others if c not in order])))
    return rows.groupBy(file).agg(listed.alias(name))


def node_id(file: str = "file", line: str = "line"):
    return F.concat_ws(":", F.col(file), F.col(line))


def whole_graph(methods: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chains, affected) of all methods (file, name, line, ord) of a folder.

    Nodes are the first method of each (file, line); an edge joins each method of a file with the one after it, as they
    came; a method's callers are all methods above it in its file; every method's name is affected, repeats included.
    """
    methods = methods.withColumn("id", node_id())
    nodes = first_of(methods, ["id"], order).select("id", "name", "file", "line")
    edges = J.next_in_group(methods.select("file", order, F.col("id").alias("name")), "file", order, "name").select(F.col("src").alias("from"), F.col("dst").alias("to"))
    above = J.earlier_in_group(methods.select("file", "line", F.struct("name", "file", "line").alias("caller")), "file", "line", "caller")
    chains = above.select(F.concat_ws(":", "file", "line").alias("id"), F.col("earlier").alias("callers")).where(F.size("callers") > 0).dropDuplicates(["id"])
    return nodes, edges, chains, methods.select(F.col("name").alias("affected"))


def changed_graph(methods: DataFrame, calls: DataFrame, changed: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chains, affected) of what changed methods (file, name, line) touch; empty without changes.

    methods: (file, name, line, ord); calls: (caller, callee) by name. chains: (id, chain) of each changed method.
    """
    edges = settled(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct())
    touched = reached(edges, changed.select(F.col("name").alias("node")))
    own = methods.join(touched.select(F.col("node").alias("name")), "name", "left_semi").withColumn("id", node_id())
    nodes = first_of(own, ["id"], order).select("id", "name", "file", "line")
    both = induced(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), touched)
    between = resolved(both, own.select("name", F.col("id").alias("node_id"))).select(F.col("from_id").alias("from"), F.col("to_id").alias("to"))
    starts = changed.select(node_id().alias("id"), F.col("name").alias("start"))
    traced = chains(edges, starts.select(F.col("start").alias("node")).distinct())
    return nodes, between, starts.join(traced, "start").select("id", "chain"), touched.select(F.col("node").alias("affected"))
