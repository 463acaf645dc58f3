"""Subgraphs, bounded reachability, path patterns and the property-graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph
from ..session import drop_table, meeting, write_small, write_table
from .select import remove

KEY = ["graph", "id"]


def _rounds(hop: DataFrame, start: DataFrame, hops: int, seen: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(graph, id) reached in 1 to ``hops`` steps, of ``known`` only where that is given, and ``seen``; each round is written so that lineage stays short, and removed in the end."""
    frontier, visited = write_small(start, "frontier"), seen
    written = [frontier]
    for _ in range(hops):
        step = hop.join(frontier.select("graph", F.col("id").alias("source")), ["graph", "source"], "left_semi").select("graph", F.col("target").alias("id")).distinct().join(visited, KEY, "left_anti")
        if known is not None:
            step = write_small(step, "step")
            written.append(step)
            step = known.join(step, KEY, "left_semi").distinct()
        frontier = write_small(step, "frontier")
        written.append(frontier)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    out = write_small(visited, "reached")
    for table in written:
        drop_table(table)
    return out


def reachable(g: Graph, root: str, label: str, max_hops: int) -> DataFrame:
    """(graph, id): in each graph the distinct nodes 1 to ``max_hops`` edges away; the root itself only where it lies on a cycle."""
    hop = g.edge_hop.where(F.col("label") == label)
    start = hop.where(F.col("source") == root).select("graph", F.col("source").alias("id")).distinct()
    return _rounds(hop, start, max_hops, start.limit(0))


def within(g: Graph, roots: DataFrame, hops: int) -> DataFrame:
    """(graph, id): the roots that exist and all nodes up to ``hops`` first-level edges away. ``roots`` has ``id``, in all graphs, or ``graph`` too."""
    shared = [c for c in KEY if c in roots.columns]
    known = write_small(g.nodes.select(KEY).join(write_small(roots.select(shared).distinct(), "roots"), shared, "left_semi").distinct(), "roots")
    return _rounds(g.edge_hop, known, hops, known, g.nodes.select(KEY))


def subgraph(g: Graph, roots: DataFrame, hops: int = 1) -> Graph:
    """What lies within ``hops`` of the roots with whole assertion trees; edge targets beyond become bare nodes."""
    ids = within(g, roots, hops)
    nodes = g.nodes.join(ids, KEY, "left_semi")
    rows = g.assertions.join(ids.withColumnRenamed("id", "root"), ["graph", "root"], "left_semi")
    named = rows.where("id is not null").select(KEY)
    bare = rows.where("kind = 'E'").select("graph", F.col("target").alias("id")).distinct().join(ids, KEY, "left_anti").join(named, KEY, "left_anti")
    return Graph(nodes.select("graph", "id", "types").unionByName(bare.select("graph", "id", F.expr("cast(array() as array<string>)").alias("types"))), rows.select(g.assertions.columns))


def restrict(g: Graph, types: list[str], labels: list[str] | None = None) -> Graph:
    """The nodes of any of the types with the assertions on them, but only those first-level edges whose targets are among them too."""
    nodes = g.nodes.where(F.arrays_overlap("types", F.array(*map(F.lit, types))))
    ids = write_table(nodes.select(KEY).distinct(), "ids")
    rows = write_table(meeting(g.assertions, ids.withColumnRenamed("id", "root"), ["graph", "root"]).select(g.assertions.columns), "restricted")
    hops = rows.where("kind = 'E' and depth = 0").select("graph", "occ", "target", F.lit(True).alias("fits") if labels is None else F.coalesce(F.col("label").isin(labels), F.lit(False)).alias("fits"))
    outside = hops.where("not fits").unionByName(hops.where("fits").join(ids.withColumnRenamed("id", "target"), ["graph", "target"], "left_anti"))
    return remove(Graph(nodes, rows), outside.select("graph", "occ"))


def path(g: Graph, labels: list[str], distinct: bool = True) -> DataFrame:
    """(graph, source, target) of every chain of first-level edges with these labels in turn."""
    out = None
    for label in labels:
        hop = g.edge_hop.where(F.col("label") == label).select("graph", "source", "target")
        hop = hop.distinct() if distinct else hop
        out = hop if out is None else out.withColumnRenamed("target", "mid").join(hop.withColumnRenamed("source", "mid"), ["graph", "mid"]).select("graph", "source", "target")
        out = out.distinct() if distinct else out
    return out


def register_views(g: Graph, prefix: str = "") -> None:
    """Views for SQL: ``base_vertices``, ``base_edges`` (nodes and first-level edges) and ``reified_vertices``, ``reified_edges`` (assertions as vertices too)."""
    a = g.assertions
    views = {
        "base_vertices": g.nodes,
        "base_edges": g.edge_hop,
        "reified_vertices": g.nodes.select("graph", "id").union(a.select("graph", "occ")),
        "reified_edges": a.select("graph", F.coalesce("parent_occ", "root").alias("source"), F.col("occ").alias("target"), F.lit("has").alias("label")).union(a.where("kind = 'E'").select("graph", "occ", "target", F.lit("to"))),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)


def graph_table(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL over the registered views."""
    return spark.sql(sql, args=args)
