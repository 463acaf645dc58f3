"""Pattern selection with wildcards, annotated matches, traversal and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph, IdConflictError
from ..session import meeting, missing, write_table


def select(g: Graph, origin=None, label=None, *, value=None, target=None, id=None, deep=False, parent=None, graph=None) -> DataFrame:
    """Assertions that fit all that is given; None is a wildcard. Shallow selection sees first-level rows only, and repeated rows stay."""
    if value is not None and target is not None:
        raise ValueError("an assertion has a value or a target, not both")
    a = g.assertions
    if value is not None or target is not None:
        a = a.where(F.col("kind") == ("P" if value is not None else "E"))
    if not deep:
        a = a.where("depth = 0")
    for column, wanted in (("graph", graph), ("origin", origin), ("label", label), ("value", value), ("target", target), ("id", id), ("parent_occ", parent)):
        if wanted is not None:
            a = a.where(F.col(column) == wanted)
    return a


def annotations(g: Graph) -> DataFrame:
    """(graph, parent_occ, annotations): each assertion's own properties, the greatest value where a label repeats; in one exchange."""
    said = g.assertions.where("depth > 0 and kind = 'P' and parent_occ is not null").groupBy("graph", "parent_occ").agg(F.array_sort(F.collect_list(F.struct("label", "value"))).alias("said"))
    greatest = F.filter("said", lambda e, i: F.coalesce(F.get("said", i + 1)["label"] != e["label"], F.lit(True)))
    return said.select("graph", "parent_occ", F.map_from_entries(greatest).alias("annotations"))


def annotation_lists(g: Graph) -> DataFrame:
    """(graph, parent_occ, annotations): each assertion's own properties with all values of a label, sorted."""
    per_label = g.assertions.where("depth > 0 and kind = 'P'").groupBy("graph", "parent_occ", "label").agg(F.sort_array(F.collect_list("value")).alias("values"))
    return per_label.groupBy("graph", "parent_occ").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "values")))).alias("annotations"))


def match(g: Graph, origin=None, label=None, graph=None) -> DataFrame:
    """(origin, relation, target, annotations) of first-level assertions; ``target`` is the value for properties."""
    rows = select(g, origin, label, graph=graph)
    noted = rows.join(annotations(g).withColumnRenamed("parent_occ", "occ"), ["graph", "occ"], "left")
    return noted.select("occ", "origin", F.col("label").alias("relation"), F.coalesce("target", "value").alias("target"), F.coalesce("annotations", F.expr("cast(map() as map<string,string>)")).alias("annotations"))


def traverse(g: Graph, origin: str, label: str) -> DataFrame:
    return select(g, origin, label).where("kind = 'E'")


def reverse(g: Graph, target: str, label: str) -> DataFrame:
    return select(g, label=label, target=target)


def typematch(g: Graph, types: list[str]) -> DataFrame:
    """Nodes of any of the types."""
    return g.nodes.where(F.arrays_overlap("types", F.array(*map(F.lit, types))))


def remove(g: Graph, gone: DataFrame) -> Graph:
    """The graph without the rows of ``gone`` (graph, occ) and everything below them, a level at a time.

    What goes is written and, where it is little, broadcast; else a bitmap of it spares the other rows the shuffle.
    """
    key = ["graph", "occ"]
    gone = lost = write_table(gone.select(key).distinct(), "gone")
    deepest = 0 if lost.isEmpty() else g.assertions.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest):
        lost = write_table(meeting(g.assertions.where("parent_occ is not null"), lost.withColumnRenamed("occ", "parent_occ"), ["graph", "parent_occ"]).select(key), "gone")
        if lost.isEmpty():
            break
        gone = gone.unionByName(lost)
    return Graph(g.nodes, missing(g.assertions, gone, key).select(g.assertions.columns))


def remove_skeleton(g: Graph, origin: str, label: str, payload: str) -> Graph:
    """Without all anonymous first-level rows of this origin, label and payload, whatever their interpretation, and all below."""
    return remove(g, select(g, origin, label).where((F.coalesce("target", "value") == payload) & F.col("id").isNull()))


def drop_node(g: Graph, node: str, graph: str | None = None) -> Graph:
    """Without the node and its own assertions, in one graph or all; edges to it stay."""
    other = F.lit(False) if graph is None else F.col("graph") != graph
    return Graph(g.nodes.where(other | (F.col("id") != node)), g.assertions.where(other | (F.col("root") != node)))


def put_node(g: Graph, graph: str, node: str, types: list[str]) -> Graph:
    """A new node in place of any with this id in this graph."""
    row = g.nodes.sparkSession.createDataFrame([(graph, node, sorted(set(types)))], g.nodes.schema)
    left = drop_node(g, node, graph)
    return Graph(left.nodes.unionByName(row), left.assertions)


def _added(g: Graph, rows: DataFrame, kind: str) -> Graph:
    """Rows of (root or parent, label, payload, id, interp) as assertions; ids that are taken raise."""
    given = [c for c in ("graph", "origin", "parent_occ", "label", "payload", "id", "interp") if c in rows.columns]
    lone = g.nodes.select("graph").distinct().limit(2).collect() if "graph" not in given else []
    if len(lone) > 1:
        raise ValueError("several graphs: say which")
    null = F.lit(None).cast("string")
    full = rows.select(*given, *(null.alias(c) for c in ("origin", "parent_occ", "id", "interp") if c not in given), *([] if "graph" in given else [F.lit(lone[0][0] if lone else None).cast("string").alias("graph")]))
    full = full.withColumn("occ", F.expr("uuid()"))
    full = write_table(full, "added")
    above = F.lit(None).cast
    if "parent_occ" in given:
        parents = meeting(g.assertions.select("graph", F.col("occ").alias("parent_occ"), F.col("root").alias("above_root"), F.col("id").alias("above_id"), F.col("depth").alias("above")), full.where("parent_occ is not null"), ["graph", "parent_occ"])
        joined = full.join(parents, ["graph", "parent_occ"], "left")
    else:
        joined = full.withColumns({"above_root": above("string"), "above_id": above("string"), "above": above("int")})
    if not joined.where("parent_occ is not null and above is null or parent_occ is null and origin is null").isEmpty():
        raise KeyError("an assertion needs a node or an assertion that exists")
    if "id" in given:
        register_ids(g, full.where("id is not null").select("graph", "id"))
    done = joined.select(
        "graph", "occ", "parent_occ", F.coalesce("above_root", "origin").alias("root"), F.coalesce(F.col("above") + 1, F.lit(0)).alias("depth"), F.lit(kind).alias("kind"), F.when(F.col("parent_occ").isNull(), F.col("origin")).otherwise(F.col("above_id")).alias("origin"), "label",
        (F.col("payload") if kind == "E" else null).alias("target"), (F.col("payload") if kind == "P" else null).alias("value"), "id", "interp",
    )
    ends = done.where("depth = 0").select("graph", F.col("root").alias("id"))
    ends = ends.union(done.select("graph", F.col("target").alias("id"))) if kind == "E" else ends
    known = g.nodes.select("graph", "id").union(g.assertions.where("id is not null").select("graph", "id"))
    fresh = ends.distinct().join(known, ["graph", "id"], "left_anti").select("graph", "id", F.expr("cast(array() as array<string>)").alias("types"))
    return Graph(g.nodes.unionByName(fresh), g.assertions.unionByName(done))


def add_property(g: Graph, rows: DataFrame) -> Graph:
    """With a property for each row: ``origin`` (a node) or ``parent_occ`` (an assertion), ``label``, ``payload``, and at will ``graph``, ``id``, ``interp``. Nodes are made where there are none."""
    return _added(g, rows, "P")


def add_edge(g: Graph, rows: DataFrame) -> Graph:
    """The same for edges, whose ``payload`` is the target; one that names no node and no assertion becomes a bare node."""
    return _added(g, rows, "E")


def register_ids(g: Graph, ids: DataFrame) -> None:
    """Raise where an id of ``ids`` (graph, id) is given twice, or names a node or an assertion already."""
    taken = g.nodes.select("graph", "id").union(g.assertions.where("id is not null").select("graph", "id"))
    bad = ids.join(taken, ["graph", "id"], "left_semi").union(ids.groupBy("graph", "id").count().where("count > 1").select("graph", "id")).limit(5).collect()
    if bad:
        raise IdConflictError("taken: " + ", ".join(r.id for r in bad))


def getprop(g: Graph, node: str, label: str, graph: str | None = None) -> DataFrame:
    """The node's own properties of this label."""
    return select(g, node, label, graph=graph).where("kind = 'P'")


def getedge(g: Graph, node: str, label: str, graph: str | None = None) -> DataFrame:
    """The node's own edges of this label."""
    return select(g, node, label, graph=graph).where("kind = 'E'")
