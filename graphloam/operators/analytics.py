"""Projection to vertex, edge and relational tables, graph measures and write-back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import INTERP, Graph
from ..session import drop_table, meeting, missing, ship_package, write_table
from .interp import DEFAULT, Registry, set_value
from .select import annotations, remove


def vertices(g: Graph) -> DataFrame:
    """(id, types, attrs): a node's first-level properties as a map of label to sorted values."""
    lists = g.assertions.where("kind = 'P' and depth = 0").groupBy("graph", F.col("root").alias("id"), "label").agg(F.sort_array(F.collect_list("value")).alias("values"))
    attrs = lists.groupBy("graph", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "values")))).alias("attrs"))
    return g.nodes.join(attrs, ["graph", "id"], "left")


def typed_vertices(g: Graph, registry: Registry = DEFAULT) -> DataFrame:
    """(graph, id, types, attrs): a node's first-level properties with their interpretations applied.

    ``attrs`` maps a label to its values, sorted, each with a field for every interpretation of the registry that is null
    but in the value's own; a value that breaks its contract, or has none, is text only.
    """
    rows = g.assertions.where("kind = 'P' and depth = 0")
    fields = [F.when(F.col("interp") == iri, i.read(F.col("value"))).alias(iri.rpartition("/")[2]) for iri, i in registry.items() if iri != INTERP + "text"]
    lists = rows.select("graph", F.col("root").alias("id"), "label", F.struct(F.col("value").alias("text"), "interp", *fields).alias("v")).groupBy("graph", "id", "label").agg(F.sort_array(F.collect_list("v")).alias("values"))
    attrs = lists.groupBy("graph", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "values")))).alias("attrs"))
    return g.nodes.join(attrs, ["graph", "id"], "left")


def _to_assertions(g: Graph) -> DataFrame:
    """(graph, target): the ids of assertions that first-level edges point at, written; ids and targets are made distinct before they are shuffled together."""
    ids = g.assertions.where("id is not null").select("graph", F.col("id").alias("target"), F.lit(1).alias("named"), F.lit(0).alias("aimed"))
    targets = g.edge_hop.where("target is not null").select("graph", "target", F.lit(0), F.lit(1))
    both = ids.union(targets).groupBy("graph", "target").agg(F.max("named").alias("named"), F.max("aimed").alias("aimed"))
    return write_table(both.where("named = 1 and aimed = 1").select("graph", "target"), "to-assertions")


def edges(g: Graph, attributes: bool = False) -> DataFrame:
    """(graph, occ, source, target, label) of the first-level edges between nodes; those to assertions are left out, repeated ones stay.

    With ``attributes`` each has its own properties too, as :func:`annotations` gives them.
    """
    out = missing(g.edge_hop, _to_assertions(g), ["graph", "target"]).select("graph", "occ", "source", "target", "label")
    return out.join(annotations(g).withColumnRenamed("parent_occ", "occ"), ["graph", "occ"], "left") if attributes else out


def skipped_edges(g: Graph) -> DataFrame:
    """(graph, n): how many first-level edges :func:`edges` leaves out, since an assertion is their target."""
    return meeting(g.edge_hop, _to_assertions(g), ["graph", "target"]).groupBy("graph").agg(F.count("*").alias("n"))


def degree(g: Graph) -> DataFrame:
    """(graph, id, n_in, n_out) over first-level edges between nodes, one exchange for both ends."""
    e = edges(g)
    ends = e.select("graph", F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("graph", "target", F.lit(1), F.lit(0)))
    return ends.groupBy("graph", "id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def label_propagation(edge: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): every node takes the commonest label among its neighbours in any direction, the least of equally common ones, all at once in each round, until none changes or ``rounds`` are over."""
    both = write_table(edge.select("source", "target").union(edge.select("target", "source")).where("source <> target").distinct(), "lp-edges")
    label = write_table(edge.select(F.col("source").alias("id")).union(edge.select("target")).distinct().select("id", F.col("id").alias("community")), "lp")
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id"), "community").count()
        best = votes.groupBy("id").agg(F.min(F.struct(-F.col("count"), "community")).alias("b")).select("id", F.col("b.community").alias("new"))
        new = write_table(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")), "lp")
        same = new.join(label.withColumnRenamed("community", "old"), "id").where("community <> old").isEmpty()
        drop_table(label)
        label = new
        if same:
            break
    drop_table(both)
    return label


def top_by_value(g: Graph, label: str, k: int, interp: str = INTERP + "number", type_: str | None = None) -> DataFrame:
    """(graph, id, value): the ``k`` nodes with the greatest values of a label as its interpretation reads them, ties by id; a node counts with its greatest."""
    rows = g.assertions.where((F.col("label") == label) & (F.col("kind") == "P") & (F.col("depth") == 0))
    read = rows.select("graph", F.col("root").alias("id"), DEFAULT.get_strict(interp).read(F.col("value")).alias("value")).where("value is not null")
    if type_ is not None:
        read = read.join(g.nodes.where(F.array_contains("types", type_)).select("graph", "id"), ["graph", "id"], "left_semi")
    return read.groupBy("graph", "id").agg(F.max("value").alias("value")).orderBy(F.desc("value"), "graph", "id").limit(k)


def pagerank(edge: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) by ``rounds`` of power iteration over distinct (source, target); what sinks hold is spread over all.

    The rounds know nodes by a number, their hash with the first salt that gives no two of them the same. Nodes carry their
    number of edges, so that each round joins once and what moves is a sum over the nodes.
    """
    ids = write_table(edge.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null").distinct(), "pagerank-ids")
    salt, number = 0, None
    while number is None or not ids.groupBy(number("id").alias("h")).count().where("count > 1").isEmpty():
        salt += 1
        number = lambda c, salt=salt: F.xxhash64(F.lit(salt), F.col(c))
    links = write_table(edge.where("source is not null and target is not null").select(number("source").alias("s"), number("target").alias("t")).distinct(), "pagerank-links")
    nodes = write_table(ids.select(number("id").alias("n")).join(links.groupBy(F.col("s").alias("n")).agg(F.count("*").alias("out")), "n", "left"), "pagerank-nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(rounds):
        moved = rank.where("out is not null").agg(F.sum("rank")).first()[0] or 0.0
        got = links.join(rank.select(F.col("n").alias("s"), (F.col("rank") / F.col("out")).alias("share")), "s").groupBy(F.col("t").alias("n")).agg(F.sum("share").alias("got"))
        base = (1 - damping) / max(1, n) + damping * (1 - moved) / max(1, n)
        before, rank = rank, write_table(nodes.join(got, "n", "left").select("n", "out", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "pagerank")
        if i:
            drop_table(before)
    out = ids.withColumn("n", number("id")).join(rank, "n").select("id", "rank")
    for table in (links, nodes):
        drop_table(table)
    return out


def local_components(source: pa.Array, target: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(id, component) over some edges: ids are numbered in their order, and every number takes the least that it is linked to until none changes."""
    ends = pa.concat_arrays([source, target]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    s, t = np.split(rank[ends.indices.to_numpy()], 2)
    label = np.arange(len(order))
    while True:
        a, b = label[s], label[t]
        if (a == b).all():
            break
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != label[label]).any():
            label = label[label]
    ids = ends.dictionary.take(pa.array(order))
    return ids, ids.take(pa.array(label))


def _forest(edge: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(id, component) of each million edges of a task, alone."""
    ship_package(edge.sparkSession)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                yield close(held)
                held, n = [], 0
        if n:
            yield close(held)

    def close(held):
        both = (pa.concat_arrays([b.column(i).cast(pa.large_string()) for b in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in local_components(*both)], ["id", "component"])

    return edge.select("source", "target").where("source is not null and target is not null").mapInArrow(run, "id string, component string")


def connected_components(edge: DataFrame) -> DataFrame:
    """(id, component): the least id that a path in any direction leads to.

    Every task settles the edges that it has, so that each node is shuffled once with its component there; where a node has several, these are joined in rounds.
    """
    held = write_table(_forest(edge).groupBy("id").agg(F.array_sort(F.collect_set("component")).alias("held")), "component-parts")
    links = write_table(held.where("size(held) > 1").select(F.col("held")[0].alias("source"), F.explode("held").alias("target")).where("source <> target").distinct(), "component-links")
    if links.isEmpty():
        return held.select("id", F.col("held")[0].alias("component"))
    joined = _component_rounds(links).select(F.col("id").alias("first"), "component")
    found = held.select("id", F.col("held")[0].alias("first")).join(joined, "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    drop_table(links)
    return found


def _component_rounds(edge: DataFrame) -> DataFrame:
    """The same by rounds: each takes the least of the neighbours' labels and of the label's own label."""
    both = edge.select("source", "target").union(edge.select("target", "source")).distinct()
    both = write_table(both, "component-edges")
    label = write_table(both.groupBy(F.col("source").alias("id")).agg(F.least(F.min("target"), F.col("id")).alias("component")), "components")
    while True:
        near = both.join(label.select(F.col("id").alias("target"), "component"), "target").groupBy(F.col("source").alias("id")).agg(F.min("component").alias("c"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("j"))
        new = write_table(label.join(near, "id").join(jump, "component", "left").select("id", F.least("component", "c", F.coalesce("j", "component")).alias("component")), "components")
        settled = new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty()
        drop_table(label)
        if settled:
            drop_table(both)
            return new
        label = new


def write_back(g: Graph, label: str, values: DataFrame, interp: str | None, replace: bool = True) -> Graph:
    """Results (id, value) or (graph, id, value) become properties of the nodes that exist, in place of earlier ones with the label and all that hangs on those; :func:`written` counts them."""
    values = write_table(values.where("value is not null"), "values")
    if replace:
        key = [c for c in ("graph", "id") if c in values.columns]
        old = g.assertions.where((F.col("label") == label) & (F.col("depth") == 0) & (F.col("kind") == "P")).withColumn("id", F.col("root"))
        g = remove(g, old.join(values.select(key), key, "left_semi").select("graph", "occ"))
    return set_value(g, values, label, interp)


def written(g: Graph, values: DataFrame) -> int:
    """How many properties :func:`write_back` writes: one for each value on a node that exists."""
    key = [c for c in ("graph", "id") if c in values.columns]
    return values.where("value is not null").join(g.nodes.select("graph", "id"), key).count()


def project(g: Graph, type_: str, columns: dict[str, tuple[str, str | None]], broken: str = "null") -> DataFrame:
    """(graph, id, the columns): a relational table of the nodes of a type: ``columns`` maps a name to (label, interpretation).

    The least value counts where a label repeats. ``broken`` says what becomes of a value that breaks its contract: null,
    skip (the row goes) or error.
    """
    wanted = [label for label, _ in columns.values()]
    props = g.assertions.where(F.col("label").isin(wanted) & (F.col("kind") == "P") & (F.col("depth") == 0)).groupBy("graph", "root").pivot("label", wanted).agg(F.min("value"))
    out = g.nodes.where(F.array_contains("types", type_)).select("graph", F.col("id").alias("root")).join(props, ["graph", "root"], "left")
    typed, bad = [], F.lit(False)
    for name, (label, interp) in columns.items():
        v = F.col(f"`{label}`")
        typed.append((DEFAULT[interp].read(v) if interp else v).alias(name))
        if interp:
            bad = bad | (v.isNotNull() & ~DEFAULT[interp].check(v))
    if broken == "skip":
        out = out.where(~bad)
    elif broken == "error" and not out.where(bad).isEmpty():
        raise ValueError("a value breaks its contract")
    return out.select("graph", F.col("root").alias("id"), *typed)
