"""Schemas, vocabulary and the graph: two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import write_small

BASE = "http://example.org/loam/"
INTERP = BASE + "interp/"
RESERVED = ("number", "datetime", "boolean", "iri", "text")
DOCUMENT = BASE + "Document"
SOURCE = BASE + "source"

NODES = "graph string, id string, types array<string>"
ASSERTIONS = "graph string, occ string, parent_occ string, root string, depth int, kind string, origin string, label string, target string, value string, id string, interp string"
COLUMNS = [c.split()[0] for c in ASSERTIONS.split(", ")]


class GraphMergeError(ValueError):
    """Two rows with one ``@id`` that can't be the same assertion."""


class IdConflictError(ValueError):
    """An id that names both a node and an assertion, or two assertions."""


@dataclass
class Graph:
    """Nodes and assertions; ``kind`` is E for edges (with ``target``) and P for properties (with ``value``).

    An assertion on another has ``parent_occ``, and ``origin`` is then that one's id or null.
    """

    nodes: DataFrame
    assertions: DataFrame

    @property
    def edge_hop(self) -> DataFrame:
        return self.assertions.where("kind = 'E' and depth = 0").select("graph", "occ", F.col("origin").alias("source"), "target", "label")

    def payload(self) -> DataFrame:
        return self.assertions.withColumn("payload", F.coalesce("target", "value"))


def structure_faults(g: Graph) -> DataFrame:
    """(occ, fault) of every row that breaks the model: an edge without target, a property without value, an orphan, a wrong depth."""
    a = g.assertions
    own = a.select(
        "occ",
        F.when((F.col("kind") == "E") & F.col("target").isNull(), "edge without target")
        .when((F.col("kind") == "P") & F.col("value").isNull(), "property without value")
        .when(~F.col("kind").isin("E", "P") | F.col("kind").isNull(), "unknown kind")
        .when((F.col("depth") == 0) != F.col("parent_occ").isNull(), "wrong depth")
        .alias("fault"),
    ).where("fault is not null")
    nested = a.where("parent_occ is not null")
    parents = a.select("graph", F.col("occ").alias("parent_occ"), F.col("depth").alias("above"))
    doubt = write_small(_doubtful(nested, parents), "doubt")
    if doubt.isEmpty():
        return own
    near = lambda df: df.withColumns(_known("parent_occ")).join(doubt, ["graph", "known1", "known2"], "left_semi").drop("known1", "known2")
    judged = near(nested.select("graph", "occ", "parent_occ", "depth")).join(near(parents), ["graph", "parent_occ"], "left")
    return own.union(judged.where("above is null or above + 1 <> depth").select("occ", F.when(F.col("above").isNull(), "orphan").otherwise("wrong depth")))


def _known(column: str) -> dict:
    """An occurrence as 128 bits."""
    return {f"known{i}": F.xxhash64(F.lit(i), F.col(column)) for i in (1, 2)}


def _doubtful(nested: DataFrame, parents: DataFrame) -> DataFrame:
    """(graph, known1, known2) of the parents of rows that may be faulty: all but those that are there once and one level above every row.

    Rows as deep as the deepest are no parents here, which only puts more in doubt. A parent and its rows are counted before they are shuffled.
    """
    deepest = nested.agg(F.max("depth")).first()[0]
    up = parents.where(F.col("above") < deepest) if deepest is not None else parents.limit(0)
    sides = nested.select("graph", "parent_occ", F.lit(None).cast("int").alias("above"), "depth").unionByName(up.select("graph", "parent_occ", "above", F.lit(None).cast("int").alias("depth")))
    sides = sides.withColumns(_known("parent_occ")).groupBy("graph", "known1", "known2")
    sides = sides.agg(F.count("above").alias("n"), F.count(F.when(F.col("above").isNull(), 1)).alias("rows"), F.min("above").alias("above"), F.count("depth").alias("deep"), F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    return sides.where("rows > 0 and not coalesce(n = 1 and deep = rows and lo = above + 1 and hi = above + 1, false)").select("graph", "known1", "known2")
