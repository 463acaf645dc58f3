"""DOT and Mermaid diagrams, one text line a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Graph
from ..session import write_table


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def _last(iri: Column) -> Column:
    return F.regexp_extract(iri, "([^/#]*)$", 1)


def dot_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def mermaid_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit("<br/>")), F.lit('"'))


def dot_lines(g: Graph, most: int = 50) -> DataFrame:
    """(part, line) of a DOT digraph: nodes with their types, then first-level edges; ``part`` orders them."""
    nodes = g.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), dot_quote(F.col("id")), F.lit(" [label="), dot_quote(clip(F.concat_ws(" ", _last(F.col("id")), F.concat(F.lit(": "), F.array_join(F.transform("types", _last), ", "))), most)), F.lit("];")).alias("line"))
    edges = g.edge_hop.select(F.lit(2), F.concat(F.lit("  "), dot_quote(F.col("source")), F.lit(" -> "), dot_quote(F.col("target")), F.lit(" [label="), dot_quote(_last(F.col("label"))), F.lit("];")))
    return nodes.union(edges)


def mermaid_lines(g: Graph, most: int = 50) -> DataFrame:
    """(part, line) of a Mermaid flowchart; nodes are numbered n0, n1, ... by id, edge ends not among the nodes left out.

    The numbers come from a range sort: each range's rows are counted, and a row's number is the count before its range plus its place in it.
    The ranges are written, since their bounds are sampled and come out otherwise where a plan runs again.
    """
    ids = g.nodes.select("id", "types")
    ranged = write_table(ids.repartitionByRange("id").withColumn("p", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("p").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "base")
    numbered = ranged.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1).join(before, "p").select("id", "types", F.concat(F.lit("n"), (F.col("base") + F.col("r")).cast("string")).alias("n"))
    nodes = numbered.select(F.lit(1).alias("part"), F.concat(F.lit("  "), "n", F.lit("["), mermaid_quote(clip(F.concat_ws(" ", _last(F.col("id")), F.array_join(F.transform("types", _last), ", ")), most)), F.lit("]")).alias("line"))
    ends = lambda c, n: numbered.select(F.col("id").alias(c), F.col("n").alias(n))
    edges = g.edge_hop.join(ends("source", "a"), "source").join(ends("target", "b"), "target")
    return nodes.union(edges.select(F.lit(2), F.concat(F.lit("  "), "a", F.lit(" -->|"), mermaid_quote(_last(F.col("label"))), F.lit("| "), "b")))
