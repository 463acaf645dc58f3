"""Distributed union-find over edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from .kernels import union_find

#: Below so many forest edges one task ends the search; above, rounds go on. Both give the same components.
ONE_TASK_EDGES = 2_000_000


def _forest(batches):
    """One partition's edges become (node, least node of its local component)."""
    u, v = [], []
    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
    if sum(map(len, u)):
        node, root = union_find(np.concatenate(u), np.concatenate(v))
        keep = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[keep], pa.int64()), pa.array(root[keep], pa.int64())], ["node", "root"])


def _local(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest, "node bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node whose component's least node is another.

    ``edges``: two bigint columns; rows with a null, loops and repeats are ignored. Each round, every
    partition replaces its edges by the stars of a local union-find, then large-star and small-star
    steps link the stars across partitions; each round's table is written in the shared folder.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where("node is not null and root is not null and node <> root")
    now = write_table(_local(e), "forest")
    while True:
        if now.count() <= ONE_TASK_EDGES:
            out = write_table(_local(now.coalesce(1)), "components")
            drop_table(now)
            return out
        both = now.union(now.select(F.col("root"), F.col("node")))
        # large star: larger neighbours link to the least of the neighbourhood
        low = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        large = both.join(low, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        # small star: the node and its smaller neighbours link to the least
        small = large.groupBy("node").agg(F.min("root").alias("m"))
        linked = large.join(small, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        nxt = write_table(_local(linked.union(small.select("node", F.col("m").alias("root"))).distinct().repartition("root")), "forest")
        # a forest of stars whose centres are no one's member has settled
        settled = nxt.join(nxt.select(F.col("node").alias("root")), "root", "left_semi").isEmpty() and nxt.groupBy("node").count().where("count > 1").isEmpty()
        drop_table(now)
        now = nxt
        if settled:
            return now


def with_roots(comps: DataFrame) -> DataFrame:
    """The components with their least nodes as members too."""
    return comps.select("node", "root").union(comps.select("root", F.col("root")).distinct())
