"""Bucket exchange for banded signatures: candidate groups of nodes that share a band key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from .components import components
from .kernels import U64

BLOBS = "pid int, keys binary, nodes binary"
_FLUSH = 1 << 18


class BlobWriter:
    """Gathers (key, node) entries and gives them as one packed row for each range of keys, so that the exchange costs 16 bytes an entry."""

    def __init__(self, parts: int):
        self.parts, self.keys, self.nodes, self.size = parts, [], [], 0

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``keys``: one row of band keys for each of ``nodes``."""
        self.keys.append(keys.ravel())
        self.nodes.append(np.repeat(nodes, keys.shape[1]))
        self.size += keys.size
        if self.size >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, nodes = np.concatenate(self.keys), np.concatenate(self.nodes)
            pid = (keys % U64(self.parts)).astype(np.uint16)
            order = np.argsort(pid, kind="stable")
            pid, keys, nodes = pid[order], keys[order], nodes[order]
            at = np.concatenate(([0], np.flatnonzero(pid[1:] != pid[:-1]) + 1, [len(pid)])).tolist()
            spans = list(zip(at[:-1], at[1:]))
            arrays = [pa.array([int(pid[i]) for i, _ in spans], pa.int32()), *(pa.array([a[i:j].tobytes() for i, j in spans], pa.binary()) for a in (keys, nodes))]
            self.keys, self.nodes, self.size = [], [], 0
            yield pa.RecordBatch.from_arrays(arrays, ["pid", "keys", "nodes"])


def _grouped(batches):
    keys, nodes = [], []
    for b in batches:
        keys += b.column(1).to_pylist()
        nodes += b.column(2).to_pylist()
    if not keys:
        return
    key, node = np.frombuffer(b"".join(keys), U64), np.frombuffer(b"".join(nodes), np.int64)
    del keys, nodes
    order = np.argsort(key)
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    key, node = key[shared], node[shared]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    if not len(key):
        return
    start = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    size = np.diff(np.append(start, len(key)))
    rows = np.repeat(size > 1, size)
    least, node = np.repeat(node[start], size)[rows], node[rows]
    order = np.lexsort((node, least))
    least, node = least[order], node[order]
    new = np.append(True, (least[1:] != least[:-1]) | (node[1:] != node[:-1]))[: len(node)]
    yield pa.RecordBatch.from_arrays([pa.array(least[new]), pa.array(node[new])], ["grp", "node"])


def candidate_groups(blobs: DataFrame) -> DataFrame:
    """(grp, node): every node that shares a band key with others, and the least node with that key, itself included.

    All buckets with the same least node make one group, so that copies that meet in many bands are compared once.
    """
    return blobs.repartition("pid").mapInArrow(_grouped, "grp bigint, node bigint").dropDuplicates(["grp", "node"])


def blob_parts(df: DataFrame) -> int:
    """How many ranges of keys; follows the shuffle's partitions, which follow the data."""
    return min(60_000, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


BITMAP_BITS = 1 << 26


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 8 MB, whatever the size of ``df``, with the bit of each value set: it only ever saves work, since a set bit proves nothing."""
    pos = F.pmod(F.col(column), F.lit(BITMAP_BITS)) + 1
    blocks = df.select(pos.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def maybe_in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    pos = values % BITMAP_BITS
    return (bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


class Prefixes:
    """Which items may be similar to one, through an inverted index of each item's rarest elements.

    Two items whose common elements hold at least ``threshold`` of either's weight share one of those elements that come,
    rarest first, before the rest weighs less than that. Jaccard similarity and probability Jaccard both need as much.
    """

    def __init__(self, elements: list[np.ndarray], threshold: float, weights: list[np.ndarray] | None = None):
        sizes = np.array([len(e) for e in elements])
        self.items = len(elements)
        item = np.repeat(np.arange(self.items), sizes)
        _, token, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
        order = np.lexsort((token, count[token], item))
        weight = np.ones(len(item)) if weights is None else np.concatenate(weights).astype(float)[order]
        total = np.bincount(item, weight, minlength=self.items)
        before = np.cumsum(weight) - weight
        rest = total[item] - (before - (np.cumsum(total) - total)[item])
        kept = rest >= (threshold - 1e-6) * total[item]
        self.token, item = token[order][kept], item[kept]
        self.at = np.searchsorted(item, np.arange(self.items + 1))
        order = np.argsort(self.token, kind="stable")
        self.posting = item[order]
        self.start = np.searchsorted(self.token[order], np.arange(len(count) + 1))

    def of(self, i: int) -> np.ndarray:
        """A mask of the items that may be similar to ``i``."""
        token = self.token[self.at[i] : self.at[i + 1]]
        start = self.start[token]
        n = self.start[token + 1] - start
        out = np.zeros(self.items, bool)
        out[self.posting[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return out


def link(n: int, similar: Callable[[int, np.ndarray], np.ndarray], comp: np.ndarray | None = None, first: int | None = None) -> list[tuple[int, int]]:
    """Edges that join the items just as all similar pairs would; a pair already joined isn't compared.

    With ``comp`` the items are joined so from the start, with ``first`` only pairs with one of the first items are looked at.
    """
    if n == 2 and comp is None:
        return [(0, 1)] if similar(0, np.array([1]))[0] else []
    comp, edges = np.arange(n) if comp is None else comp.copy(), []
    for i in range(n - 1 if first is None else first):
        js = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        if len(js):
            js = js[similar(i, js)]
            if len(js):
                found, at = np.unique(comp[js], return_index=True)
                edges += [(i, j) for j in js[at].tolist()]
                comp[np.isin(comp, found)] = comp[i]
    return edges


def _edges(pairs: list[tuple[int, int]]):
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])


def _check(batches, prepare: Callable, matcher: Callable):
    """Rows of (grp, blk, node, text) come block by block: links inside each."""
    block, nodes, items = None, [], []

    def done():
        return [(nodes[i], nodes[j]) for i, j in link(len(nodes), matcher(items))] if len(nodes) > 1 else []

    for b in batches:
        edges = []
        for key, node, item in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist(), prepare(b.column(3))):
            if key != block:
                edges += done()
                block, nodes, items = key, [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                items.append(item)
        yield from _edges(edges)
    yield from _edges(done())


def _check_across(batches, prepare: Callable, matcher: Callable):
    """Rows of (grp, few, many, role, root, node, text) come by pairs of blocks, the few first: links between items that have different roots."""
    pair, nodes, roots, items, first = None, [], [], [], 0

    def done():
        if not 0 < first < len(nodes):
            return []
        return [(nodes[i], nodes[j]) for i, j in link(len(nodes), matcher(items), np.unique(roots, return_inverse=True)[1], first)]

    for b in batches:
        edges = []
        for key, role, root, node, item in zip(zip(*(b.column(i).to_pylist() for i in range(3))), *(b.column(i).to_pylist() for i in range(3, 6)), prepare(b.column(6))):
            if key != pair:
                edges += done()
                pair, nodes, roots, items, first = key, [], [], [], 0
            nodes.append(node)
            roots.append(root)
            items.append(item)
            first += role == 0
        yield from _edges(edges)
    yield from _edges(done())


def linked(candidates: DataFrame, texts: DataFrame, prepare: Callable, matcher: Callable, block: int) -> DataFrame:
    """(node, root) of the components that the verified pairs within the groups of ``candidates`` make.

    ``texts`` (node, text) may repeat a node. ``prepare(text column)`` gives what is known of each text of a batch as a
    list, ``matcher(items)`` a function of (i, js) that tells which of ``js`` are similar to ``i``.

    A group of more than ``block`` nodes is split, and its first node goes to each block too, so that variants of one
    text are all joined there. Where a group still isn't one component, its nodes outside the largest one are compared
    with all others, block by block: no link between different texts is lost, and no task holds more than two blocks.
    """
    sizes = write_table(candidates.groupBy("grp").count().where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block)), "hot-groups")
    hot = not sizes.isEmpty()
    rows = candidates.select("grp", F.lit(0).cast("long").alias("blk"), "node")
    if hot:
        number = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0).cast("long"))
        rows = candidates.join(sizes, "grp", "left").select("grp", number.alias("blk"), "node")
        rows = rows.union(sizes.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), F.col("grp")))
    ready = rows.join(texts, "node").select("grp", "blk", "node", "text").repartition("grp", "blk").sortWithinPartitions("grp", "blk", "node")
    comps = components(ready.mapInArrow(partial(_check, prepare=prepare, matcher=matcher), "a bigint, b bigint"))
    if not hot:
        drop_table(sizes)
        return comps
    members = candidates.join(sizes.select("grp"), "grp").join(comps, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    members = write_table(members, "hot-members")
    roots = members.groupBy("grp", "root").count().groupBy("grp").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("roots"))
    roots = roots.where("roots > 1")
    apart = members.join(roots.select("grp", "main"), "grp").where("root <> main")
    apart = write_table(apart.groupBy("grp").count().join(roots.select("grp", "main", "n"), "grp").select("grp", "main", F.ceil(F.col("count") / block).alias("fews"), F.ceil(F.col("n") / block).alias("manys")), "hot-apart")
    if apart.isEmpty():
        return comps
    split = members.join(apart, "grp")
    few = split.where("root <> main").select("grp", F.pmod(F.xxhash64("node"), F.col("fews")).alias("few"), F.explode(F.expr("sequence(0L, manys - 1)")).alias("many"), F.lit(0).alias("role"), "root", "node")
    many = split.select("grp", F.explode(F.expr("sequence(0L, fews - 1)")).alias("few"), F.pmod(F.xxhash64("node"), F.col("manys")).alias("many"), F.lit(1).alias("role"), "root", "node")
    pairs = few.union(many).join(texts, "node").select("grp", "few", "many", "role", "root", "node", "text")
    pairs = pairs.repartition("grp", "few", "many").sortWithinPartitions("grp", "few", "many", "role", "node")
    across = pairs.mapInArrow(partial(_check_across, prepare=prepare, matcher=matcher), "a bigint, b bigint")
    out = components(comps.select("node", "root").union(across))
    for table in (sizes, members, apart, comps):
        drop_table(table)
    return out
