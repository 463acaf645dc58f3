"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_table, ship_package, write_table

#: Bytes of vectors that one search task holds at once; a leaf with more is split.
PART_BYTES = 1 << 25


@dataclass
class Tree:
    branch: int
    dim: int
    levels: list[np.ndarray] = field(default_factory=list)  # level l: branch**l nodes x branch children x dim

    def leaf_of(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The cell of each vector after ``depth`` levels, going to the nearest child each time."""
        cell = np.zeros(len(x), np.int64)
        for level in self.levels[:depth]:
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                cell[at] = c * self.branch + nearest(x[at], level[c])
        return cell

    def leaves_by_distance(self, q: np.ndarray):
        """Leaves best bin first: a priority queue of branches by their centre's distance, the nearest opened next."""
        queue = [(0.0, 0, 0)]
        while queue:
            _, depth, cell = heapq.heappop(queue)
            if depth == len(self.levels):
                yield cell
                continue
            centres = self.levels[depth][cell]
            alive = np.isfinite(centres[:, 0])
            d = ((centres - q) ** 2).sum(axis=1)
            for j in np.flatnonzero(alive).tolist():
                heapq.heappush(queue, (float(d[j]), depth + 1, cell * self.branch + j))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.where(np.isfinite(d), d, np.inf).argmin(axis=1)


def _unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _normal(batches, dim: int):
    for b in batches:
        at, vectors = [], []
        for i, v in enumerate(b.column(2).to_pylist()):
            if v is not None and len(v) == dim and None not in v:
                x = np.array(v, np.float64)
                n = np.sqrt((x * x).sum())
                if np.isfinite(n) and n > 0:
                    at.append(i)
                    vectors.append((x / n).astype(np.float32).tobytes())
        kept = b.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(vectors, pa.binary())], ["id", "asks", "x"])


def _seeds(batches, tree: Tree, depth: int):
    """For each cell the ``branch`` rows with the least hash of their vector."""
    best: dict[int, dict[int, bytes]] = {}
    for b in batches:
        raw = b.column(0).to_pylist()
        cells = tree.leaf_of(_unpack(b.column(0), tree.dim), depth).tolist()
        for c, r in zip(cells, raw):
            h = hash_bytes(r)
            mine = best.setdefault(c, {})
            if len(mine) < tree.branch or h < max(mine):
                mine[h] = r
                if len(mine) > tree.branch:
                    del mine[max(mine)]
    rows = [(c, h, r) for c, m in best.items() for h, r in m.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["cell", "h", "x"])


def hash_bytes(r: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True)


def _sums(batches, tree: Tree, depth: int):
    """Sums and counts of the vectors in each cell of ``depth``."""
    total: dict[int, list] = {}
    for b in batches:
        x = _unpack(b.column(0), tree.dim)
        cells = tree.leaf_of(x, depth)
        for c in np.unique(cells).tolist():
            part = x[cells == c].astype(np.float64)
            t = total.setdefault(c, [np.zeros(tree.dim), 0])
            t[0] += part.sum(axis=0)
            t[1] += len(part)
    yield from _packed_sums(total)


def _packed_sums(total):
    rows = [(c, s.tobytes(), n) for c, (s, n) in total.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64()))], ["cell", "s", "n"])


def _add(batches):
    total: dict[int, list] = {}
    for b in batches:
        for c, s, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            t = total.setdefault(c, [0.0, 0])
            t[0] = t[0] + np.frombuffer(s)
            t[1] += n
    yield from _packed_sums(total)


def depth_for(rows: int, branch: int) -> int:
    """Levels for about sqrt(rows) leaves: the tree, which goes to every task, and a leaf both grow as the root of the table."""
    return round(math.log(max(1, rows), branch) / 2)


def build(vectors: DataFrame, rows: int, dim: int, branch: int, rounds: int) -> Tree:
    """Train level by level on all of ``vectors`` (x): each round of Lloyd's is one pass that brings back a sum and a count a cell."""
    tree = Tree(branch, dim)
    for depth in range(depth_for(rows, branch)):
        seeds = vectors.mapInArrow(partial(_seeds, tree=tree, depth=depth), "cell bigint, h bigint, x binary").dropDuplicates(["cell", "h"])
        first = seeds.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("h"))).where(F.col("r") <= branch)
        level = np.full((branch**depth, branch, dim), np.inf, np.float32)
        for r in first.toLocalIterator():
            level[r.cell, r.r - 1] = np.frombuffer(r.x, np.float32)
        tree.levels.append(level)
        for _ in range(rounds):
            sums = vectors.mapInArrow(partial(_sums, tree=tree, depth=depth + 1), "cell bigint, s binary, n bigint").repartition("cell").mapInArrow(_add, "cell bigint, s binary, n bigint")
            fresh = level.copy()
            for r in sums.toLocalIterator():
                fresh[r.cell // branch, r.cell % branch] = (np.frombuffer(r.s) / r.n).astype(np.float32)
            alive = np.isfinite(level)
            moved = float(np.abs(fresh[alive] - level[alive]).max(initial=0))
            level[:] = fresh
            if moved < 1e-4:
                break
    return tree


def _top(s: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (similarity, code) of each row of ``s``, ties by code; each code once, at its best. ``codes``: one row, rising, or one for each row of ``s``."""
    if codes.ndim == 1:
        new = np.append(True, codes[1:] != codes[:-1])
        if not new.all():
            s, codes = np.maximum.reduceat(s, np.flatnonzero(new), axis=1), codes[new]
        if len(codes) > k:
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            edge = np.take_along_axis(s, top, 1).min(axis=1)
            for r in np.flatnonzero((s >= edge[:, None]).sum(axis=1) > k):
                sure = np.flatnonzero(s[r] > edge[r])
                top[r] = np.concatenate((sure, np.flatnonzero(s[r] == edge[r])[: k - len(sure)]))
            s, codes = np.take_along_axis(s, top, 1), codes[top]
        else:
            codes = np.broadcast_to(codes, s.shape)
    else:
        order = np.lexsort((-s, codes), axis=1)
        s, codes = np.take_along_axis(s, order, 1), np.take_along_axis(codes, order, 1)
        s[:, 1:][codes[:, 1:] == codes[:, :-1]] = -np.inf
    order = np.lexsort((codes, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(codes, order, 1)


def similarities(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.round(q @ x.T, 5)


def _calibrate(index: DataFrame, queries: DataFrame, tree: Tree, sample: int, k: int, target: float) -> int:
    """Leaves a query visits: the least number with which the sample's exact neighbours are found at the target recall.

    The sample is a number of queries, spread by hash; their neighbours come from a pass over all vectors.
    """
    picked = queries.orderBy("x1", "x2").limit(sample).select("id", "x").collect()
    if not picked or not tree.levels:
        return 1
    q = np.frombuffer(b"".join(r.x for r in picked), np.float32).reshape(-1, tree.dim)
    kind = index.schema["id"].dataType

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                code = pc.rank(part.column(0), tiebreaker="dense").to_numpy()
                order = np.argsort(code, kind="stable")
                where = {int(c): int(i) for c, i in zip(code[order][::-1], order[::-1])}
                s, c = _top(similarities(q, _unpack(part.column(2), tree.dim)[order]), code[order], k + 1)
                row, col = np.nonzero(np.isfinite(s))
                rows = part.take(pa.array([where[x] for x in c[row, col].tolist()], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), rows.column(0), rows.column(1), pa.array(s[row, col].astype(np.float64))], ["q", "id", "leaf", "s"])

    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", kind), T.StructField("leaf", T.IntegerType()), T.StructField("s", T.DoubleType())])
    best = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    exact = index.select("id", "leaf", "x").mapInArrow(scan, schema).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    wanted: dict[int, list[int]] = {}
    for r in exact.orderBy("q", "r").collect():
        if r.id != picked[r.q].id and len(wanted.setdefault(r.q, [])) < k:
            wanted[r.q].append(r.leaf)
    needed = []
    for i, want in wanted.items():
        for visits, leaf in enumerate(tree.leaves_by_distance(q[i]), 1):
            needed += [visits] * want.count(leaf)
            want = [x for x in want if x != leaf]
            if not want:
                break
    needed.sort()
    return needed[math.ceil(target * len(needed)) - 1] if needed else 1


def _leaves(batches, tree: Tree):
    for b in batches:
        leaf = pa.array(tree.leaf_of(_unpack(b.column(3), tree.dim)), pa.int32())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], leaf, b.column(3)], ["id", "x1", "x2", "leaf", "x"])


def plan_parts(sizes: dict[int, int], row_bytes: int, part_bytes: int) -> dict[int, tuple[int, int]]:
    """(first part, number of parts) of each leaf: neighbouring leaves share a part up to ``part_bytes``, a larger leaf has several of its own."""
    out, part, room = {}, -1, 0
    most = max(1, part_bytes // row_bytes)
    for leaf, n in sorted(sizes.items()):
        if n > most:
            out[leaf] = (part + 1, -(-n // most))
            part, room = part + out[leaf][1], 0
        else:
            if n > room:
                part, room = part + 1, most
            room -= n
            out[leaf] = (part, 1)
    return out


def _route(batches, tree: Tree, visits: int, parts: dict[int, tuple[int, int]]):
    """One row for each query and part that holds some of the leaves it visits."""
    for b in batches:
        x = _unpack(b.column(2), tree.dim)
        at, part, leaves = [], [], []
        for i in range(len(x)):
            mine: dict[int, list[int]] = {}
            for n, leaf in enumerate(tree.leaves_by_distance(x[i]), 1):
                first, count = parts.get(leaf, (0, 0))
                for p in range(first, first + count):
                    mine.setdefault(p, []).append(leaf)
                if n == visits:
                    break
            for p, found in mine.items():
                at.append(i)
                part.append(p)
                leaves.append(found)
            if len(at) >= 4096 or i + 1 == len(x):
                rows = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), *rows.columns], ["part", "leaves", "x1", "x2", "x"])
                at, part, leaves = [], [], []


def _answer(leaves, q: np.ndarray, members: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each query over its leaves, kept leaf by leaf."""
    best_s, best_c = np.full((len(q), k), -np.inf, np.float32), np.full((len(q), k), -1, np.int64)
    flat = np.array([x for own in leaves for x in own], np.int64)
    row = np.repeat(np.arange(len(q)), [len(own) for own in leaves])
    for leaf in np.unique(flat).tolist():
        if leaf not in members:
            continue
        x, codes = members[leaf]
        asks = row[flat == leaf]
        step = max(1, (1 << 21) // len(x))
        for a in range(0, len(asks), step):
            r = asks[a : a + step]
            s, c = _top(similarities(q[r], x), codes, k)
            s, c = _top(np.concatenate((best_s[r], s), axis=1), np.concatenate((best_c[r], c), axis=1), k)
            best_s[r], best_c[r] = s, c
    return best_s, best_c


def _search(batches, dim: int, k: int):
    """Rows come part by part, members before queries; a query leaves a part with its ``k`` best there."""
    part, ids, leaf, xs, members, known = None, [], [], [], None, None
    for b in batches:
        ps, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        change = [0, *(np.flatnonzero((ps[1:] != ps[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(ps)]
        for a, z in zip(change[:-1], change[1:]):
            if a == z:
                continue
            rows = b.slice(a, z - a)
            if ps[a] != part:
                part, ids, leaf, xs, members = ps[a], [], [], [], None
            if not asks[a]:
                ids.append(rows.column(4))
                leaf.append(rows.column(2).to_numpy())
                xs.append(_unpack(rows.column(7), dim))
                continue
            if not ids:
                continue
            if members is None:
                known = pa.concat_arrays(ids)
                code = pc.rank(known, tiebreaker="dense").to_numpy().astype(np.int64)
                first = np.full(code.max() + 1, -1, np.int64)
                first[code[::-1]] = np.arange(len(code))[::-1]
                at, x = np.concatenate(leaf), np.concatenate(xs)
                order = np.lexsort((code, at))
                cut = [0, *(np.flatnonzero(np.diff(at[order])) + 1).tolist(), len(order)]
                members = {int(at[order[i]]): (x[order[i:j]], code[order[i:j]]) for i, j in zip(cut[:-1], cut[1:])}
                ids, leaf, xs = [known], [], []
            for i in range(0, rows.num_rows, 4096):
                some = rows.slice(i, 4096)
                s, c = _answer(some.column(3).to_pylist(), _unpack(some.column(7), dim), members, k)
                row, col = np.nonzero(np.isfinite(s))
                row_at = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column(5).take(row_at), some.column(6).take(row_at), known.take(pa.array(first[c[row, col]])), pa.array(s[row, col].astype(np.float64))], ["x1", "x2", "neighbour", "similarity"])


def neighbours(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, branch: int = 16, rounds: int = 6, sample: int = 256, recall: float = 0.97, queries: Column | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(id, neighbour, similarity, rank): the ``k`` most cosine-similar other vectors of every row where ``queries`` holds (all rows without it), of which at least about ``recall`` are right.

    A tree of k-means splits of ``branch`` ways with about sqrt(rows) leaves is trained on all vectors, and every vector is
    in a leaf. A query visits leaves best bin first, as many as a calibration against the exact neighbours of ``sample``
    queries needs for ``recall``. Neighbouring leaves share a part of at most ``part_bytes`` and larger ones are split, so
    no task holds more; a query goes once to a part, with the list of its leaves there, and comes back with its best.

    Equal vectors are searched once, and of each vector only the ``k`` + 1 least ids can be anyone's neighbours, so copies
    make no leaf large. Left out, as queries and as neighbours: null ids, null or zero vectors, vectors with a null or not
    finite entry, and those whose length isn't the most common one (the least of equally common ones). Ties in similarity,
    rounded to 5 digits, go to the lesser id. Ids may be of any type with an order. Repeated vectors are neighbours of each
    other; rows that share an id aren't, and a neighbour counts once, at its most similar. A table of one vector, or an
    empty one, gives no rows. Other columns are ignored.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.lit(True) if queries is None else queries, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<float>").alias("v"))
    kind = rows.schema["id"].dataType
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = common[0].n if common else 1
    schema = T.StructType([T.StructField("id", kind), T.StructField("asks", T.BooleanType()), T.StructField("x", T.BinaryType())])
    vectors = rows.where("id is not null").mapInArrow(partial(_normal, dim=dim), schema)
    vectors = write_table(vectors.groupBy("id", "x").agg(F.max("asks").alias("asks")).withColumns({"x1": F.xxhash64("x"), "x2": F.xxhash64(F.lit(1), "x")}), "vectors")
    copies = Window.partitionBy("x1", "x2").orderBy("id")
    distinct = vectors.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    distinct = write_table(distinct.select("id", "x1", "x2", "x"), "vectors-once")
    tree = build(distinct.select("x"), distinct.count(), dim, branch, rounds)
    with_leaf = T.StructType([*(f for f in distinct.schema if f.name != "x"), T.StructField("leaf", T.IntegerType()), T.StructField("x", T.BinaryType())])
    index = write_table(distinct.mapInArrow(partial(_leaves, tree=tree), with_leaf), "vector-index")
    drop_table(distinct)
    asked = vectors.where("asks")
    visits = _calibrate(index, asked, tree, sample, k, recall)
    parts = plan_parts({r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}, 4 * dim + 64, part_bytes)
    first, count = ({leaf: p[i] for leaf, p in parts.items()} for i in (0, 1))

    def place(batches):
        for b in batches:
            leaf, x2 = b.column(3).to_pylist(), b.column(2).to_numpy()
            part = np.array([first[x] for x in leaf], np.int64) + x2 % np.array([count[x] for x in leaf], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(3), *b.columns[:3], b.column(4)], ["part", "leaf", "id", "x1", "x2", "x"])

    placed = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("leaf", T.IntegerType()), *(index.schema[c] for c in ("id", "x1", "x2", "x"))])
    members = index.mapInArrow(place, placed).select("part", F.lit(False).alias("asks"), "leaf", F.lit(None).cast("array<int>").alias("leaves"), "id", "x1", "x2", "x")
    sought = asked.select("x1", "x2", "x").dropDuplicates(["x1", "x2"]).mapInArrow(partial(_route, tree=tree, visits=visits, parts=parts), "part int, leaves array<int>, x1 bigint, x2 bigint, x binary")
    sought = sought.select("part", F.lit(True).alias("asks"), F.lit(None).cast("int").alias("leaf"), "leaves", F.lit(None).cast(kind).alias("id"), "x1", "x2", "x")
    met = members.union(sought).repartition("part").sortWithinPartitions("part", "asks")
    schema = T.StructType([index.schema["x1"], index.schema["x2"], T.StructField("neighbour", kind), T.StructField("similarity", T.DoubleType())])
    found = met.mapInArrow(partial(_search, dim=dim, k=k + 1), schema).repartition("x1", "x2").groupBy("x1", "x2", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("x1", "x2").orderBy(F.desc("similarity"), "neighbour")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    pairs = asked.select("id", "x1", "x2").join(found, ["x1", "x2"]).where("id <> neighbour")
    pairs = pairs.repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
