"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_table, fresh_names, local_table, ship_package, write_table

#: A process remembers so many nodes of the tree at once; others are drawn again when they are wanted.
_REMEMBERED = 4096
#: numpy draws from populations below this.
_NUMPY_MOST = 1_000_000_000
#: Equal rows are taken apart again in steps of so many.
_STEP = 10_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn from ``good + bad`` are good, for populations of any size, to the precision of float logarithms.

    Few draws are made one by one, many by the ratio of uniforms (Stadlober 1990).
    """
    total = good + bad
    if n > total - n:
        return good - hypergeometric(rng, good, bad, total - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    if n <= 10:
        got = 0
        for i in range(n):
            got += int(rng.integers(0, total - i) < good - got)
        return got
    mean = n * good / total
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = math.sqrt((total - n) * n * (good / total) * (bad / total) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)

    def height(k: int) -> float:
        return math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1)

    most, least_height = min(n, good, math.floor(mean + 16 * spread)), height(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = mean + 0.5 + width * (v - 0.5) / u
        if 0 <= k < most + 1 and 2 * math.log(u) <= least_height - height(int(k)):
            return int(k)


class SplittingTree:
    """Shares exact block quotas out among shards: each node draws what its left half gets, from a seed of its own.

    Only the nodes on the way to a wanted shard are drawn, so every process finds the same shares by itself.
    """

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self.total = int(self.quotas.sum())
        self._left: dict[tuple[int, int], np.ndarray] = {}

    def start(self, shard: int) -> int:
        """Blocks in all shards before ``shard``; sizes differ by one at most."""
        return self.total * shard // self.shards

    def _draw(self, lo: int, hi: int, counts: np.ndarray) -> np.ndarray:
        if (lo, hi) not in self._left:
            if len(self._left) >= _REMEMBERED:
                self._left.clear()
            rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, lo, hi])))
            n = self.start((lo + hi) // 2) - self.start(lo)
            if int(counts.sum()) < _NUMPY_MOST:
                self._left[lo, hi] = rng.multivariate_hypergeometric(counts, n, method="marginals")
            else:
                left, rest = [], int(counts.sum())
                for c in counts.tolist():
                    rest -= c
                    left.append(hypergeometric(rng, c, rest, n))
                    n -= left[-1]
                self._left[lo, hi] = np.array(left, np.int64)
        return self._left[lo, hi]

    def shares(self) -> np.ndarray:
        """shards x sources: the blocks of each."""
        out = np.zeros((self.shards, len(self.quotas)), np.int64)

        def walk(lo, hi, counts):
            if hi - lo == 1:
                out[lo] = counts
            else:
                left = self._draw(lo, hi, counts)
                walk(lo, (lo + hi) // 2, left)
                walk((lo + hi) // 2, hi, counts - left)

        walk(0, self.shards, self.quotas)
        return out

    def shard_of(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The shard of each block, numbered within its source; -1 beyond the source's quota."""
        out = np.full(len(source), -1, np.int64)
        inside = np.flatnonzero(block < self.quotas[source])
        todo = [(0, self.shards, self.quotas, inside, block[inside])]
        while todo:
            lo, hi, counts, at, rank = todo.pop()
            if not len(at):
                continue
            if hi - lo == 1:
                out[at] = lo
                continue
            left, mid = self._draw(lo, hi, counts), (lo + hi) // 2
            mine = left[source[at]]
            goes = rank < mine
            todo.append((lo, mid, left, at[goes], rank[goes]))
            todo.append((mid, hi, counts - left, at[~goes], (rank - mine)[~goes]))
        return out


def weighted_rows(counts: list[int], weights: list[float]) -> list[int]:
    """Rows of each source: as many as keep the target weights with no source used beyond what it has; one at least of each with a weight."""
    total = sum(w for w in weights if w > 0)
    room = min((n / (w / total) for n, w in zip(counts, weights) if w > 0), default=0)
    return [min(n, max(1, math.floor(room * w / total + 1e-9))) if w > 0 else 0 for n, w in zip(counts, weights)]


def default_targets(counts: list[int], temperature: float) -> list[float]:
    """Rows wanted of each source: n ** temperature * size ** (1 - temperature), with a size typical of a row's source.

    The size is the geometric mean of the sources' rows, each source weighing as its rows: a nearly empty one barely
    moves it. Sources above it are thinned out; those below want more than they have.
    """
    total = sum(counts)
    if not total:
        return [0.0] * len(counts)
    size = math.exp(sum(n * math.log(n) for n in counts) / total)
    return [n**temperature * size ** (1 - temperature) for n in counts]


def default_rows(counts: list[int], temperature: float) -> list[int]:
    """Rows of each source for its default target, at most all."""
    return [min(n, math.ceil(t - 1e-6)) for n, t in zip(counts, default_targets(counts, temperature))]


def default_quotas(counts: list[int], temperature: float, block: int) -> list[int]:
    """Blocks of each source for its default target, at most all; the last block of a source may be short."""
    return [-(-n // block) for n in default_rows(counts, temperature)]


def _range(key: Column, n: Column) -> Column:
    """The range of a signed 64-bit hash among ``n`` equal ones: by ranges the order of all keys doesn't depend on how many there are."""
    return F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * n / F.lit(1 << 32)).cast("long")


def mix_sources(
    docs: DataFrame,
    source_col: str = "source",
    weights: dict | None = None,
    temperature: float = 0.5,
    block_docs: int = 4,
    shard_docs: int = 4096,
    bucket_docs: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """A sample of ``docs`` without replacement whose sources have the target weights, dealt to shards, with ``shard`` and ``position``.

    ``weights`` maps each source to its target (absent: 0; the null source has the key None), and each source gives the
    largest number of rows that keeps the weights, one at least; a source's last block of ``block_docs`` rows may be short.
    Without it the targets are those of :func:`default_targets`, and a source that has fewer rows gives them all: no
    source limits another. :func:`quota_report` tells shares and targets. The tree splits the blocks exactly among
    shards of about ``shard_docs`` rows; a shard takes its blocks from the source's rows in permuted order, disjoint
    from all other shards', and its rows are shuffled among each other. Rows are decided upon by hashes of all their
    columns; only those that are taken move, once.

    Null texts are rows like others; a null source is a source; null and repeated doc_ids are rows of their own, and so is
    each of several equal rows. An empty table gives no rows. The sources' names and counts are known to the driver, so
    their number is bounded by its memory. Other columns pass through whatever their names; the two new ones take
    leading underscores where the name is taken.
    """
    names, counts = _sources(docs, source_col)
    rows = default_rows(counts, temperature) if weights is None else weighted_rows(counts, [float(weights.get(n, 0)) for n in names])
    return _deal(docs, names, counts, rows, block_docs, source_col, shard_docs, bucket_docs, seed)


def mixed_order(docs: DataFrame, source_col: str = "source", block_docs: int = 4, shard_docs: int = 4096, bucket_docs: int = 20_000, seed: int = 17) -> DataFrame:
    """All of ``docs``, with ``shard`` and ``position``: for what :func:`mix_sources` gave, those that it gave with the same arguments.

    A source's sample is the beginning of its permuted order, so the order of the sample alone is enough to find them again.
    """
    names, counts = _sources(docs, source_col)
    return _deal(docs, names, counts, counts, block_docs, source_col, shard_docs, bucket_docs, seed)


def quota_report(docs: DataFrame, source_col: str = "source", weights: dict | None = None, temperature: float = 0.5) -> list[tuple[str | None, int, float, float]]:
    """(source, rows, target share, share of the sample) for :func:`mix_sources` with the same arguments."""
    names, counts = _sources(docs, source_col)
    target = default_targets(counts, temperature) if weights is None else [float(weights.get(n, 0)) for n in names]
    rows = default_rows(counts, temperature) if weights is None else weighted_rows(counts, target)
    wanted, taken = sum(t for t in target if t > 0) or 1, sum(rows) or 1
    return [(s, n, max(t, 0) / wanted, r / taken) for s, n, t, r in zip(names, counts, target, rows)]


def _sources(docs: DataFrame, source_col: str) -> tuple[list[str | None], list[int]]:
    found = sorted(docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("s")).count().collect(), key=lambda r: (r.s is None, r.s or ""))
    return [r.s for r in found], [r["count"] for r in found]


def _row_hash(schema: T.StructType, seed: int) -> Column:
    """Hash of all columns, and of which of them are null."""

    def has_map(t):
        return isinstance(t, T.MapType) or any(has_map(x) for x in ([f.dataType for f in t] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else []))

    values = [F.to_json(F.struct(F.col(f.name))) if has_map(f.dataType) else F.col(f.name) for f in schema]
    return F.xxhash64(F.lit(seed), *values, F.concat(*(F.when(F.col(f.name).isNull(), "0").otherwise("1") for f in schema)))


def _deal(docs: DataFrame, names: list, counts: list[int], rows: list[int], block: int, source_col: str, shard_docs: int, bucket_docs: int, seed: int) -> DataFrame:
    """The first ``rows`` of each source's permuted order, dealt to shards.

    Hashes of the rows are ranked, dealt and shuffled on their own; then the rows come, each kind once, to what was
    decided for its hash. Equal rows are counted before they move, so that no task holds all of them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shard, position = fresh_names(docs, "shard", "position")
    tree = SplittingTree([-(-n // block) for n in rows] or [0], max(1, round(sum(rows) / shard_docs)), seed)
    wanted = [(i, n, max(1, -(-c // bucket_docs)), r) for i, (n, c, r) in enumerate(zip(names, counts, rows)) if r]
    known = F.broadcast(local_table(spark, wanted, ix=pa.int32(), s=pa.string(), nb=pa.int64(), want=pa.int64()))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    hashed = docs.toDF(*plain)
    hashed = hashed.select("*", _row_hash(hashed.schema, seed).alias("k1"), _row_hash(hashed.schema, seed + 1).alias("k2"))
    source = hashed[plain[docs.columns.index(source_col)]].cast("string")
    keys = hashed.join(known, source.eqNullSafe(F.col("s"))).select("ix", _range(F.col("k1"), F.col("nb")).alias("bucket"), "k1", "k2")
    keys = write_table(keys.groupBy("ix", "bucket", "k1", "k2").agg(F.count("*").alias("n")), "mix-keys")
    before = Window.partitionBy("ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = keys.groupBy("ix", "bucket").agg(F.sum("n").alias("m")).select("ix", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    bases = bases.join(known.select("ix", "want"), "ix").where("base < want").repartition("ix", "bucket")
    within = Window.partitionBy("ix", "bucket").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keys.withColumn("upto", F.sum("n").over(within)).join(bases, ["ix", "bucket"])
    ranked = ranked.select("ix", "k1", "k2", (F.col("base") + F.col("upto") - F.col("n")).alias("first"), F.least(F.col("base") + F.col("upto"), "want").alias("stop")).where("first < stop")
    each = ranked.select("ix", "k1", "k2", "stop", F.explode(F.expr(f"sequence(first, stop - 1, {_STEP}L)")).alias("first"))
    each = each.select("ix", "k1", "k2", F.explode(F.expr(f"sequence(first, least(first + {_STEP}, stop) - 1)")).alias("rank"))

    @F.pandas_udf("int")
    def place(source: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(tree.shard_of(source.to_numpy(np.int64), number.to_numpy(np.int64) // block), dtype="int32")

    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("k1"), F.col("rank")), "ix", "rank")
    dealt = each.withColumn("shard", place("ix", "rank")).withColumn("position", F.row_number().over(local))
    dealt = write_table(dealt.select("ix", "k1", "k2", "shard", "position"), "mix-dealt")
    drop_table(keys)
    last = {r.ix: r.k for r in dealt.groupBy("ix").agg(F.max("k1").alias("k")).collect()}
    ends = F.broadcast(local_table(spark, [(n, last[i]) for i, n, _, _ in wanted], s=pa.string(), last=pa.int64()))
    taken = hashed.join(ends, source.eqNullSafe(F.col("s"))).where("k1 <= last").select(*plain, "k1", "k2").dropDuplicates(["k1", "k2"])
    out = taken.join(dealt.select("k1", "k2", "shard", "position"), ["k1", "k2"])
    return out.select(*(F.col(a).alias(b) for a, b in zip(plain, docs.columns)), F.col("shard").alias(shard), F.col("position").alias(position))
