"""Order-preserving packing of documents into windows by dynamic programming."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, local_table, ship_package, write_table
from .kernels import buffers, slices, trim
from .tokens import VOCAB, tokenizer

SCHEMA = "shard bigint, window int, n_tokens int, n_padding int, n_truncated bigint, doc_ids array<{id}>, doc_ends array<int>, tokens binary"
_TYPES = {"shard": pa.int64(), "window": pa.int32(), "n_tokens": pa.int32(), "n_padding": pa.int32(), "n_truncated": pa.int64(), "doc_ids": None, "doc_ends": pa.list_(pa.int32()), "tokens": pa.binary()}
_SLICE = 1 << 20
#: Bytes of ids in a batch of windows: a whole shard at once would be held by the worker and by its JVM.
_OUT = 1 << 20


#: Cost of an id cut off, far above that of any cut: none is while windows have places to end at.
_NEVER = 1 << 40


def best_cuts(ends: Sequence[int], is_doc: Sequence[bool], capacity: int, over: int, split: int, more: Sequence[int] | None = None) -> list[int]:
    """Indexes into ``ends`` (rising token counts at which a window may end) of the cheapest cuts; the last is always one.

    A window of n tokens costs capacity - n if it fits, else over * (n - capacity) for what is cut off; a cut that isn't
    at a document's end costs ``split`` more, and what ``more`` has for its place. The candidates for a window that fits sit in a monotone queue of
    f + position, those too far away in a running minimum of f - over * position: linear in the number of places.
    """
    n = len(ends)
    if not n:
        return []
    pos, f, back = array("q", [0]), [0] * (n + 1), array("q", bytes(8 * (n + 1)))
    pos.extend(ends)
    queue: deque[tuple[int, int]] = deque()  # (f + position, index), both rising
    low, far, far_at = 0, None, -1
    for j in range(1, n + 1):
        p = pos[j]
        v = f[j - 1] + pos[j - 1]
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j - 1))
        while p - pos[low] > capacity:
            g = f[low] - over * pos[low]
            if far is None or g < far:
                far, far_at = g, low
            low += 1
        while queue and queue[0][1] < low:
            queue.popleft()
        best = None
        if queue:
            best, back[j] = queue[0][0] + capacity - p, queue[0][1]
        if far is not None and (best is None or far + over * (p - capacity) < best):
            best, back[j] = far + over * (p - capacity), far_at
        f[j] = best + (0 if is_doc[j - 1] else split) + (more[j - 1] if more else 0)
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


class _Shard:
    """What is known of a shard so far: ids at their final width, and places as packed integers."""

    def __init__(self, number: int):
        self.number, self.ids, self.total = number, bytearray(), 0
        self.ends, self.is_doc, self.inside, self.doc_ids, self.doc_ends = array("q"), bytearray(), bytearray(), [], array("q")

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray, inside: np.ndarray, width: str) -> None:
        self.ends.frombytes((ends + self.total).tobytes())
        self.is_doc += bytes(len(ends) - 1) + b"\1"
        self.inside += inside.tobytes()
        self.ids += ids.astype(width).tobytes()
        self.total += len(ids)
        self.doc_ids.append(doc_id)
        self.doc_ends.append(self.total)

    def windows(self, capacity: int, over: int, split: int, width: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The windows in order, in batches of about ``_OUT`` bytes of ids."""
        more = array("q", ((over - 1) * split * np.frombuffer(self.inside, bool).astype(np.int64)).tobytes()) if any(self.inside) else None
        doc_ends, size, rows, at, held = np.array(self.doc_ends), np.dtype(width).itemsize, [], 0, 0
        types = [t or pa.list_(id_type) for t in _TYPES.values()]
        for w, c in enumerate(best_cuts(self.ends, self.is_doc, capacity, _NEVER, split, more)):
            end = self.ends[c]
            d0, d1 = np.searchsorted(doc_ends, at, side="right"), np.searchsorted(doc_ends, end, side="left")
            inner = np.minimum(doc_ends[d0 : d1 + 1], end) - at
            rows.append((self.number, w, end - at, capacity - (end - at), max(0, end - at - capacity), self.doc_ids[d0 : d1 + 1], inner.tolist(), bytes(self.ids[at * size : end * size])))
            at, held = end, held + len(rows[-1][-1])
            if held >= _OUT or at == self.total:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(_TYPES))
                rows, held = [], 0


def _boundaries(tok, ids: np.ndarray) -> np.ndarray:
    """True after each token that ends a sentence: it ends in . ! or ? and white space follows, or it is a line's end."""
    follow = np.zeros(len(ids), bool)
    follow[:-1] = tok.begins_white[ids[1:]]
    return tok.ends_line[ids] | (tok.ends_mark[ids] & follow)


def _places(tok, body: np.ndarray, mark: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(Ends of a document's sentences and, where one is longer than a window, of its words or of steps in one; whether inside a sentence).

    No two neighbours are further apart than ``capacity``, so that every window fits.
    """
    ends = np.flatnonzero(mark) + 1
    if len(mark) <= capacity or (sizes := np.diff(ends, prepend=0)).max() <= capacity:
        return ends, np.zeros(len(ends), bool)
    extra, words, step = [], np.flatnonzero(tok.begins_white[body[1:]]) + 1, max(1, capacity // 32)
    for e, n in zip(ends[sizes > capacity].tolist(), sizes[sizes > capacity].tolist()):
        at = e - n
        for w in [*words[(words > at) & (words < e)].tolist(), e]:
            if w - at > capacity:
                extra.extend(range(at + step, w, step))
            if w < e:
                extra.append(w)
            at = w
    places = np.union1d(ends, np.array(extra, np.int64))
    return places, ~np.isin(places, ends)


def _pack(batches, vocab: str, capacity: int, over: int, split: int, eot: int | None, firsts: list[int] | None = None, shard_docs: int = 0):
    """Rows come shard by shard; with ``firsts`` they come part by part instead, of which each holds shards of ``shard_docs`` rows from the given number on."""
    tok = tokenizer(vocab)
    width = "<u2" if max(len(tok.length) - 1, eot or 0) < 1 << 16 else "<u4"
    shard = part_at = None
    for batch in batches:
        id_type = batch.column(1).type
        offsets = buffers(batch.column(2))[1]
        for i, j in slices(offsets, _SLICE):
            part = batch.slice(i, j - i)
            raw = tok.encode_bytes([t or "" for t in part.column(2).to_pylist()])
            for number, doc_id, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw):
                if firsts is not None:
                    if number != part_at:
                        part_at, in_part = number, 0
                    number, in_part = firsts[number] + in_part // shard_docs, in_part + 1
                if shard is not None and number != shard.number:
                    yield from shard.windows(capacity, over, split, width, id_type)
                    shard = None
                shard = shard or _Shard(number)
                if not r:
                    continue
                ids = np.frombuffer(r, "<u4")
                body, mark = ids, _boundaries(tok, ids)
                if eot is not None:
                    ids, mark = np.append(ids, np.uint32(eot)), np.append(mark, True)
                    mark[-2] = False
                mark[-1] = True
                ends, inside = _places(tok, body, mark, capacity)
                shard.add(doc_id, ids, ends, inside, width)
        batch = part = offsets = raw = None
    if shard is not None:
        yield from shard.windows(capacity, over, split, width, id_type)
    shard = None
    trim()


def _part_starts(rows: DataFrame, shard_docs: int) -> tuple[list[tuple], list[int]]:
    """(First key of each part, number of the first shard of each part): parts of whole shards in the order of (id, hash).

    Ids and hashes are sorted on their own; only the keys at which parts begin come to the driver, at most one for each
    partition of the shuffle.
    """
    spark = rows.sparkSession
    sorted_ = rows.select("id", "h").repartitionByRange("id", "h").sortWithinPartitions("id", "h").withColumn("pid", F.spark_partition_id())
    sorted_ = write_table(sorted_, "pack-order")
    sizes = {r.pid: r["count"] for r in sorted_.groupBy("pid").count().collect()}
    total = sum(sizes.values())
    step = shard_docs * max(1, -(-total // (shard_docs * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    offset = local_table(spark, [(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes], pid=pa.int32(), base=pa.int64())
    ranked = sorted_.withColumn("r", F.row_number().over(Window.partitionBy("pid").orderBy("id", "h")) - 1).join(F.broadcast(offset), "pid")
    starts = ranked.where((F.col("base") + F.col("r")) % step == 0).select("id", "h").distinct()
    # equal keys stay together, so a part begins where its first key does
    found = ranked.join(F.broadcast(starts.withColumnsRenamed({"id": "i", "h": "g"})), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).groupBy("id", "h").agg(F.min(F.col("base") + F.col("r")).alias("at")).collect()
    drop_table(sorted_)
    found.sort(key=lambda r: r["at"])
    ends = [*(r["at"] for r in found[1:]), total]
    firsts = [0]
    for r, end in zip(found, ends):
        firsts.append(firsts[-1] - (r["at"] - end) // shard_docs)
    return [_key(r.id, r.h) for r in found], firsts


def _key(i, h: int) -> tuple:
    return (False, h) if i is None else (True, i, h)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, capacity: int = 2048, over: int = 4, split: int = 16, shard_docs: int = 1024, eot: int | None = 50256, shard_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """Windows of at most ``capacity`` ids over the documents in the order of their ids, or of ``order_col`` in each shard of ``shard_col``.

    Without ``shard_col`` shards are numbered and hold ``shard_docs`` documents each that follow one another, whatever the
    ids are; some hold fewer, where the part of a task ends. In each shard the cuts minimise padding plus ``split`` a cut
    inside a document, ``over`` times that inside a sentence. Windows end at documents' or sentences' ends; a sentence
    longer than a window may be cut after its words too, and where there are none for a whole window, at steps of a 32nd
    of one. No id is ever dropped: ``n_truncated`` is 0. ``eot`` follows each document (None: nothing does). Row: the shard
    and the window's place in it, the counts, the documents in it with the ends of their parts, and the ids as
    little-endian integers of 2 bytes (4 where the vocabulary needs it), without padding.

    Null and empty texts have no ids and are in no window. Ids may be of any type with an order; rows with a null one come
    first, in the order of their texts' hashes, and repeated ids stay side by side, in that order too. An empty table gives
    no rows. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), *([] if shard_col is None else [F.col(shard_col).cast("long").alias("shard"), F.col(order_col or id_col).alias("place")]))
    work = partial(_pack, vocab=vocab, capacity=capacity, over=over, split=split, eot=eot)
    schema = SCHEMA.format(id=rows.schema["id"].dataType.simpleString())
    if shard_col is not None:
        ordered = rows.repartition("shard").sortWithinPartitions("shard", "place", "id", "h")
        return ordered.select("shard", "id", "text").mapInArrow(work, schema)
    keys, firsts = _part_starts(rows, shard_docs)

    @F.arrow_udf("int")
    def part(i: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([bisect_right(keys, _key(x, y)) - 1 for x, y in zip(i.to_pylist(), h.to_pylist())], pa.int32())

    ordered = rows.withColumn("part", part("id", "h")).repartitionById(max(1, len(keys)), F.col("part")).sortWithinPartitions("part", "id", "h")
    return ordered.select("part", "id", "text").mapInArrow(partial(work, firsts=firsts, shard_docs=shard_docs), schema)
