"""Content-addressed store of token ids: rolling-hash chunks, recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, write_table
from .kernels import U64, buffers, mix, slices
from .tokens import VOCAB, tokenizer

SCHEMA = "kind string, key binary, bucket bigint, doc_id {id}, n_tokens bigint, data binary"
_NAMES = ["part", "kind", "key", "bucket", "doc_id", "n_tokens", "data"]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.int64(), None, pa.int64(), pa.binary()]
#: A leaf of a manifest: 16 bytes for the id, the document's root, and how many recipes have both.
_LEAF, _ENTRY = 48, 56
_SLICE = 1 << 20


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is, no leaves give the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


def rolling_hash(ids: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` ids (a power of two) that end at each place, by doubling; earlier places use what there is."""
    h, step, base = mix(ids.astype(U64) + U64(1)), 1, 0xD6E8FEB86659FD93
    while step < window:
        longer = h.copy()
        longer[step:] += h[:-step] * U64(pow(base, step, 1 << 64))
        h, step = longer, step * 2
    return mix(h)


def chunk_ends(ids: np.ndarray, starts: np.ndarray, window: int, bits: int, least: int, most: int) -> list[list[int]]:
    """Ends of the chunks of each document [starts[i], starts[i+1]): the first place where the rolling hash has ``bits`` zero bits once ``least`` ids are in, or ``most`` ids."""
    found = np.flatnonzero(rolling_hash(ids, window) & U64((1 << bits) - 1) == 0).tolist() if len(ids) else []
    out = []
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        ends = []
        while at < end:
            i = bisect_left(found, at + least - 1)
            cut = found[i] + 1 if i < len(found) else end
            at = min(cut, at + most, end)
            ends.append(at)
        out.append(ends)
    return out


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def leaf_of(doc_id, root: bytes) -> bytes:
    return hashlib.sha256(repr(doc_id).encode()).digest()[:16] + root


def bucket_of(leaf: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.sha256(leaf).digest()[:8], "little") % buckets


def _encode(batches, vocab: str, window: int, bits: int, least: int, most: int, buckets: int):
    tok = tokenizer(vocab)
    width = "<u2" if len(tok.length) < 1 << 16 else "<u4"
    size, seen, leaves, n = int(width[-1]), set(), {}, 0

    def counted():
        if leaves:
            rows = [(bucket_of(x, buckets), "leaf", x, bucket_of(x, buckets), None, c, None) for x, c in leaves.items()]
            leaves.clear()
            yield _batch(rows, pa.int64() if id_type is None else id_type)

    id_type = None
    for batch in batches:
        id_type = batch.column(0).type
        _, offsets = buffers(batch.column(1))
        for i, j in slices(offsets, _SLICE):
            part = batch.slice(i, j - i)
            texts, doc_ids = part.column(1).to_pylist(), part.column(0).to_pylist()
            raw = tok.encode_bytes([t or "" for t in texts])
            starts = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw])))
            ids = np.frombuffer(b"".join(raw), "<u4")
            packed = ids.astype(width).tobytes()
            rows = []
            for k, ends in enumerate(chunk_ends(ids, starts, window, bits, least, most)):
                doc_id, n = doc_ids[k], n + 1
                if texts[k] is None:
                    rows.append((n, "recipe", None, None, doc_id, None, None))
                    continue
                at, digests = int(starts[k]), []
                for end in ends:
                    data = packed[at * size : end * size]
                    d = hashlib.sha256(data).digest()
                    digests.append(d)
                    if d not in seen:
                        seen.add(d)
                        rows.append((_signed(d), "chunk", d, None, None, end - at, data))
                    at = end
                root = merkle_root(digests)
                leaf = leaf_of(doc_id, root)
                leaves[leaf] = leaves.get(leaf, 0) + 1
                rows.append((_signed(leaf) + n & 0xFFFF, "recipe", root, bucket_of(leaf, buckets), doc_id, int(starts[k + 1] - starts[k]), b"".join(digests)))
            yield _batch(rows, id_type)
            if len(leaves) >= _LEAVES:
                yield from counted()
    yield from counted()


#: A task counts so many leaves before it sends them.
_LEAVES = 1 << 17


def _batch(rows: list[tuple], id_type: pa.DataType, names: list[str] = _NAMES) -> pa.RecordBatch:
    types = _TYPES[-len(names) :]
    return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(zip(*rows), types)], names)


def _keep_once(batches):
    seen: set[bytes] = set()
    manifest: dict[int, dict[bytes, int]] = {}
    id_type = pa.int64()
    for b in batches:
        mask, id_type = [], b.column(4).type
        for kind, key, bucket, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 5))):
            if kind == "leaf":
                mine = manifest.setdefault(bucket, {})
                mine[key] = mine.get(key, 0) + n
            mask.append(kind == "recipe" or kind == "chunk" and key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield b.filter(pa.array(mask, pa.bool_())).select(range(1, 7))
    for bucket, leaves in sorted(manifest.items()):
        entries = [leaf + n.to_bytes(8, "little") for leaf, n in sorted(leaves.items())]
        yield _batch([("manifest", merkle_root(entries), bucket, None, sum(leaves.values()), b"".join(entries))], id_type, _NAMES[1:])


def chunk_store(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, window: int = 16, mean_bits: int = 8, least: int = 64, most: int = 1024, bucket_docs: int = 4096
) -> DataFrame:
    """The whole store as rows of three kinds, from one pass and one shuffle.

    ``chunk``: key is the SHA-256 of data, the ids as little-endian integers of 2 bytes (4 where the vocabulary
    needs it); each once. ``recipe``: one per input row; key is the Merkle root of its chunks, data their digests
    in order. ``manifest``: one per bucket of about ``bucket_docs`` documents; key is the Merkle root over its leaves, data
    these in order, each the digest of a document's id, its root, and how many recipes have both; n_tokens counts recipes.

    A null text has a recipe of nulls and no place in a manifest; an empty text has a recipe without chunks. An id may be
    of any type and null, and keeps its recipe. Repeated rows each have a recipe and share chunks and a leaf; very long
    texts are cut whole. Chunks and recipes have no order, so ties don't matter. An empty table gives no rows. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA.format(id=rows.schema["id"].dataType.simpleString())
    buckets = max(1, -(-docs.count() // bucket_docs))
    encode = partial(_encode, vocab=vocab, window=window, bits=mean_bits, least=max(least, window), most=most, buckets=buckets)
    return rows.mapInArrow(encode, f"part bigint, {schema}").repartition("part").mapInArrow(_keep_once, schema)


def _recipe_leaves(batches):
    for b in batches:
        leaves = [leaf_of(i, root) for i, root in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaves, pa.binary())], ["r", "leaf"])


def _manifest_leaves(batches):
    for b in batches:
        rows = []
        for root, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            entries = [data[i : i + _ENTRY] for i in range(0, len(data or b""), _ENTRY)]
            if entries and merkle_root(entries) == root:
                rows += [(e[:_LEAF], int.from_bytes(e[_LEAF:], "little")) for e in entries]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64()))], ["leaf", "listed"])


def audit(store: DataFrame) -> DataFrame:
    """(leaf, listed, present) where the manifests whose roots hold list another number of recipes than there are: lost, added and swapped ones."""
    recipes = store.where("kind = 'recipe' and key is not null").select(F.lit(0).cast("long").alias("r"), "doc_id", "key")
    present = recipes.mapInArrow(_recipe_leaves, "r bigint, leaf binary").groupBy("leaf").agg(F.count("*").alias("present"))
    listed = store.where("kind = 'manifest'").select("key", "data").mapInArrow(_manifest_leaves, "leaf binary, listed bigint").groupBy("leaf").agg(F.sum("listed").alias("listed"))
    both = listed.join(present, "leaf", "full")
    return both.select("leaf", F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("present", F.lit(0)).alias("present")).where("listed <> present")


def reconstruct(store: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """(doc_id, text, verified) of every recipe, put together from the chunks and checked against digests, Merkle root and its bucket's manifest; what fails has no text.

    Recipes that the manifests list and the store lacks are in :func:`audit`.
    """
    recipes = write_table(store.where("kind = 'recipe' and key is not null").select(F.monotonically_increasing_id().alias("r"), "doc_id", "key", "data"), "recipes")
    pieces = recipes.select("r", F.posexplode(F.expr("transform(sequence(0, cast(length(data) / 32 as int)), i -> substring(data, i * 32 + 1, 32))")).alias("n", "digest")).where("length(digest) = 32")
    chunks = store.where("kind = 'chunk'").select(F.col("key").alias("digest"), F.col("data").alias("ids"))
    whole = pieces.join(chunks, "digest", "left").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("n", "digest", "ids"))).alias("parts"))
    leaves = recipes.select("r", "doc_id", "key").mapInArrow(_recipe_leaves, "r bigint, leaf binary")
    bad = leaves.join(audit(store).select("leaf"), "leaf").select("r", F.lit(True).alias("unlisted"))

    def decode(batches):
        tok = tokenizer(vocab)
        width = "<u2" if len(tok.length) < 1 << 16 else "<u4"
        for b in batches:
            texts, verified = [], []
            for root, parts, unlisted in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                parts = parts or []
                good = not unlisted and all(p["ids"] is not None and hashlib.sha256(p["ids"]).digest() == p["digest"] for p in parts) and merkle_root([p["digest"] for p in parts]) == root
                ids = np.frombuffer(b"".join(p["ids"] or b"" for p in parts), width)
                texts.append(tok.encoding.decode(ids.tolist()) if good else None)
                verified.append(good)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(verified, pa.bool_())], ["doc_id", "text", "verified"])

    id_type = recipes.schema["doc_id"].dataType.simpleString()
    return recipes.join(whole, "r", "left").join(bad, "r", "left").select("doc_id", "key", "parts", "unlisted").mapInArrow(decode, f"doc_id {id_type}, text string, verified boolean")
