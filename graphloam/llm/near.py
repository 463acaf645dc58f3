"""Near-duplicate documents by ProbMinHash over weighted word shingles."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, fresh_names, ship_package, write_table
from .banding import BLOBS, BlobWriter, Prefixes, bitmap, blob_parts, candidate_groups, linked, maybe_in
from .components import with_roots
from .kernels import band_keys, buffers, prob_minhash, probability_jaccard, slices, weighted_shingles

_SLICE = 1 << 21
_ROWS = 1 << 15


def _row_slices(offsets: np.ndarray):
    for i, j in slices(offsets, _SLICE):
        for a in range(i, j, _ROWS):
            yield a, min(j, a + _ROWS)


def _keys(batches, k: int, registers: int, bands: int, parts: int):
    seen: set[int] = set()
    out = BlobWriter(parts)
    for b in batches:
        node = b.column(0).to_numpy()
        raw, offsets = buffers(b.column(1))
        for i, j in _row_slices(offsets):
            part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            element, row, weight = weighted_shingles(part, off, k)
            has = np.bincount(row, minlength=j - i) > 0
            signature = prob_minhash(element, row, weight, j - i, registers)
            fresh = np.array([not (x in seen or seen.add(x)) for x in node[i:j].tolist()], bool) & has
            rows = registers // bands
            yield from out.add(band_keys(signature[fresh, : bands * rows], bands), node[i:j][fresh])
    yield from out.flush()


def _candidate_texts(batches, bits: np.ndarray):
    """Texts that may be candidates, each once; the others don't leave their task."""
    seen: set[int] = set()
    for b in batches:
        node = b.column(0).to_numpy()
        may = np.flatnonzero(maybe_in(bits, node))
        may = [i for i, x in zip(may.tolist(), node[may].tolist()) if not (x in seen or seen.add(x))]
        if may:
            yield b.take(pa.array(may))


def weighted_sets(column, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted elements of each text's word shingles with their counts."""
    raw, offsets = buffers(column)
    out = []
    for i, j in _row_slices(offsets):
        element, row, weight = weighted_shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        at = np.searchsorted(row, np.arange(j - i + 1)).tolist()
        out += [(element[a:b], weight[a:b]) for a, b in zip(at[:-1], at[1:])]
    return out


def _similar(items, i: int, js: np.ndarray, threshold: float) -> np.ndarray:
    e, w = items[i]
    return np.array([probability_jaccard(e, w, *items[j]) >= threshold for j in js.tolist()], bool)


def _matcher(items, threshold: float):
    if len(items) <= 16:
        return partial(_similar, items, threshold=threshold)
    prefixes = Prefixes([e for e, _ in items], threshold, [w for _, w in items])

    def similar(i: int, js: np.ndarray) -> np.ndarray:
        may = prefixes.of(i)[js]
        may[may] = _similar(items, i, js[may], threshold)
        return may

    return similar


def near_groups(docs: DataFrame, id_col: str, text_col: str, threshold: float, k: int, registers: int, bands: int, block: int) -> DataFrame:
    """(row_key, id, keep_key, keep_id, n) of every row with text: the first row of its group, and how many rows have its id and text.

    Texts that aren't in a group of similar ones are the same where 128 bits of hashes are.
    """
    ship_package(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.where(F.trim(text) != "").select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("more"), text.alias("text"))
    blobs = rows.select("node", "text").mapInArrow(partial(_keys, k=k, registers=registers, bands=bands, parts=blob_parts(docs)), BLOBS)
    candidates = write_table(candidate_groups(blobs), "near-candidates")
    found = rows.select("node", "text").mapInArrow(partial(_candidate_texts, bits=bitmap(candidates, "node")), "node bigint, text string")
    texts = found.groupBy("node").agg(F.first("text").alias("text"))
    comps = linked(candidates, texts, partial(weighted_sets, k=k), partial(_matcher, threshold=threshold), block)
    drop_table(candidates)
    members = rows.groupBy("id", "row_key", "node", "more").agg(F.count("*").alias("n")).join(with_roots(comps), "node", "left")
    members = members.withColumns({"more": F.when(F.col("root").isNull(), F.col("more")).otherwise(F.lit(0)), "root": F.coalesce("root", "node")})
    keep = members.groupBy("root", "more").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("keep"), F.sum("n").alias("size")).where("size > 1")
    return members.join(keep, ["root", "more"]).select("row_key", "id", F.col("keep.row_key").alias("keep_key"), F.col("keep.id").alias("keep_id"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, k: int = 3, registers: int = 256, bands: int = 64, block: int = 1024) -> DataFrame:
    """(doc_id, duplicate_of): every document that isn't the first of its group, and the first.

    Two texts are near where the probability Jaccard of their ``k``-word shingles, weighted by how often each occurs, is
    at least ``threshold``; groups are the components of verified pairs. ProbMinHash signatures of ``registers`` values
    in ``bands`` find the candidates; groups of more than ``block`` are compared in blocks. The first document is the one with the least doc_id (nulls last).

    Null and blank texts are in no group; texts without letters or digits only match equal texts; a text of fewer than
    ``k`` words is one shingle. Repeated rows (same doc_id and text) are one document here. Documents that share a
    doc_id but not a text are compared like any others, so both columns may then be equal. An empty table gives no rows.
    Other columns are ignored.
    """
    found = near_groups(docs, id_col, text_col, threshold, k, registers, bands, block)
    return found.where("row_key <> keep_key").select(F.col("id").alias("doc_id"), F.col("keep_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, k: int = 3, registers: int = 256, bands: int = 64, block: int = 1024) -> DataFrame:
    """The rows of ``docs`` without those that :func:`near_duplicates` finds; of rows with equal doc_id and text one stays."""
    key, same, gone = fresh_names(docs, "row_key", "row_id", "gone")
    found = near_groups(docs, id_col, text_col, threshold, k, registers, bands, block)
    marks = found.where("row_key <> keep_key or n > 1").select(F.col("row_key").alias(key), F.col("id").alias(same), (F.col("row_key") != F.col("keep_key")).alias(gone))
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    marked = keyed.join(marks, (keyed[key] == marks[key]) & keyed[id_col].eqNullSafe(marks[same]), "left").drop(marks[key])
    single = marked.where(F.col(gone).isNull())
    repeated = marked.where(~F.col(gone)).dropDuplicates([key, id_col])
    return single.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))
