"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, fresh_names, ship_package, write_table
from .banding import BLOBS, BlobWriter, Prefixes, bitmap, blob_parts, candidate_groups, linked, maybe_in
from .components import with_roots
from .kernels import U64, band_keys, buffers, codepoints, independent_minhash, line_shingles, one_permutation, slices, sorted_sets

_SLICE = 1 << 19
_ROWS = 1 << 15


def _new_lines(raw: np.ndarray, offsets: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) in bytes of the lines that aren't blank and aren't in ``seen``; the hash is Spark's xxhash64."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate((offsets[:-1], cut + 1)))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    ends = ends - (raw[ends - 1] == 10)
    data, digest = raw.tobytes(), xxhash.xxh64_intdigest
    h, s, e = [], [], []
    for a, b in zip(starts.tolist(), ends.tolist()):
        line = data[a:b]
        if line and line.strip(b" "):
            x = digest(line, 42)
            if x not in seen:
                seen.add(x)
                h.append(x)
                s.append(a)
                e.append(b)
    return np.array(h, np.uint64).view(np.int64), np.array(s, np.int64), np.array(e, np.int64)


def _points(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cp, pos = codepoints(raw, np.concatenate((s, e)))
    return cp, pos[: len(s)], pos[len(s) :]


def signature_keys(sets: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, their band keys), of large and of small sets of shingles.

    One permutation serves sets that fill its bins well; smaller ones get independent functions, since filled-up bins
    would make unlike ones collide. Sets near the limit get both, so that sets of a similarity of 0.8 always share a kind.
    """
    n = np.diff(offsets)
    bins = 1 << (bands * rows - 1).bit_length()
    large, small = np.flatnonzero(n >= 1.6 * bins), np.flatnonzero((n > 0) & (n < 2 * bins))
    for which, kind in ((large, 0), (small, 1)):
        if len(which):
            size = n[which]
            to = np.concatenate(([0], np.cumsum(size)))
            h = sets[np.arange(to[-1]) + np.repeat(offsets[which] - to[:-1], size)]
            if kind:
                signature = independent_minhash(h, to, bands * rows)
            else:
                signature = one_permutation(h << U64(16), np.repeat(np.arange(len(which)), size), len(which), bins)[:, : bands * rows]
            yield which, band_keys(signature, bands) ^ U64(kind)


def _keys(batches, k: int, bands: int, rows: int, parts: int):
    seen: set[int] = set()
    out = BlobWriter(parts)
    for b in batches:
        raw, offsets = buffers(b.column(0))
        for i, j in slices(offsets, _SLICE):
            part = raw[offsets[i] : offsets[j]]
            h, s, e = _new_lines(part, offsets[i : j + 1] - offsets[i], seen)
            for a in range(0, len(h), _ROWS):
                z = slice(a, a + _ROWS)
                shingles, line = line_shingles(*_points(part, s[z], e[z]), k)
                for which, keys in signature_keys(*sorted_sets(shingles, line, len(h[z])), bands, rows):
                    yield from out.add(keys, h[z][which])
    yield from out.flush()


def _texts(batches, bits: np.ndarray):
    seen: set[int] = set()
    for b in batches:
        raw, offsets = buffers(b.column(0))
        for i, j in slices(offsets, _SLICE):
            part = raw[offsets[i] : offsets[j]]
            h, s, e = _new_lines(part, offsets[i : j + 1] - offsets[i], seen)
            may = np.flatnonzero(maybe_in(bits, h))
            if len(may):
                data = part.tobytes()
                lines = [data[a:z] for a, z in zip(s[may].tolist(), e[may].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[may]), pa.array(lines, pa.binary()).cast(pa.string())], ["node", "text"])


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's lower-cased character shingles."""
    raw, offsets = buffers(column)
    out = []
    for i, j in slices(offsets, _SLICE):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for a in range(0, j - i, _ROWS):
            z = off[a : min(a + _ROWS, j - i) + 1]
            h, at = sorted_sets(*line_shingles(*_points(part, z[:-1], z[1:]), k), len(z) - 1)
            out += [h[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def jaccard_at_least(items: list[np.ndarray], i: int, js: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``js`` have a Jaccard similarity with ``i`` of at least ``threshold``; exact."""
    a = items[i]
    if len(js) == 1:
        b = items[js[0]]
        if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
            return np.zeros(1, bool)
        common = len(np.intersect1d(a, b, assume_unique=True))
        return np.array([common >= threshold * (len(a) + len(b) - common)])
    n = np.array([len(items[j]) for j in js])
    may = np.minimum(n, len(a)) >= threshold * np.maximum(n, len(a))
    out = np.zeros(len(js), bool)
    some = np.flatnonzero(may & (n > 0))
    if len(some) and len(a):
        every = np.concatenate([items[j] for j in js[some]])
        at = np.searchsorted(a, every)
        inside = a[np.minimum(at, len(a) - 1)] == every
        start = np.concatenate(([0], np.cumsum(n[some])[:-1]))
        common = np.add.reduceat(inside.astype(np.int64), start)
        out[some] = common >= threshold * (len(a) + n[some] - common)
    return out


def _matcher(items: list[np.ndarray], threshold: float):
    if len(items) <= 32:
        return partial(jaccard_at_least, items, threshold=threshold)
    prefixes = Prefixes(items, threshold)

    def similar(i: int, js: np.ndarray) -> np.ndarray:
        may = prefixes.of(i)[js]
        if may.any():
            may[may] = jaccard_at_least(items, i, js[may], threshold)
        return may

    return similar


def similar_lines(texts: DataFrame, threshold: float = 0.8, k: int = 6, bands: int = 10, rows: int = 5, block: int = 4096) -> DataFrame:
    """(node, root): distinct lines, as xxhash64 of the line, and the least line of their component."""
    parts = blob_parts(texts)
    blobs = texts.mapInArrow(partial(_keys, k=k, bands=bands, rows=rows, parts=parts), BLOBS)
    candidates = write_table(candidate_groups(blobs), "line-candidates")
    found = texts.mapInArrow(partial(_texts, bits=bitmap(candidates, "node")), "node bigint, text string")
    out = linked(candidates, found, partial(shingle_sets, k=k), partial(_matcher, threshold=threshold), block)
    drop_table(candidates)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 6, bands: int = 10, rows: int = 5, block: int = 4096) -> DataFrame:
    """The rows of ``docs`` with each text's repeated lines taken out, and the counts ``n_lines`` and ``n_dropped``.

    Lines are joined where the Jaccard similarity of their sets of ``k`` lower-cased characters is at least
    ``threshold``; each component of the whole table keeps its first line by doc_id (nulls last), the text's hash and the line's place, and all
    others go. ``bands`` of ``rows`` MinHash values find the candidates; each is verified exactly, groups of more than
    ``block`` lines in blocks. Lines without a similar one are the same where 128 bits of hashes are.

    Blank lines always stay, and a line shorter than ``k`` is one shingle. A null text stays null with null counts; an
    empty text stays. Repeated rows (same doc_id and text) are one document and come out alike. An empty table gives no
    rows. Other columns pass through whatever their names; the two counts take leading underscores where the name is
    taken.
    """
    spark = docs.sparkSession
    ship_package(spark)
    key, same, dropped, n_lines, n_dropped = fresh_names(docs, "row_key", "row_id", "dropped", "n_lines", "n_dropped")
    text = F.col(text_col)
    row_key = F.xxhash64(F.col(id_col), text)
    comps = similar_lines(docs.select(text.alias("text")), threshold, k, bands, rows, block)
    exploded = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), row_key.alias("k"), F.split(text, "\n").alias("lines")).select("id", "k", F.posexplode("lines").alias("n", "line"))
    hashes = (F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("more"))
    places = write_table(exploded.where("trim(line) <> ''").select("id", "k", "n", *hashes), "line-places")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "k", "n")
    contents = places.groupBy("h", "more").agg(F.count("*").alias("n"), F.min(place).alias("first")).join(with_roots(comps).withColumnRenamed("node", "h"), "h", "left")
    contents = contents.select("h", "more", "n", "first", F.coalesce("root", "h").alias("c"), F.when(F.col("root").isNull(), F.col("more")).otherwise(F.lit(0)).alias("d"))
    first = contents.groupBy("c", "d").agg(F.sum("n").alias("total"), F.min("first").alias("keep")).where("total > 1").select("c", "d", "keep")
    repeated = contents.select("h", "more", "c", "d").join(first, ["c", "d"]).select("h", "more", "keep")
    gone = places.join(repeated, ["h", "more"]).where(~place.eqNullSafe(F.col("keep")))
    gone = gone.groupBy(F.col("k").alias(key), F.col("id").alias(same)).agg(F.array_sort(F.collect_set("n")).alias(dropped))
    keyed = docs.withColumn(key, row_key)
    joined = keyed.join(gone, (keyed[key] == gone[key]) & keyed[id_col].eqNullSafe(gone[same]), "left")

    def rest(of: Column) -> Column:
        """The lines between those that go, in one pass over each."""
        ends = F.concat(F.col(dropped), F.array(F.size(of)))
        return F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), F.col(dropped)), ends, lambda a, b: F.slice(of, a + 2, b - a - 1)))

    kept = F.element_at(F.transform(F.array(F.split(text, "\n")), rest), 1)
    left = F.when(F.col(dropped).isNull(), text).otherwise(F.array_join(kept, "\n"))
    n = F.when(text.isNotNull(), F.size(F.split(text, "\n")))
    counts = {n_lines: n, n_dropped: F.when(text.isNotNull(), F.coalesce(F.size(dropped), F.lit(0)))}
    return joined.select(*(left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *(v.alias(c) for c, v in counts.items()))
