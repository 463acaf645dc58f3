"""Array kernels on Arrow text buffers, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
_LOWER = np.arange(0x10000, dtype=np.uint32)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000 and len(_l := chr(_c).lower()) == 1 and ord(_l) < 0x10000:
        _LOWER[_c] = ord(_l)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; bijective."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a text column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    _, offsets, data = a.buffers()
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Give freed memory back: a worker lives on between tasks, and its executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row where it is longer; every row is in one."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    trim()


def codepoints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the bytes and the offsets counted in characters."""
    starts = (raw & 0xC0) != 0x80
    if starts.all():
        return _LOWER[raw], offsets
    count = np.concatenate(([0], np.cumsum(starts)))
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    low = _LOWER[np.minimum(cp, 0xFFFF)]
    return np.where(cp > 0xFFFF, cp, low), count[offsets]


def shingle_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` code points from each position on; the last k-1 positions are left out."""
    n = len(cp) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = cp.astype(U64)
    h = c[:n].copy()
    for j in range(1, k):
        h *= U64(0x100000001B3)
        h += c[j : j + n]
    return mix(h)


def line_shingles(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line index) of every k-shingle of each [start, end); a shorter piece that isn't empty is one shingle itself."""
    length = ends - starts
    at_hash = shingle_hashes(cp, k)
    full = length >= k
    n = np.where(full, length - k + 1, 0)
    line = np.repeat(np.arange(len(starts)), n)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    hashes = at_hash[pos]
    short = np.flatnonzero((length > 0) & ~full)
    if len(short):
        h = np.full(len(short), 0x5BD1E995, U64)
        for j in range(k - 1):
            inside = j < length[short]
            c = cp[np.minimum(starts[short] + j, len(cp) - 1)].astype(U64)
            h = np.where(inside, h * U64(0x9E3779B97F4A7C15) + c + U64(1), h)
        hashes, line = np.concatenate((hashes, mix(h))), np.concatenate((line, short))
    return hashes, line


def _probes(bins: int, rounds: int = 512) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, bins, (bins, rounds))


def one_permutation(hashes: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """MinHash by one permutation: ``bins`` minima a row (power of two), empty bins filled by optimal densification.

    A row without shingles keeps the maximum everywhere.
    """
    bits = bins.bit_length() - 1
    top = U64(0xFFFFFFFFFFFFFFFF)
    reg = np.full(rows * bins, top, U64)
    np.minimum.at(reg, row * bins + (hashes >> U64(64 - bits)).astype(np.int64), hashes & U64((1 << (64 - bits)) - 1))
    reg = reg.reshape(rows, bins)
    empty = reg == top
    some = ~empty.all(axis=1)
    r, b = np.nonzero(empty & some[:, None])
    probes, source = _probes(bins), reg.copy()
    for t in range(probes.shape[1]):
        if not len(r):
            break
        got = source[r, probes[b, t]]
        hit = got != top
        reg[r[hit], b[hit]] = got[hit]
        r, b = r[~hit], b[~hit]
    if len(r):
        reg[r, b] = source[r].min(axis=1)
    return reg


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """rows x bands keys, each of the band's number and its registers."""
    n, width = signature.shape
    rows = width // bands
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (n, bands)).copy()
    part = signature.reshape(n, bands, rows)
    for j in range(rows):
        key = mix(key ^ part[:, :, j]) + U64(j + 1)
    return key


def sorted_sets(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (48 bits of them) of each row, in order, and n+1 offsets; at most 65,535 rows."""
    key = np.sort((row.astype(U64) << U64(48)) | (hashes >> U64(16)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return key & U64((1 << 48) - 1), np.searchsorted(key, np.arange(rows + 1, dtype=U64) << U64(48))


_SEEDS = np.random.default_rng(99).integers(1, 1 << 63, 1024, dtype=np.uint64) | U64(1)


def independent_minhash(hashes: np.ndarray, offsets: np.ndarray, functions: int) -> np.ndarray:
    """rows x functions minima of the rows' sets [offsets[i], offsets[i+1]), none of them empty."""
    out = np.empty((len(offsets) - 1, functions), U64)
    for f in range(functions):
        h = hashes * _SEEDS[f]
        h ^= h >> U64(32)
        h *= _SEEDS[-1 - f]
        out[:, f] = np.minimum.reduceat(h, offsets[:-1])
    return out


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges, by hooking and pointer jumping."""
    nodes, inv = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return nodes, nodes[parent]
        a, b = a[apart], b[apart]
        lo, hi = np.minimum(pa_[apart], pb[apart]), np.maximum(pa_[apart], pb[apart])
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


BLOCK = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(7)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x80:] = True
for _c in range(128):
    _IS_WORD[_c] = chr(_c).isalnum()
    if chr(_c).isupper():
        _BYTE_VALUE[_c] = _BYTE_VALUE[ord(chr(_c).lower())]
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each [start, end), ASCII case folded; one prefix sum serves all ranges."""
    forward, back = _power_tables(len(raw) + 1)
    h = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE_VALUE[raw] * forward[: len(raw)], out=h[1:])
    return mix((h[ends] - h[starts]) * back[starts] + (ends - starts).astype(U64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of letters and digits, in order; bytes are taken block by block, so memory doesn't follow a row's length."""
    n = len(raw)
    hashes, rows, at = [], [], 0
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and _IS_WORD[raw[end - 1]] and _IS_WORD[raw[end]] and not offsets[np.searchsorted(offsets, end)] == end:
            back = np.flatnonzero(~_IS_WORD[raw[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                end = min(n, end + BLOCK)
        part = raw[at:end]
        inside = _IS_WORD[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > at) & (offsets < end)] - at
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(range_hashes(part, s, e))
        rows.append(np.searchsorted(offsets, s + at, side="right") - 1)
        at = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


SHINGLE_BITS = 48


def weighted_shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, row, count): the distinct k-word shingles of each row and how often each occurs, by row and element.

    A row of one to k-1 words has a single element made of all of them; a row without words has none. At most 65,535 rows.
    """
    h, row = words(raw, offsets)
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0)
    rows = len(offsets) - 1
    m = len(h) - k + 1
    el, at = np.zeros(0, U64), np.zeros(0, np.int64)
    if m > 0:
        whole = row[:m] == row[k - 1 :]
        e = h[:m].copy()
        for j in range(1, k):
            e = mix(e) + h[j : j + m]
        el, at = mix(e[whole]), row[:m][whole]
    n = np.bincount(row, minlength=rows)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        begin = np.searchsorted(row, short)
        e = h[begin].copy()
        for j in range(1, k - 1):
            more = n[short] > j
            e[more] = mix(e[more]) + h[begin[more] + j]
        el, at = np.concatenate((el, mix(e + U64(3)))), np.concatenate((at, short))
    key = np.sort((at.astype(U64) << U64(SHINGLE_BITS)) | (el >> U64(64 - SHINGLE_BITS)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    where = np.flatnonzero(new)
    count = np.diff(np.append(where, len(key)))
    key = key[where]
    return key & U64((1 << SHINGLE_BITS) - 1), (key >> U64(SHINGLE_BITS)).astype(np.int64), count.astype(np.float64)


_GOLDEN = U64(0x9E3779B97F4A7C15)


def prob_minhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """rows x registers signature: the element whose Poisson process of rate ``weight`` first reaches the register.

    Each element's arrivals come in order of time, each at a random register. An element ends as soon as its
    arrival is later than every register's present time in its row: no later one could win. The share of equal
    registers of two rows estimates their probability Jaccard. A row without elements keeps the maximum.
    """
    top = U64(0xFFFFFFFFFFFFFFFF)
    time, who = np.full(rows * registers, np.inf), np.full(rows * registers, top, U64)
    limit = np.full(rows, np.inf)
    e, r, w, x, t = element, row, weight, np.zeros(len(element)), 0
    shift = U64(64 - (registers.bit_length() - 1))
    while len(e):
        f = int(np.clip((1 << 15) // len(e), 1, 32))
        s = mix(e[:, None] * _GOLDEN + (np.arange(t, t + f, dtype=U64) + U64(1)) * U64(0xD1B54A32D192ED03))
        u = ((s >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        arrive = np.cumsum(-np.log(u), axis=1) / w[:, None] + x[:, None]
        ok = arrive < limit[r][:, None]
        i, j = np.nonzero(ok)
        if len(i):
            a = arrive[i, j]
            slot = r[i] * registers + (mix(s[i, j] ^ _GOLDEN) >> shift).astype(np.int64)
            np.minimum.at(time, slot, a)
            won = time[slot] == a
            who[slot[won]] = e[i[won]]
            touched = np.unique(r[i])
            limit[touched] = time.reshape(rows, registers)[touched].max(axis=1)
        x = arrive[:, -1]
        on = x < limit[r]
        e, r, w, x, t = e[on], r[on], w[on], x[on], t + f
    return who.reshape(rows, registers)


def probability_jaccard(e1: np.ndarray, w1: np.ndarray, e2: np.ndarray, w2: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets given as sorted elements; 0 where either is empty."""
    common, a, b = np.intersect1d(e1, e2, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = w1[a], w2[b]
    only1, only2 = w1.sum() - x.sum(), w2.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate(([0.0], np.cumsum(y)))[np.searchsorted(ratio, ratio, side="left")]
    above = x.sum() - np.concatenate(([0.0], np.cumsum(x)))[np.searchsorted(ratio, ratio, side="left")]
    return float((1.0 / ((above + only1) / x + (below + only2) / y)).sum())
