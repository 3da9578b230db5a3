"""Similarities: each as a vectorised function of pairs and of blocks, the numeric ones also as column expressions.

Values that are null, or that a similarity cannot compare (other length, not finite), give NaN, which no ranking admits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarities are rounded to this many decimals before ranking: equal values then tie, whatever the order of summation.
DECIMALS = 9


@dataclass(frozen=True)
class Similarity:
    """``block(a, b)``: matrix of similarities of two lists of values. ``expr``: the same for two columns, where Spark can express it.
    ``scalar``: of two values, from which a block is made if there is none."""

    name: str
    block: Callable[[Sequence, Sequence], np.ndarray]
    expr: Callable[[Column, Column], Column] | None = None
    symmetric: bool = True
    paired: Callable[[Sequence, Sequence], np.ndarray] | None = None

    def pairs(self, a: Sequence, b: Sequence) -> np.ndarray:
        """Similarities of a[i] and b[i]: by ``paired`` if there is one, else on the diagonals of small blocks."""
        if self.paired is not None:
            return self.paired(a, b)
        out = np.full(len(a), np.nan)
        step = 16
        for lo in range(0, len(a), step):
            m = self.block(a[lo : lo + step], b[lo : lo + step])
            out[lo : lo + step] = m[np.arange(len(m)), np.arange(len(m))]
        return out

    def column(self, a: Column, b: Column) -> Column:
        """The rounded similarity of two columns: in Arrow batches by ``paired``, which beats interpreted array functions on long
        vectors; else in the JVM where it can be expressed; else in Arrow batches of blocks."""
        if self.expr is not None and self.paired is None:
            return F.round(self.expr(a, b), DECIMALS)
        block = self

        @F.pandas_udf("double")
        def sim(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(np.round(block.pairs(x.tolist(), y.tolist()), DECIMALS))

        return sim(a, b)


def from_scalar(name: str, f: Callable[[object, object], float], symmetric: bool = True) -> Similarity:
    """A user's similarity of two values of any type."""

    def block(a: Sequence, b: Sequence) -> np.ndarray:
        return np.array([[np.nan if x is None or y is None else f(x, y) for y in b] for x in a], dtype=float).reshape(len(a), len(b))

    return Similarity(name, block, symmetric=symmetric)


def _matrix(v: Sequence) -> np.ndarray:
    if isinstance(v, np.ndarray) and v.ndim == 2:
        fine = np.isfinite(v).all(axis=1)
        return v if v.dtype == np.float64 and fine.all() else np.where(fine[:, None], v, np.nan)
    dim = max((len(x) for x in v if x is not None), default=0)
    if len(v) and all(isinstance(x, np.ndarray) and x.dtype == np.float64 and len(x) == dim for x in v):
        out = np.stack(v)
        out[~np.isfinite(out).all(axis=1)] = np.nan
        return out
    out = np.full((len(v), dim), np.nan)
    for i, x in enumerate(v):
        if x is not None and len(x) == dim:
            out[i] = [np.nan if y is None else y for y in x]
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def _two(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    x, y = _matrix(a), _matrix(b)
    if x.shape[1] != y.shape[1]:
        dim = max(x.shape[1], y.shape[1])
        x, y = (m if m.shape[1] == dim else np.full((len(m), dim), np.nan) for m in (x, y))
    return x, y


def _cosine_block(a: Sequence, b: Sequence) -> np.ndarray:
    x, y = _two(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T


def _l2_block(a: Sequence, b: Sequence) -> np.ndarray:
    x, y = _two(a, b)
    out = np.empty((len(x), len(y)))
    for lo in range(0, len(x), 64):
        d = x[lo : lo + 64, None, :] - y[None]
        out[lo : lo + 64] = 1 / (1 + np.sqrt(np.einsum("ijk,ijk->ij", d, d)))
    return out


def _cosine_paired(a: Sequence, b: Sequence) -> np.ndarray:
    x, y = _two(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.einsum("ij,ij->i", x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True))


def _l2_paired(a: Sequence, b: Sequence) -> np.ndarray:
    x, y = _two(a, b)
    d = x - y
    return 1 / (1 + np.sqrt(np.einsum("ij,ij->i", d, d)))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda v: v * v)))


#: Cosine of dense vectors; NaN for a zero vector.
COSINE = Similarity("cosine", _cosine_block, lambda a, b: F.when((F.size(a) == F.size(b)) & (_norm(a) > 0) & (_norm(b) > 0), _sum(F.zip_with(a, b, lambda x, y: x * y)) / (_norm(a) * _norm(b))).otherwise(F.lit(float("nan"))), paired=_cosine_paired)
#: 1 / (1 + Euclidean distance).
L2 = Similarity("l2", _l2_block, lambda a, b: F.when(F.size(a) == F.size(b), 1 / (1 + F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))).otherwise(F.lit(float("nan"))), paired=_l2_paired)


def _inverse_block(a: Sequence, b: Sequence) -> np.ndarray:
    x, y = (np.array([np.nan if v is None else v for v in s], dtype=float) for s in (a, b))
    return 1 / (1 + np.abs(x[:, None] - y[None]))


#: 1 / (1 + |a - b|) of numbers.
INVERSE_ABS = Similarity("inverse_abs", _inverse_block, lambda a, b: 1 / (1 + F.abs(a - b)))


def _profile_block(a: Sequence[dict], b: Sequence[dict], width: int = 4096) -> np.ndarray:
    """Products are summed over ``width`` dimensions at a time, so that a tile is never laid out over all its dimensions."""
    index: dict = {}

    def triples(v: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, cols, vals, norm = [], [], [], np.full(len(v), np.nan)
        for i, s in enumerate(v):
            if s:
                norm[i] = float(sum(float(n) * float(n) for n in s.values())) ** 0.5
                rows += [i] * len(s)
                cols += [index.setdefault(k, len(index)) for k in s]
                vals += [float(n) for n in s.values()]
        order = np.argsort(np.array(cols, dtype=np.int64), kind="stable")
        return np.array(rows, dtype=np.int64)[order], np.array(cols, dtype=np.int64)[order], np.array(vals, dtype=float)[order], norm

    (ra, ca, va, na), (rb, cb, vb, nb) = triples(a), triples(b)
    out = np.zeros((len(a), len(b)))
    for lo in range(0, len(index), width):
        x, y = np.zeros((len(a), width)), np.zeros((len(b), width))
        for m, r, c, v in ((x, ra, ca, va), (y, rb, cb, vb)):
            i, j = np.searchsorted(c, [lo, lo + width])
            m[r[i:j], c[i:j] - lo] = v[i:j]
        out += x @ y.T
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / (na[:, None] * nb[None])


def _map_dot(a: Column, b: Column) -> Column:
    return _sum(F.transform(F.map_entries(a), lambda e: e["value"].cast("double") * F.coalesce(F.try_element_at(b, e["key"]).cast("double"), F.lit(0.0))))


def _map_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(a), lambda v: v.cast("double") * v.cast("double"))))


#: Cosine of sparse vectors, maps from dimension to value.
SPARSE_COSINE = Similarity("sparse_cosine", _profile_block, lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), _map_dot(a, b) / (_map_norm(a) * _map_norm(b))).otherwise(F.lit(float("nan"))))


def grams(text: str | None, n: int) -> dict[str, int] | None:
    """Counts of the n-grams of characters of a text; none for a text shorter than n."""
    if text is None:
        return None
    out: dict[str, int] = {}
    for i in range(len(text) - n + 1):
        g = text[i : i + n]
        out[g] = out.get(g, 0) + 1
    return out


def cosine_of_grams(n: int = 2) -> Similarity:
    """Cosine of the n-gram profiles of two texts."""
    return Similarity(f"cosine_{n}gram", lambda a, b: _profile_block([grams(t, n) for t in a], [grams(t, n) for t in b]))


def _codes(texts: Sequence, unit: str) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(t.encode("utf-8"), np.uint8).astype(np.int32) if unit == "byte" else np.array([ord(c) for c in t], dtype=np.int32) for t in (x or "" for x in texts)]
    out = np.full((len(raw), max((len(r) for r in raw), default=0) + 1), -1, dtype=np.int32)
    for i, r in enumerate(raw):
        out[i, : len(r)] = r
    return out, np.array([len(r) for r in raw])


def _jaro_winkler(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Of row i of x (lx[i] codes) and row i of y, all rows at once, position by position."""
    rows = len(y)
    reach = np.maximum(np.maximum(lx, ly) // 2 - 1, 0)
    used, hits = np.zeros(y.shape, dtype=bool), np.zeros(x.shape, dtype=bool)
    pos, every = np.arange(y.shape[1]), np.arange(rows)
    widest = int(reach.max()) if rows else 0
    for p in range(int(lx.max()) if rows else 0):
        lo, hi = max(0, p - widest), min(y.shape[1], p + widest + 1)
        if lo >= hi:
            continue
        ok = (y[:, lo:hi] == x[:, p : p + 1]) & ~used[:, lo:hi] & (np.abs(pos[lo:hi] - p)[None] <= reach[:, None]) & (p < lx)[:, None]
        first = ok.argmax(axis=1)
        got = ok[every, first]
        used[got, lo + first[got]] = True
        hits[got, p] = True
    m = hits.sum(axis=1)
    # matched codes of either side, row by row in order, lie at the same places of these flat arrays
    (r, c), (_, e) = np.nonzero(hits), np.nonzero(used)
    t = np.bincount(r, x[r, c] != y[r, e], rows) // 2 if len(r) else np.zeros(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(m > 0, (m / lx + m / ly + (m - t) / m) / 3, 0.0)
    out[(lx == 0) & (ly == 0)] = 1.0
    width = min(4, x.shape[1], y.shape[1])
    same = (y[:, :width] == x[:, :width]) & (x[:, :width] >= 0)
    agree = np.cumprod(same, axis=1).sum(axis=1) if width else np.zeros(rows)
    return np.where(out > 0.7, out + 0.1 * agree * (1 - out), out)


#: Blocks of texts of up to so many codes are compared in 64-bit words, about so many pairs of texts at once, with tables of up to so many bytes.
BIT_CODES, BIT_PAIRS, BIT_BYTES = 512, 8192, 64 << 20


def _lowest(x: np.ndarray, bit: np.ndarray, some: np.ndarray) -> None:
    """bit: the lowest set bit of each text of x[words, ...]; some: per text 1 if there is one, else 0 (in the last word)."""
    np.negative(x, out=bit)
    np.bitwise_or(x, bit, out=some)
    some >>= np.uint64(63)
    for w in range(1, len(x)):  # a word below that is not empty takes one from -x, and x & (-x - 1) is 0
        bit[w] -= some[w - 1]
        some[w] |= some[w - 1]
    bit &= x


def _windows(longest: int, words: int, reach: int) -> np.ndarray:
    """[p, w, r]: the places of word w that are at most r from place p."""
    p, w, r = np.arange(longest)[:, None, None], 64 * np.arange(words)[None, :, None], np.arange(reach + 1)[None, None]
    lo, hi, full = p - r - w, p + r - w, np.uint64(0xFFFFFFFFFFFFFFFF)
    some = (lo < 64) & (hi >= 0)
    return np.where(some, (full << np.clip(lo, 0, 63).astype(np.uint64)) & (full >> (63 - np.clip(hi, 0, 63)).astype(np.uint64)), np.uint64(0))


def _jaro_bits(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matches, transpositions) of every row of x with every row of y: place by place of x, as ``_jaro_winkler`` finds them, with a bit for each place of y."""
    words, longest = max(1, -(-int(ly.max()) // 64)), int(lx.max())
    alphabet = np.unique(y[y >= 0])
    at = np.zeros((words, len(alphabet) + 1, len(y)), dtype=np.uint64)  # the last code is that of all others
    for p in range(int(ly.max())):
        i = np.nonzero(ly > p)[0]
        at[p // 64, np.searchsorted(alphabet, y[i, p]), i] |= np.uint64(1 << p % 64)
    code = np.searchsorted(alphabet, x)
    code = np.where(np.append(alphabet, -2)[code] == x, code, len(alphabet))
    window = _windows(longest, words, max(longest, int(ly.max())) // 2)
    m, t = np.zeros((len(x), len(y)), dtype=np.int64), np.zeros((len(x), len(y)), dtype=np.int64)
    step = max(1, BIT_PAIRS // len(y))
    order = np.argsort(lx, kind="stable")
    for lo in range(0, len(x), step):
        i = order[lo : lo + step]
        n = int(lx[i].max())
        reach = np.maximum(np.maximum(lx[i][:, None], ly[None]) // 2 - 1, 0)
        free = np.full((words, *reach.shape), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        near, own, bit, some = (np.empty_like(free) for _ in range(4))
        hits = np.empty((n, *reach.shape), dtype=np.uint64)
        for p in range(n):
            for w in range(words):
                np.take(window[p, w], reach, out=near[w], mode="clip")
                np.take(at[w], code[i, p], axis=0, out=own[w], mode="clip")
            near &= own
            near &= free
            _lowest(near, bit, some)
            free ^= bit
            hits[p] = some[-1]
        m[i] = hits.sum(axis=0)
        np.negative(hits, out=hits)  # all ones for 1
        rest, equal = ~free, np.zeros(reach.shape, dtype=np.uint16)
        for p in range(n):
            _lowest(rest, bit, some)
            bit &= hits[p]
            rest ^= bit
            for w in range(words):
                np.take(at[w], code[i, p], axis=0, out=own[w], mode="clip")
            own &= bit
            for w in range(1, words):
                own[0] |= own[w]
            equal += own[0] != 0
        t[i] = (m[i] - equal.astype(np.int64)) // 2
    return m, t


def _jaro_winkler_block(a: Sequence, b: Sequence, unit: str) -> np.ndarray:
    y, ly = _codes(b, unit)
    x, lx = _codes(a, unit)
    out = np.zeros((len(a), len(b)))
    size = np.maximum(-(-ly // 64), 1)
    for words in np.unique(size) if len(a) else []:  # texts of as many words at a time
        at = np.nonzero(size == words)[0]
        some = max(1, BIT_BYTES // (8 * int(words) * (1 + len(np.unique(y[at])))))
        for j in (at[lo : lo + some] for lo in range(0, len(at), some)):
            if max(lx.max(), ly[j].max()) > BIT_CODES:
                for i in range(len(a)):
                    n = int(lx[i])
                    out[i, j] = _jaro_winkler(np.broadcast_to(x[i, : n + 1], (len(j), n + 1)), np.full(len(j), n), y[j], ly[j])
                continue
            m, t = _jaro_bits(x, lx, y[j], ly[j])
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(m > 0, (m / lx[:, None] + m / ly[j] + (m - t) / m) / 3, 0.0)
            s[(lx[:, None] == 0) & (ly[j] == 0)] = 1.0
            width = min(4, x.shape[1], y.shape[1])
            agree = np.cumprod((x[:, None, :width] == y[None, j, :width]) & (x[:, None, :width] >= 0), axis=2).sum(axis=2)
            out[:, j] = np.where(s > 0.7, s + 0.1 * agree * (1 - s), s)
    out[np.array([v is None for v in a], dtype=bool)] = np.nan
    out[:, np.array([v is None for v in b], dtype=bool)] = np.nan
    return out


def _jaro_winkler_paired(a: Sequence, b: Sequence, unit: str) -> np.ndarray:
    out = np.full(len(a), np.nan)
    for lo in range(0, len(a), 2048):
        p, q = a[lo : lo + 2048], b[lo : lo + 2048]
        x, lx = _codes(p, unit)
        y, ly = _codes(q, unit)
        null = np.array([u is None or v is None for u, v in zip(p, q)], dtype=bool)
        out[lo : lo + 2048] = np.where(null, np.nan, _jaro_winkler(x, lx, y, ly))
    return out


def jaro_winkler(unit: str = "char") -> Similarity:
    """Jaro-Winkler (prefix of up to 4, weight 0.1, only above 0.7), over characters or over UTF-8 bytes. Two empty texts are alike (1)."""
    return Similarity(f"jaro_winkler_{unit}", lambda a, b: _jaro_winkler_block(a, b, unit), paired=lambda a, b: _jaro_winkler_paired(a, b, unit))


def _dtw_paired(a: Sequence, b: Sequence) -> np.ndarray:
    """All pairs of the same two lengths at once: one array operation per cell of the warping table."""
    out = np.full(len(a), np.nan)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        if x is not None and y is not None and len(x) and len(y):
            shapes.setdefault((len(x), len(y)), []).append(i)
    for (n, m), at in shapes.items():
        x, y = (np.array([[np.nan if v is None else v for v in s[i]] for i in at], dtype=float) for s in (a, b))
        before = np.full((m + 1, len(at)), np.inf)
        before[0] = 0
        for i in range(n):
            row = np.full((m + 1, len(at)), np.inf)
            for j in range(m):
                row[j + 1] = np.abs(x[:, i] - y[:, j]) + np.minimum(np.minimum(before[j + 1], before[j]), row[j])
            before = row
        fine = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
        out[at] = np.where(fine, 1 / (1 + before[-1]), np.nan)
    return out


def _dtw_block(a: Sequence, b: Sequence) -> np.ndarray:
    out = np.full((len(a), len(b)), np.nan)
    step = max(1, 65536 // max(1, len(b)))
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        out[lo : lo + step] = _dtw_paired([x for x in part for _ in b], [y for _ in part for y in b]).reshape(len(part), len(b))
    return out


#: 1 / (1 + dynamic-time-warping distance) of two series.
DTW = Similarity("dtw", _dtw_block, paired=_dtw_paired)


def normalised(v: Column) -> Column:
    """A vector scaled to unit length; null for a zero vector."""
    n = _norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n))


#: L2 of sequences that were ``normalised`` before.
SEQUENCE = Similarity("sequence", _l2_block, L2.expr)
