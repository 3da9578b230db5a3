"""Profiles, signatures and mixing hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import group_rank, salted_join

#: Multiplier of the one-dimensional edge partitioner (a fixed value).
MIXING_PRIME = 1125899906842597


def shingles(text: Column, k: int) -> Column:
    """All k-character substrings of a text, in order; none for a shorter text."""
    n = F.char_length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def shingle_profile(df: DataFrame, id_col: str, text: str, k: int = 3) -> DataFrame:
    """(id, shingle, n): how often each k-shingle occurs in each text."""
    s = df.select(F.col(id_col).alias("id"), F.explode(shingles(F.col(text), k)).alias("shingle"))
    return s.groupBy("id", "shingle").agg(F.count("*").alias("n"))


def shingle_dictionary(profile: DataFrame) -> DataFrame:
    """(shingle, dim): the distinct shingles, numbered 0, 1, ... without bringing them into one task."""
    one = profile.select("shingle", F.lit(0).alias("g")).distinct()
    return group_rank(one, "g", ["shingle"]).select("shingle", (F.col("rank") - 1).cast("int").alias("dim"))


def sparse_vectors(profile: DataFrame, dims: int | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, value): maps from dimension to count. The dimension of a shingle is its number in ``dictionary`` (built if there is none), or with ``dims`` a
    hash modulo ``dims``, which needs no dictionary but lets shingles fall together."""
    if dims is None:
        words = dictionary if dictionary is not None else shingle_dictionary(profile)
        d = salted_join(profile, words, "shingle", spread_by=["id"])
        return d.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.col("n").cast("int")))).alias("value"))
    d = profile.select("id", F.pmod(F.xxhash64("shingle"), F.lit(dims)).cast("int").alias("dim"), "n")
    per = d.groupBy("id", "dim").agg(F.sum("n").cast("int").alias("n"))
    return per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "n"))).alias("value"))


def superbit_planes(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """``bits`` Gaussian directions, made orthonormal in groups of up to ``dim`` (super-bits; Ji et al., 2012)."""
    rng = np.random.default_rng(seed)
    out = []
    while sum(len(o) for o in out) < bits:
        q, _ = np.linalg.qr(rng.standard_normal((dim, min(dim, bits))))
        out.append(q.T)
    return np.round(np.concatenate(out)[:bits], 12)


def superbit_signature(vec: Column, planes: np.ndarray, stages: int, buckets: int) -> Column:
    """array<int> of ``stages`` bucket numbers: per stage the sign bits of its share of the planes, folded to 0..buckets-1."""
    per = len(planes) // stages
    values = []
    for s in range(stages):
        code: Column = F.lit(0)
        for j, w in enumerate(planes[s * per : (s + 1) * per]):
            dot = F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            code = code + F.when(dot >= 0, F.lit(1 << j)).otherwise(F.lit(0))
        values.append(F.pmod(code, F.lit(buckets)).cast("int"))
    return F.array(*values)


def hashed_planes(dims: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Components of ``bits`` Gaussian directions at the dimensions given, each from a hash of its place: for spaces too large to tabulate.

    In such spaces random directions are close to orthogonal by themselves.
    """
    with np.errstate(over="ignore"):
        x = (dims.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) ^ ((np.arange(bits, dtype=np.uint64)[:, None] + np.uint64(seed * 1000003 + 1)) * np.uint64(0xBF58476D1CE4E5B9))
        u = []
        for salt in (1, 2):
            h = x + np.uint64(salt * 0x632BE59B)
            for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(k)
            u.append(((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53)
    return np.sqrt(-2 * np.log1p(-u[0])) * np.cos(2 * np.pi * u[1])


#: Spaces of up to this many dimensions have their directions tabulated.
TABLED_DIMS = 1 << 16


def superbit_signature_sparse(value: Column, planes: np.ndarray, stages: int, buckets: int, hashed: bool = False, seed: int = 11) -> Column:
    """As ``superbit_signature`` for maps from dimension (0..dim-1) to number. With ``hashed`` directions come from ``hashed_planes``, for any dimension;
    of ``planes`` only the number counts then. Negative dimensions, and with tabled planes those beyond the table, are an error of the data and left out."""

    @F.pandas_udf("array<int>")
    def sign(maps: pd.Series) -> pd.Series:
        per, out = len(planes) // stages, []
        for m in maps:
            if m is None:
                out.append(None)
                continue
            m = dict(m)
            dims = np.array([k for k in m if 0 <= k and (hashed or k < planes.shape[1])], dtype=int)
            w = hashed_planes(dims, len(planes), seed) if hashed else planes[:, dims]
            t = w @ np.array([m[k] for k in dims], dtype=float) if len(dims) else np.zeros(len(planes))
            bits = (t >= 0).astype(int)
            out.append([int((bits[s * per : (s + 1) * per] << np.arange(per)).sum() % buckets) for s in range(stages)])
        return pd.Series(out)

    return sign(value)


def ctph_signature(text: Column, stages: int = 3, buckets: int = 10, window: int = 7) -> Column:
    """array<int> of ``stages`` values from context-triggered pieces (Kornblum, 2006).

    A rolling sum over ``window`` bytes ends a piece wherever it meets a trigger; stage s uses a block size of its own, so that edits move
    only the pieces around them. The hash of a stage's longest piece, modulo ``buckets``, is its value. Null stays null; an empty text gives 0s.
    """

    @F.pandas_udf("array<int>")
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _ctph(t.encode("utf-8"), stages, buckets, window) for t in texts])

    return sign(text)


def _ctph(data: bytes, stages: int, buckets: int, window: int) -> list[int]:
    b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    sums = np.convolve(b * 31 + 7, np.ones(window, dtype=np.int64))[: len(b)] if len(b) else b
    out = []
    for s in range(stages):
        size = max(3, len(b) // (3 + 2 * s))
        ends = [0, *(np.nonzero(sums % size == size - 1)[0] + 1).tolist(), len(b)]
        piece = max((data[x:y] for x, y in zip(ends, ends[1:])), key=lambda p: (len(p), p), default=b"")
        h = 0x811C9DC5
        for byte in piece:
            h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
        out.append((h if piece else 0) % buckets)
    return out


def mixing_partition(node_id: Column, partitions: int) -> Column:
    """|id * prime| mod partitions with a 64-bit product that wraps around, in decimals as the product may not overflow."""
    two63, two64 = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    m = F.pmod(node_id.cast("decimal(19,0)") * F.lit(MIXING_PRIME).cast("decimal(18,0)"), two64)
    signed = F.when(m >= two63, m - two64).otherwise(m)
    return F.pmod(F.abs(signed), F.lit(partitions).cast("decimal(10,0)")).cast("int")


def random_partition(node_id: Column, partitions: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(node_id, F.lit(seed)), F.lit(partitions)).cast("int")


def discounted(sim: Column, size: Column, capacity: Column) -> Column:
    """Similarity to a medoid, lowered as its partition fills up."""
    return sim * (1 - size / capacity)


def swap_scores(dpp: Column, dqq: Column, dpq: Column, dqp: Column) -> tuple[Column, Column]:
    """(old, new) scores of a swap: squares of the neighbours that both ends have in their own, and in the other's, partition."""
    return dpp * dpp + dqq * dqq, dpq * dpq + dqp * dqp
