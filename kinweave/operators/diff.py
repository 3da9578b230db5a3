"""Differences between two copies of a table: multiset difference both ways, then a full join of the residues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import checked_broadcast, salted_join
from kinweave.session import cut

FLOATS = ("double", "float")


def _norm(c: str, kind: str) -> Column:
    col = F.col(c)
    if kind in FLOATS:  # one form of zero and of NaN
        return F.when(F.isnan(col), F.lit(float("nan"))).otherwise(col + F.lit(0.0)).cast("double")
    return col


def _normal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[_norm(c, kinds[c]).alias(c) for c in columns])


def residues(left: DataFrame, right: DataFrame, columns: Sequence[str], repeats: bool = False) -> DataFrame:
    """EXCEPT ALL in both directions on normalised rows, in one pass: the columns, ``side`` (1 left, -1 right) and ``surplus``.

    ``surplus`` is how many more rows of this kind that side holds; rows held equally often are in neither difference. Both come from
    one pair of counts per distinct row, combined before the shuffle, so that each input is shuffled once (two calls of
    exceptAll would shuffle each twice). Without ``repeats`` repeated rows of a side count once, so surplus is 1. Nulls are equal to
    nulls, NaN to NaN and 0.0 to -0.0. Column order and columns not named do not matter; an empty side leaves all rows of the other.
    """
    both = _normal(left, columns).withColumn("_s", F.lit(1)).unionByName(_normal(right, columns).withColumn("_s", F.lit(-1)))
    g = both.groupBy(*columns).agg(F.sum(F.greatest("_s", F.lit(0))).alias("_l"), F.sum(F.greatest(-F.col("_s"), F.lit(0))).alias("_r"))
    held = lambda c: F.col(c) if repeats else F.least(F.col(c), F.lit(1))
    d = g.withColumn("_d", held("_l") - held("_r")).where("_d <> 0")
    return d.select(*columns, F.signum("_d").cast("int").alias("side"), F.abs("_d").cast("bigint").alias("surplus"))


def _state(rows: DataFrame, keys: Sequence[str], fields: Mapping[str, float | None], tag: str) -> DataFrame:
    """One row per key: least and greatest value of each field, and whether it is null, or NaN, in any row."""
    kinds = dict(rows.dtypes)
    aggs = [F.lit(True).alias(f"_{tag}")]
    for f in fields:
        v = F.col(f)
        real = F.when(~F.isnan(v), v) if kinds[f] in FLOATS else v
        aggs += [F.min(real).alias(f"_{tag}_lo_{f}"), F.max(real).alias(f"_{tag}_hi_{f}"), F.max(v.isNull()).alias(f"_{tag}_null_{f}")]
        aggs.append((F.max(F.coalesce(F.isnan(v), F.lit(False))) if kinds[f] in FLOATS else F.lit(False)).alias(f"_{tag}_nan_{f}"))
    return rows.groupBy(*[F.col(k).alias(f"_{tag}_{k}") for k in keys]).agg(*aggs)


def _differs(f: str, tol: float | None) -> Column:
    """Whether any row of one state differs in ``f`` from any row of the other."""
    a, b = (lambda part, t=t: F.col(f"_{t}_{part}_{f}") for t in "ab")
    some = lambda s: s("lo").isNotNull()
    kinds = [(a("null"), b("null")), (a("nan"), b("nan")), (some(a), some(b))]
    mixed = reduce(lambda x, y: x | y, [p & q for i, (p, _) in enumerate(kinds) for j, (_, q) in enumerate(kinds) if i != j])
    if tol is None:
        apart = (a("lo") != b("hi")) | (a("hi") != b("lo"))
    else:
        apart = (a("hi") - b("lo") > F.lit(tol)) | (b("hi") - a("lo") > F.lit(tol))
    return mixed | F.coalesce(apart, F.lit(False))


def _same_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is among the keys of ``wanted(_k_...)``, without a shuffle of ``df`` where these are few."""
    few = checked_broadcast(wanted, 24 * len(keys))
    if few is None:  # spread by the first key, in case one value of it owns very many rows
        k = keys[0]
        rest = [c for c in keys if c != k]
        both = salted_join(df.where(F.col(k).isNotNull()), wanted.withColumnRenamed(f"_k_{k}", k), k)
        on = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_k_{c}")), rest, F.lit(True))
        null = df.where(F.col(k).isNull()).join(wanted.where(F.col(f"_k_{k}").isNull()), reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_k_{c}")), rest, F.lit(True)), "left_semi")
        return both.where(on).select(*df.columns).unionByName(null)
    return df.join(few, reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True)), "left_semi")


def field_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Mapping[str, float | None], only_left: str = "not_in_copy", only_right: str = "only_in_copy") -> DataFrame:
    """One row per key and difference: keys + ``difference``.

    ``fields`` maps each compared field to an absolute tolerance or None for exact comparison; a null on one side
    differs, nulls on both sides do not, nor do NaN on both. ``difference`` is ``only_left``, ``only_right`` or a field's name.

    Rows equal in all fields cancel out in ``residues``; repeated rows count once. The left and right residues are folded to one state per
    key and full-joined by key, null-safely. A key found in one residue only is looked up in the other table: if it is missing there the
    key is one-sided, else its surplus rows are compared with the rows found. Of a key with several different rows a field is named
    if it differs between any remaining row of one side and any of the other; states keep this linear in the rows of a key.
    """
    cols = [*keys, *fields]
    res = cut(residues(left, right, cols))
    a, b = (_state(res.where(F.col("side") == s), keys, fields, t) for s, t in ((1, "a"), (-1, "b")))
    on = reduce(lambda x, k: x & F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")), keys, F.lit(True))
    j = cut(a.join(b, on, "full"))
    name = lambda t: [F.col(f"_{t}_{k}").alias(f"_k_{k}") for k in keys]
    lone_a, lone_b = j.where("_b IS NULL"), j.where("_a IS NULL")
    in_right = _state(_same_keys(_normal(right, cols), lone_a.select(*name("a")), keys), keys, fields, "b")
    in_left = _state(_same_keys(_normal(left, cols), lone_b.select(*name("b")), keys), keys, fields, "a")
    sa, sb = a.columns, b.columns
    both = j.where("_a AND _b").unionByName(lone_a.select(*sa).join(in_right, on, "left")).unionByName(in_left.join(lone_b.select(*sb), on, "right"))
    parts = [F.when(F.col("_b").isNull(), F.lit(only_left)), F.when(F.col("_a").isNull(), F.lit(only_right))]
    parts += [F.when(F.col("_a") & F.col("_b") & _differs(f, tol), F.lit(f)) for f, tol in fields.items()]
    out = both.select(*[F.coalesce(F.col(f"_a_{k}"), F.col(f"_b_{k}")).alias(k) for k in keys], F.array_compact(F.array(*parts)).alias("_d"))
    return out.select(*keys, F.explode("_d").alias("difference"))
