"""Self-joins inside groups of any size: groups are cut into tiles, and pairs of tiles are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled_self_join(df: DataFrame, key: str, size: str, item: str, carry: list[str], condition, tile: int) -> DataFrame:
    """Unordered pairs of different items under one key that meet ``condition``.

    ``size`` is a column with the number of rows of the row's key. Keys of up to ``tile`` rows are joined at once; a larger one is cut
    into ceil(size / tile) tiles by a hash of ``item`` and joined tile pair by tile pair, so that no task receives a large
    group. ``condition(a, b)`` gets functions from column name to Column and is evaluated inside the join:
    pairs that fail it are never emitted. Returns (a, b) with a < b and possibly repeated where keys overlap.
    """
    t = F.ceil(F.col(size) / F.lit(tile)).cast("int")
    own = F.when(t > 1, F.pmod(F.xxhash64(F.col(item), F.lit(77)), t)).otherwise(F.lit(0)).cast("int")
    base = df.select(F.col(key).alias("k"), F.col(item).alias("i"), *carry, t.alias("_t"), own.alias("_o"))
    later = F.when(F.col("_t") > 1, F.sequence(F.col("_o"), F.col("_t") - 1)).otherwise(F.array(F.lit(0)))
    earlier = F.when(F.col("_t") > 1, F.sequence(F.lit(0), F.col("_o"))).otherwise(F.array(F.lit(0)))
    left = base.select("k", F.col("_o").alias("p"), F.explode(later).alias("q"), *[F.col(c).alias(f"a_{c}") for c in ["i", *carry]])
    right = base.select("k", F.explode(earlier).alias("p"), F.col("_o").alias("q"), *[F.col(c).alias(f"b_{c}") for c in ["i", *carry]])
    ok: Column = F.when(F.col("p") == F.col("q"), F.col("a_i") < F.col("b_i")).otherwise(F.col("a_i") != F.col("b_i"))
    j = left.join(right, ["k", "p", "q"]).where(ok & condition(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    return j.select(F.least("a_i", "b_i").alias("a"), F.greatest("a_i", "b_i").alias("b"))
