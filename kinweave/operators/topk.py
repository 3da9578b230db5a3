"""Bounded neighbour lists: one tie rule, similarity descending, then id ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(edges: DataFrame, k: int, src: str = "src", dst: str = "dst", sim: str = "sim", keep_self: bool = False) -> DataFrame:
    """(src, dst, sim, rank): per src the k best distinct dst, each with its highest similarity.

    Null ids, null or NaN similarities and (unless ``keep_self``) src = dst take no part. The rank filter is planned as a limit per group
    before and after the shuffle, so that a src with very many candidates sends k rows per map task.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    ok = F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(sim).isNotNull() & ~F.isnan(F.col(sim).cast("double"))
    if not keep_self:
        ok = ok & (F.col(src) != F.col(dst))
    best = edges.where(ok).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.max(sim).alias("sim"))
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), F.col("dst").asc())
    out = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("src").alias(src), F.col("dst").alias(dst), F.col("sim").alias(sim), "rank")


def merge_lists(lists: list[DataFrame], k: int) -> DataFrame:
    """The k best of the union of several graphs' lists."""
    u = lists[0].select("src", "dst", "sim")
    for x in lists[1:]:
        u = u.unionByName(x.select("src", "dst", "sim"))
    return top_k(u, k)


def best_overall(rows: DataFrame, k: int, dst: str = "dst", sim: str = "sim") -> DataFrame:
    """The k best rows of all, each dst once."""
    one = rows.where(F.col(sim).isNotNull() & ~F.isnan(sim)).groupBy(dst).agg(F.max(sim).alias(sim))
    return one.orderBy(F.col(sim).desc(), F.col(dst)).limit(k)


def arg_max(rows: DataFrame, group: str, item: str, value: str, ties: str = "first", seed: int = 0) -> DataFrame:
    """Per group the item of the highest value; ties by smaller item ('first') or by a seeded hash ('random')."""
    tie = F.col(item) if ties == "first" else F.xxhash64(group, item, F.lit(seed))
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return usable.groupBy(group).agg(F.min_by(F.struct(item, value), F.struct((-F.col(value)).alias("v"), tie.alias("t"))).alias("_b")).select(group, f"_b.{item}", f"_b.{value}")


def sample_ids(nodes: DataFrame, m: int, seed: int, group: str | None = None) -> DataFrame:
    """m distinct ids (per group, if named), or all where there are fewer; drawn by a seeded hash."""
    h = F.xxhash64("id", F.lit(seed))
    ids = nodes.where("id IS NOT NULL")
    if group is None:
        return ids.select("id").distinct().orderBy(h, "id").limit(m)
    d = ids.select(group, "id").distinct()
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(h, "id"))).where(F.col("_r") <= m).drop("_r")
