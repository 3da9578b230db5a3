"""Algebra and measures of graphs given as nodes(id, value, partition) and edges(src, dst, sim[, rank])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import salted_join
from kinweave.session import cut, drop_cut


def wrap_nodes(values: DataFrame, value: str = "value", id_col: str | None = None) -> DataFrame:
    """nodes(id, value, partition = 0). Without an id column, unique ids are made that depend on the layout."""
    i = F.col(id_col).cast("bigint") if id_col else F.monotonically_increasing_id()
    return values.select(i.alias("id"), F.col(value).alias("value"), F.lit(0).alias("partition"))


def unwrap(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the values of both ends in place of ids."""
    v = nodes.select("id", "value")
    a, b = v.select(F.col("id").alias("src"), F.col("value").alias("src_value")), v.select(F.col("id").alias("dst"), F.col("value").alias("dst_value"))
    return edges.join(a, "src").join(b, "dst").select("src_value", "dst_value", "sim")


def symmetrise(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, distinct (src, dst)."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def in_neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(dst, src): the nodes whose lists contain one of ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("dst", "src").distinct()


def drop_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ``ids(id)``."""
    gone = ids.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def union_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst", "sim").unionByName(b.select("src", "dst", "sim"))


def common_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, n_common): shared neighbours of the nodes that have any."""
    j = a.select("src", "dst").distinct().join(b.select("src", "dst").distinct(), ["src", "dst"])
    return j.groupBy("src").agg(F.count("*").alias("n_common"))


def partition_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("partition").agg(F.count("*").alias("n_nodes"))


def colors(nodes: DataFrame) -> DataFrame:
    """(id, color): the partition of each node, the least one if rows of an id disagree."""
    return nodes.where("id IS NOT NULL").groupBy("id").agg(F.min("partition").alias("color"))


def degrees(edges: DataFrame, color: DataFrame) -> DataFrame:
    """(id, color, degree): neighbours of each node per partition; partitions without any are absent."""
    c = color.select(F.col("id").alias("dst"), "color")
    return salted_join(edges.select("src", "dst").distinct(), c, "dst", spread_by=["src"]).groupBy(F.col("src").alias("id"), "color").agg(F.count("*").alias("degree"))


def cross_edges(edges: DataFrame, color: DataFrame) -> DataFrame:
    """One row (n_cross, n_edges): edges between partitions, of those with both ends known."""
    a, b = color.select(F.col("id").alias("src"), F.col("color").alias("c1")), color.select(F.col("id").alias("dst"), F.col("color").alias("c2"))
    j = salted_join(salted_join(edges.select("src", "dst").distinct(), a, "src", spread_by=["dst"]), b, "dst", spread_by=["src"])
    return j.agg(F.coalesce(F.sum((~F.col("c1").eqNullSafe(F.col("c2"))).cast("bigint")), F.lit(0)).alias("n_cross"), F.count("*").alias("n_edges"))


def balance(nodes: DataFrame, partitions: int) -> Column | DataFrame:
    """One row: largest partition over the mean size, empty partitions counted as size 0."""
    return partition_sizes(nodes).agg((F.max("n_nodes") / F.sum("n_nodes") * F.lit(partitions)).alias("balance"))


def k_hop(edges: DataFrame, starts: DataFrame, depth: int, origin: str | None = None) -> DataFrame:
    """(id, hops) of the nodes reached over out-edges in at most ``depth`` steps, starts included at 0; with ``origin`` per value of that column.

    Each round joins the frontier with the edges and drops what was reached before; rounds are written, so that plans do not grow.
    """
    keys = [origin, "id"] if origin else ["id"]
    seen = cut(starts.select(*keys, F.lit(0).alias("hops")).distinct())
    for d in range(1, depth + 1):
        front = seen.where(F.col("hops") == d - 1).drop("hops").withColumnRenamed("id", "src")
        keep = [origin] if origin else []
        nxt = salted_join(edges.select("src", "dst"), front, "src", spread_by=["dst"]).select(*keep, F.col("dst").alias("id")).distinct()
        fresh = nxt.join(seen.select(*keys), keys, "left_anti").withColumn("hops", F.lit(d))
        both = cut(seen.unionByName(fresh))
        drop_cut(seen)
        seen = both
    return seen
