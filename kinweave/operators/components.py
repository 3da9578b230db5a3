"""Connected components by alternating large-star and small-star rounds on the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import salted_join
from kinweave.session import cut, drop_cut


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One round on edges (u, v). Every node hangs itself or its neighbours on the least node it sees."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = salted_join(both, least, "u", spread_by=["v"])
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): component is the least id reachable over edges in either direction.

    ``nodes(id)`` adds ids without edges, each its own component. Edges with a null end and self-loops are ignored;
    repeated edges count once. Rounds are aggregations and joins on the edge table, so neither a large component nor a hub
    is ever collected, and the rows of a node with very many edges are spread over tasks; each round's table is written, and rounds end when the
    table no longer changes. Should they not end within ``max_rounds``, that is an error.
    """
    e = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        new = cut(_star(_star(e, large=True), large=False))
        drop_cut(e)
        e = new
        # order-free fingerprint of the table, two numbers
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = stars.unionByName(roots)
    if nodes is None:
        return found
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
