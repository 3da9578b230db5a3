"""Similarity clusters by bisecting k-means across the cluster, with an exact check of leaves that touch (problem 6)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.vectors import dot, radius_of, stack, usable_vectors, vector_classes
from kinweave.operators.skew import HEAVY_ROWS, salted_join, sized_join
from kinweave.session import cores, cut


@dataclass(frozen=True)
class Bisecting:
    """``min_sim``: similarity that holds between any two members; ``local_rows``: vectors up to which a node is split further inside one task;
    ``min_size``: ids of a cluster; ``lloyd``: k-means rounds per split; ``tile``: leaves compared with as many others in one step."""

    dim: int = 24
    min_sim: float = 0.25
    min_size: int = 3
    local_rows: int = 16384
    lloyd: int = 2
    tile: int = 4096

    @property
    def reach(self) -> float:
        return radius_of(self.min_sim)


def _by_node(rows: DataFrame, table: DataFrame, dim: int, how: str = "inner") -> DataFrame:
    """Rows with what ``table`` holds for their node."""
    return sized_join(rows, table, "node", 16 + 8 * dim * max(1, len(table.columns) - 2), how)


def _mean(dim: int) -> Column:
    return F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(dim)])


def _d2(a: str, b: str, dim: int) -> Column:
    return reduce(lambda x, y: x + y, [(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(dim)])


def split_nodes(classes: DataFrame, p: Bisecting) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, levels): rows (node, rep, vec, compact) of a tree whose nodes are compact or have at most ``local_rows`` vectors, and
    the planes (node, w, b) between the children of the nodes split at each level.

    All nodes above both limits are split at once, level by level, in order of dispersion or not: each of them must be split in the end. Centres are means
    over all vectors of a node, from aggregations that are combined before the shuffle. Finished nodes leave the loop; only rows of nodes
    still open are written again. A node is compact if all its vectors lie within half the reach of its centre.
    """
    d = p.dim
    rows = classes.select(F.lit(1).cast("bigint").alias("node"), "rep", "vec")
    done: list[DataFrame] = []
    levels: list[DataFrame] = []
    while True:
        spread = F.array(*[F.var_pop(F.get("vec", F.lit(i))) for i in range(d)])
        stats = cut(rows.groupBy("node").agg(F.count("*").alias("n"), _mean(d).alias("c"), spread.alias("s")))
        large = stats.where(F.col("n") > p.local_rows)
        if not large.limit(1).count():
            done.append(rows.withColumn("compact", F.lit(False)))
            break
        far = _by_node(rows, large.select("node", "c"), d).groupBy("node").agg(F.max(_d2("vec", "c", d)).alias("far2"))
        axis = F.array_position("s", F.array_max("s")).cast("int") - 1
        wide = cut(large.join(far, "node").select("node", axis.alias("axis"), F.get("c", axis).alias("at"), (F.col("far2") <= (p.reach / 2) ** 2).alias("compact")))
        side, planes = F.get("vec", F.col("axis")) > F.col("at"), wide.where("NOT compact").select("node", "axis", "at")
        for _ in range(p.lloyd):
            parts = _by_node(rows, planes, d).groupBy("node", side.alias("side")).agg(_mean(d).alias("c"))
            two = parts.groupBy("node").agg(F.max(F.when(F.col("side"), F.col("c"))).alias("c1"), F.max(F.when(~F.col("side"), F.col("c"))).alias("c0"))
            length = F.sqrt(F.aggregate(F.zip_with("c1", "c0", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
            middle = F.aggregate(F.zip_with("c1", "c0", lambda a, b: (a - b) * (a + b) / 2), F.lit(0.0), lambda a, v: a + v)
            planes = cut(two.withColumn("l", length).where("l > 0").select("node", F.transform(F.zip_with("c1", "c0", lambda a, b: a - b), lambda v: v / F.col("l")).alias("w"), (middle / F.col("l")).alias("b")))
            side = dot("vec", F.col("w"), d) > F.col("b")
        levels.append(planes)
        state = stats.select("node", (F.col("n") <= p.local_rows).alias("fits")).join(wide.select("node", "compact"), "node", "left").select("node", F.coalesce("compact", F.lit(False)).alias("compact"), "fits")
        finished = state.where("fits OR compact").select("node", "compact")
        done.append(_by_node(rows, finished, 1))
        rows = cut(_by_node(rows, planes, d).select(F.xxhash64("node", side).alias("node"), "rep", "vec"))
    return reduce(DataFrame.unionByName, [x.select("node", "rep", "vec", "compact") for x in done]), levels


def _leaves(x: np.ndarray, reps: np.ndarray, p: Bisecting) -> Iterator[np.ndarray]:
    """Places of the vectors of each leaf: the part of the largest dispersion is split by 2-means until all pairs of every part are within reach."""
    parts = [(-_dispersion(x), 0, np.arange(len(x)))]
    number = count(1)
    while parts:
        _, _, i = heapq.heappop(parts)
        v = x[i]
        if len(i) == 1 or _compact(v, p.reach):
            yield i
            continue
        s = v.var(axis=0)
        a = int(s.argmax())
        side = v[:, a] > v[:, a].mean()
        for _ in range(p.lloyd + 1):
            if side.all() or not side.any():
                break
            c1, c0 = v[side].mean(axis=0), v[~side].mean(axis=0)
            side = v @ (c1 - c0) > (c1 @ c1 - c0 @ c0) / 2
        if side.all() or not side.any():
            side = np.arange(len(i)) >= len(i) // 2
        for half in (i[side], i[~side]):
            heapq.heappush(parts, (-_dispersion(x[half]), next(number), half))


def _dispersion(v: np.ndarray) -> float:
    return float(((v - v.mean(axis=0)) ** 2).sum())


def _compact(v: np.ndarray, reach: float) -> bool:
    d = v - v.mean(axis=0)
    far = np.einsum("nd,nd->n", d, d).max()
    if far <= (reach / 2) ** 2 * (1 - 1e-9):
        return True
    if far > reach**2:
        return False
    sq = (v * v).sum(1)
    return all((sq[k : k + 512, None] + sq[None] - 2 * v[k : k + 512] @ v.T).max() <= reach**2 - 1e-6 for k in range(0, len(v), 512))


def leaf_rows(rows: DataFrame, p: Bisecting) -> tuple[DataFrame, DataFrame]:
    """(placed, leaves): placed (rep, leaf, vec); leaves (leaf, n, c, radius): the leaf's distinct vectors, their centre and the distance of the farthest.

    A leaf is named by its least rep; any two of its vectors are within reach. Small nodes are split on by one task each; a large
    node that is compact is one leaf, described by aggregations.
    """

    def split(b: pd.DataFrame) -> pd.DataFrame:
        x, reps = stack(b["vec"]), b["rep"].to_numpy()
        leaf, n, radius = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64), np.zeros(len(b))
        centre: list = [None] * len(b)
        for i in _leaves(x, reps, p):
            c = x[i].mean(axis=0)
            first = i[reps[i].argmin()]
            leaf[i], n[first], centre[first] = reps[first], len(i), c
            radius[first] = np.sqrt(((x[i] - c) ** 2).sum(1).max())
        return pd.DataFrame({"rep": reps, "leaf": leaf, "vec": b["vec"], "n": n, "c": centre, "radius": radius})

    kind = "rep bigint, leaf bigint, vec array<double>, n bigint, c array<double>, radius double"
    small = cut(rows.where("NOT compact").groupBy("node").applyInPandas(split, kind))
    placed, leaves = small.select("rep", "leaf", "vec"), small.where("c IS NOT NULL").select("leaf", "n", "c", "radius")
    whole = rows.where("compact")
    if whole.limit(1).count():
        per = cut(whole.groupBy("node").agg(F.min("rep").alias("leaf"), F.count("*").alias("n"), _mean(p.dim).alias("c")))
        named = cut(_by_node(whole, per.select("node", "leaf", "c"), p.dim))
        far = named.groupBy("leaf").agg(F.sqrt(F.max(_d2("vec", "c", p.dim))).alias("radius"))
        placed = placed.unionByName(named.select("rep", "leaf", "vec"))
        leaves = leaves.unionByName(per.join(far, "leaf").select("leaf", "n", "c", "radius"))
    return placed, leaves


def near_leaves(leaves: DataFrame, levels: list[DataFrame], p: Bisecting) -> DataFrame:
    """Pairs of leaves (a, b), a < b, that may hold vectors within reach: their balls, widened by half the reach, meet.

    Balls are sent down the planes to every node that they touch; two balls that meet do so in some node, and are compared there, in tiles.
    """
    d, half = p.dim, p.reach / 2 * (1 + 1e-9)
    at = leaves.select(F.lit(1).cast("bigint").alias("node"), "leaf", "c", (F.col("radius") + half).alias("r"))
    for planes in levels:
        j = _by_node(at, planes, d, "left")
        t = dot("c", F.col("w"), d) - F.col("b")
        kids = F.array_compact(F.array(F.when(t > -F.col("r"), F.xxhash64("node", F.lit(True))), F.when(t <= F.col("r"), F.xxhash64("node", F.lit(False)))))
        at = j.select(F.explode(F.when(F.col("w").isNull(), F.array("node")).otherwise(kids)).alias("node"), "leaf", "c", "r")
    at = cut(at)
    sizes = at.groupBy("node").agg(F.ceil(F.count("*") / F.lit(p.tile)).cast("int").alias("t"))
    base = _by_node(at, sizes, 1).withColumn("o", F.pmod(F.xxhash64("leaf"), F.col("t")).cast("int"))
    pair = lambda j: F.struct(F.least(j, F.col("o")).alias("p"), F.greatest(j, F.col("o")).alias("q"))
    tiles = base.withColumn("pq", F.explode(F.transform(F.sequence(F.lit(0), F.col("t") - 1), pair))).select("node", "pq.p", "pq.q", "o", "leaf", "c", "r")

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        c, r, leaf, o = stack(b["c"]), b["r"].to_numpy(), b["leaf"].to_numpy(), b["o"].to_numpy()
        across = b["p"].iloc[0] != b["q"].iloc[0]
        sq, out = (c * c).sum(1), []
        for lo in range(0, len(c), 512):
            part = slice(lo, lo + 512)
            d2 = sq[part, None] + sq[None] - 2 * c[part] @ c.T
            i, j = np.nonzero(d2 <= (r[part, None] + r[None]) ** 2 + 1e-6)
            i = i + lo
            keep = leaf[i] < leaf[j]
            if across:
                keep &= o[i] != o[j]
            out.append(pd.DataFrame({"a": leaf[i[keep]], "b": leaf[j[keep]]}))
        return pd.concat(out, ignore_index=True)

    return cut(tiles.groupBy("node", "p", "q").applyInPandas(meet, "a bigint, b bigint").distinct())


def touching_leaves(placed: DataFrame, leaves: DataFrame, pairs: DataFrame, p: Bisecting) -> DataFrame:
    """(a, b, complete) of the pairs of leaves that hold any two vectors within reach of each other; complete if all their vectors are. Exact.

    The vectors of the smaller leaf are first held against the ball of the other: those that lie within reach of, or beyond, all of it
    need no look at its members. Only pairs left open by that are compared vector by vector.
    """
    d, reach = p.dim, p.reach
    info, size = leaves.select("leaf", F.struct("n", "c", "radius").alias("i")), 48 + 8 * d
    one = sized_join(pairs, info.select(F.col("leaf").alias("a"), F.col("i").alias("ia")), "a", size)
    two = sized_join(one, info.select(F.col("leaf").alias("b"), F.col("i").alias("ib")), "b", size, spread_by=["a"])
    less = (F.col("ia.n") < F.col("ib.n")) | ((F.col("ia.n") == F.col("ib.n")) & (F.col("a") < F.col("b")))
    asked = cut(two.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("leaf"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("other"), F.when(less, F.col("ib")).otherwise(F.col("ia")).alias("i")).select("leaf", "other", "i.c", "i.radius"))
    v = sized_join(placed, asked, "leaf", size, spread_by=["rep"]).withColumn("dist", F.sqrt(_d2("vec", "c", d)))
    eps = 1e-9 * (1 + reach)
    held = F.when(F.col("dist") + F.col("radius") <= reach - eps, 1).when(F.col("dist") - F.col("radius") > reach + eps, -1).otherwise(0)
    judged = v.select("leaf", "other", "rep", "vec", held.alias("held"))
    per = cut(judged.groupBy("leaf", "other").agg(F.max((F.col("held") > 0).cast("int")).alias("near"), F.max((F.col("held") < 0).cast("int")).alias("far"), F.max((F.col("held") == 0).cast("int")).alias("open")))
    ask = per.where("open = 1 AND NOT (near = 1 AND far = 1)").select(F.col("leaf").alias("_l"), F.col("other").alias("_o"))
    unsure = judged.where("held = 0")
    unsure = unsure.join(ask, (F.col("leaf") == F.col("_l")) & (F.col("other") == F.col("_o")), "left_semi").select(F.col("leaf").alias("mine"), F.col("other").alias("leaf"), F.col("vec").alias("v"))
    met = sized_join(placed, cut(unsure), "leaf", size, spread_by=["rep"])
    within = 1 / (1 + F.sqrt(_d2("vec", "v", d))) >= p.min_sim
    exact = met.groupBy("mine", F.col("leaf").alias("_other")).agg(F.max(within.cast("int")).alias("some"), F.max((~within).cast("int")).alias("none"))
    j = per.join(exact, (F.col("leaf") == F.col("mine")) & (F.col("other") == F.col("_other")), "left")
    near, far = F.greatest("near", F.coalesce("some", F.lit(0))), F.greatest("far", F.coalesce("none", F.lit(0)))
    return j.where(near == 1).select(F.least("leaf", "other").alias("a"), F.greatest("leaf", "other").alias("b"), (far == 0).alias("complete"))


def whole_groups(leaves: DataFrame, touching: DataFrame, p: Bisecting) -> DataFrame:
    """(leaf, cluster_id) of the leaves that together are clusters.

    Leaves are merged where they touch; a merged set holds if its leaves all touch each other, completely, and no other leaf. That is
    read off per leaf: its touching leaves and itself have one least member, which all of them share, and are as many as share it.
    """
    ways = cut(touching.select("a", "b", "complete").unionByName(touching.select(F.col("b").alias("a"), F.col("a").alias("b"), "complete")))
    near = ways.groupBy(F.col("a").alias("leaf")).agg(F.count("*").alias("k"), F.min("b").alias("lo"), F.min("complete").alias("complete"))
    own = cut(leaves.select("leaf").join(near, "leaf", "left").select("leaf", (F.coalesce("k", F.lit(0)) + 1).alias("k"), F.least("leaf", "lo").alias("least"), F.coalesce("complete", F.lit(True)).alias("complete")))
    ends = sized_join(ways.select("a", "b"), own.select(F.col("leaf").alias("a"), F.col("least").alias("la")), "a", 32)
    ends = sized_join(ends, own.select(F.col("leaf").alias("b"), F.col("least").alias("lb")), "b", 32, spread_by=["a"])
    apart = ends.where("la <> lb").select(F.col("a").alias("leaf")).distinct().withColumn("apart", F.lit(True))
    state = own.join(apart, "leaf", "left").select("leaf", "least", "k", (F.col("complete") & F.col("apart").isNull()).alias("ok"))
    good = state.groupBy("least").agg(F.min("ok").alias("ok"), F.min("k").alias("k1"), F.max("k").alias("k2"), F.count("*").alias("have")).where("ok AND k1 = have AND k2 = have").select("least")
    return sized_join(state.select("leaf", "least"), cut(good), "least", 16).select("leaf", F.col("least").alias("cluster_id"))


def similarity_clusters(nodes: DataFrame, p: Bisecting) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, leaves, classes): members (cluster_id, id, rep, leaf); leaves (leaf, cluster_id or null, n, c, radius); classes by distinct vector.

    A cluster is a set of at least ``min_size`` ids any two of which are within reach and none of which is within reach of an id outside; its id is the
    least of the set. Bisecting k-means gives leaves in which any two vectors are within reach; every cluster is a union of leaves, as a leaf that
    held one of its vectors and an outsider would not be compact. Leaves that touch are found through the tree, checked exactly and merged.
    Unusable values take no part; equal vectors are one row throughout; an empty table gives no clusters.
    """
    classes, members = vector_classes(usable_vectors(nodes, p.dim), 1)
    rows, levels = split_nodes(classes, p)
    placed, leaves = leaf_rows(rows, p)
    touching = cut(touching_leaves(placed, leaves, near_leaves(leaves, levels, p), p))
    groups = cut(whole_groups(leaves, touching, p))
    in_group = sized_join(placed.select("rep", "leaf"), groups, "leaf", 32)
    held = sized_join(in_group.select("rep", "cluster_id"), cut(classes.select("rep", "m")), "rep", 24)
    sizes = cut(held.groupBy("cluster_id").agg(F.sum("m").alias("n")).where(F.col("n") >= p.min_size).select("cluster_id"))
    kept = cut(sized_join(groups, sizes, "cluster_id", 16))
    inside = sized_join(placed.select("rep", "leaf"), kept, "leaf", 32, spread_by=["rep"])
    out = salted_join(members, inside.select("rep", "leaf", "cluster_id"), "rep").select("cluster_id", "id", "rep", "leaf")
    return out, leaves.join(kept, "leaf", "left").select("leaf", "cluster_id", "n", "c", "radius"), classes


def describe_clusters(members: DataFrame, classes: DataFrame, nodes: DataFrame, p: Bisecting, typical: int = 3) -> DataFrame:
    """One row per cluster: (cluster_id, n_members, n_partitions, typical_ids, max_distance).

    Typical members are those nearest to the mean of all members, ties (of nine decimals) by id. Partitions are those of the members' node rows.
    """
    d = p.dim
    m = cut(salted_join(members, classes.select("rep", "vec"), "rep").select("cluster_id", "id", "vec"))
    centre = cut(m.groupBy("cluster_id").agg(F.count("*").alias("n_members"), _mean(d).alias("c")))
    far = cut(salted_join(m, centre.select("cluster_id", "c", "n_members"), "cluster_id", spread_by=["id"]).select("cluster_id", "id", "n_members", F.round(F.sqrt(_d2("vec", "c", d)), 9).alias("dist")))
    salts = F.greatest(F.lit(cores(members.sparkSession)).cast("bigint"), F.ceil(F.col("n_members") / F.lit(HEAVY_ROWS)))
    first = far.withColumn("s", F.pmod(F.xxhash64("id"), salts)).withColumn("r", F.row_number().over(Window.partitionBy("cluster_id", "s").orderBy("dist", "id"))).where(F.col("r") <= typical)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("dist", "id"))).where(F.col("r") <= typical)
    names = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical_ids"))
    widest = far.groupBy("cluster_id").agg(F.max("dist").alias("max_distance"))
    per_part = nodes.select("id", "partition").distinct().join(members.select("cluster_id", "id"), "id").select("cluster_id", "partition").distinct().groupBy("cluster_id").agg(F.count("*").alias("n_partitions"))
    return centre.drop("c").join(names, "cluster_id").join(widest, "cluster_id").join(per_part, "cluster_id").select("cluster_id", "n_members", "n_partitions", "typical_ids", F.round("max_distance", 6).alias("max_distance"))
