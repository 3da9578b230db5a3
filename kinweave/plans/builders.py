"""Graph builders: exact in blocks, locality-sensitive buckets, context-triggered pieces, neighbour-of-neighbour refinement."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import encoders
from kinweave.functions.similarity import COSINE, DECIMALS, SPARSE_COSINE, Similarity
from kinweave.operators.graph import symmetrise
from kinweave.operators.tiles import tiled_self_join
from kinweave.operators.topk import top_k
from kinweave.session import cores, cut, drop_cut


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def block_top_k(left: DataFrame, right: DataFrame, k: int, sim: Similarity, tile: int = 2048, same: bool = False) -> DataFrame:
    """(src, dst, sim, rank): for every row of left(id, value) the k most similar rows of right(id, value); exact.

    Both sides are cut into tiles of about ``tile`` rows by a hash of the id; each pair of tiles is one group, compared as blocks, and yields k
    rows per left row, which are then merged. Memory per task is bounded by the tile, nothing is broadcast. With ``same`` (left is
    right) a row is not compared with itself, and under a symmetric similarity each pair of tiles is compared once, for both. Null ids and values take no part; each id should occur once.
    """
    n_left = left.count()
    n_right = n_left if same else right.count()
    tl, tr = max(1, math.ceil(n_left / tile)), max(1, math.ceil(n_right / tile))
    kind = _type(left, "value")

    half = same and sim.symmetric

    def side(df: DataFrame, own: int, other: int, first: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        low, high = (F.col("_m") if half and first else F.lit(0)), (F.col("_m") if half and not first else F.lit(other - 1))
        rest = F.explode(F.sequence(low, high))
        t = df.where("id IS NOT NULL AND value IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "value", mine.alias("_m")).withColumn("_o", rest)
        p, q = ("_m", "_o") if first else ("_o", "_m")
        return t.select(F.col(p).cast("int").alias("p"), F.col(q).cast("int").alias("q"), F.lit(first).alias("l"), "id", "value")

    both = side(left, tl, tr, True).unionByName(side(right, tr, tl, False))

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        x, y = b[b["l"]], b[~b["l"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"src": [], "dst": [], "sim": []})
        x, y = x.sort_values("id"), y.sort_values("id")
        xi, yi, yv = x["id"].to_numpy(), y["id"].to_numpy(), y["value"].tolist()
        out = []
        back = half and b["p"].iloc[0] != b["q"].iloc[0]
        best_s, best_i = np.full((len(yi), 0), -np.inf), np.zeros((len(yi), 0), dtype=xi.dtype)
        for lo in range(0, len(x), 512):
            m = np.round(sim.block(x["value"].iloc[lo : lo + 512].tolist(), yv), DECIMALS)
            ids = xi[lo : lo + 512]
            m = np.where(np.isnan(m), -np.inf, m)
            if same:
                m[ids[:, None] == yi[None]] = -np.inf
            if back:  # the k best so far for the rows of the other tile
                s, i = np.concatenate([best_s, m.T], axis=1), np.concatenate([best_i, np.broadcast_to(ids, (len(yi), len(ids)))], axis=1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            n = min(k, len(yi))
            order = np.argsort(-m, axis=1, kind="stable")[:, :n]  # columns ascend by id, so ties do
            s = np.take_along_axis(m, order, 1)
            r, c = np.nonzero(np.isfinite(s))
            out.append(pd.DataFrame({"src": ids[r], "dst": yi[order[r, c]], "sim": s[r, c]}))
        if back:
            r, c = np.nonzero(np.isfinite(best_s))
            out.append(pd.DataFrame({"src": yi[r], "dst": best_i[r, c], "sim": best_s[r, c]}))
        return pd.concat(out, ignore_index=True)

    tasks = max(1, min(tl * tr, 2000))
    pairs = both.repartition(tasks, "p", "q").groupBy("p", "q").applyInPandas(compare, "src bigint, dst bigint, sim double")
    assert kind == _type(right, "value"), "both sides must hold values of one type"
    return top_k(pairs, k, keep_self=not same)


class GraphBuilder:
    """Base of all builders: ``k`` (default 10) neighbours under ``similarity``; ``build(nodes)`` gives edges(src, dst, sim, rank).

    nodes(id, value): null ids and values take no part, an empty table gives no edges, other columns are ignored. A node is never its own
    neighbour; a node without any comparable other has no edges.
    """

    def __init__(self, similarity: Similarity | None = None, k: int = 10) -> None:
        if k <= 0:
            raise ValueError("k must be positive")
        self.k, self.similarity = k, similarity

    def build(self, nodes: DataFrame) -> DataFrame:
        if self.similarity is None:
            raise ValueError("a similarity must be set")
        one = nodes.where("id IS NOT NULL AND value IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "value")
        return self._build(one)

    def _build(self, nodes: DataFrame) -> DataFrame:
        raise NotImplementedError


class Brute(GraphBuilder):
    """All pairs, exact, in blocks."""

    def __init__(self, similarity: Similarity | None = None, k: int = 10, tile: int = 2048) -> None:
        super().__init__(similarity, k)
        self.tile = tile

    def _build(self, nodes: DataFrame) -> DataFrame:
        return block_top_k(nodes, nodes, self.k, self.similarity, self.tile, same=True)


class BucketBuilder(GraphBuilder):
    """Nodes that share a bucket are compared, block by block. ``signature(Column) -> array<int>``.

    The bucket is the signature's value alone, whatever the stage it comes from, unless ``stage_qualified``. Buckets larger than ``tile`` are
    handled as pairs of tiles, so that a hot bucket is neither cut short nor handled by one task.
    ``inner='nndescent'`` refines inside each bucket tile instead of comparing all.
    """

    def __init__(self, signature: Callable[[Column], Column], similarity: Similarity | None = None, k: int = 10, stage_qualified: bool = False, tile: int = 1024, inner: str = "brute") -> None:
        super().__init__(similarity, k)
        if inner not in ("brute", "nndescent"):
            raise ValueError("inner must be brute or nndescent")
        self.signature, self.stage_qualified, self.tile, self.inner = signature, stage_qualified, tile, inner

    def bin(self, nodes: DataFrame) -> DataFrame:
        """(id, value, bucket), each node once per bucket."""
        s = nodes.select("id", "value", F.posexplode(self.signature(F.col("value"))).alias("stage", "code"))
        b = F.concat_ws(":", "stage", "code") if self.stage_qualified else F.col("code").cast("string")
        return s.select("id", "value", b.alias("bucket")).dropDuplicates(["id", "bucket"])

    def _build(self, nodes: DataFrame) -> DataFrame:
        k, sim, inner = self.k, self.similarity, self.inner
        binned = self.bin(nodes)
        sizes = F.broadcast(cut(binned.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(self.tile)).cast("int").alias("t")).where("t > 1")))  # at most rows / tile
        b = binned.join(sizes, "bucket", "left").withColumn("t", F.coalesce("t", F.lit(1))).withColumn("o", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
        pq = F.explode(F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.struct(F.least(j, F.col("o")).alias("p"), F.greatest(j, F.col("o")).alias("q"))))
        spread = b.withColumn("pq", pq).select("bucket", "pq.p", "pq.q", "o", "id", "value")

        def compare(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("id")
            ids, vals, own = g["id"].to_numpy(), g["value"].tolist(), g["o"].to_numpy()
            if len(ids) < 2:
                return pd.DataFrame({"src": [], "dst": [], "sim": []})
            if inner == "nndescent" and g["p"].iloc[0] == g["q"].iloc[0]:
                return local_nn_descent(ids, vals, sim, k)
            if g["p"].iloc[0] == g["q"].iloc[0]:
                m = np.round(sim.block(vals, vals), DECIMALS)
            else:  # only across the two tiles
                m = np.full((len(ids), len(ids)), -np.inf)
                one, two = np.nonzero(own == own[0])[0], np.nonzero(own != own[0])[0]
                for x, y in ((one, two), (two, one)):
                    m[np.ix_(x, y)] = np.round(sim.block([vals[i] for i in x], [vals[i] for i in y]), DECIMALS)
            m[np.isnan(m)] = -np.inf
            np.fill_diagonal(m, -np.inf)
            order = np.argsort(-m, axis=1, kind="stable")[:, :k]
            s = np.take_along_axis(m, order, 1)
            r, c = np.nonzero(np.isfinite(s))
            return pd.DataFrame({"src": ids[r], "dst": ids[order[r, c]], "sim": s[r, c]})

        spark = nodes.sparkSession  # few rows make much work here, so that their number of bytes must not set that of tasks
        spread = spread.repartition(max(4 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket", "p", "q")
        return top_k(spread.groupBy("bucket", "p", "q").applyInPandas(compare, "src bigint, dst bigint, sim double"), k)


def local_nn_descent(ids: np.ndarray, vals: list, sim: Similarity, k: int, rounds: int = 10, delta: float = 0.01, seed: int = 3) -> pd.DataFrame:
    """Neighbour-of-neighbour refinement inside one block (Dong et al., 2011); stops when under ``delta`` of the lists change."""
    n = len(ids)
    k = min(k, n - 1)
    rng = np.random.default_rng(seed)
    nb = np.array([rng.choice(np.delete(np.arange(n), i), k, replace=False) for i in range(n)])
    score = np.array([sim.block([vals[i]], [vals[j] for j in nb[i]])[0] for i in range(n)])
    for _ in range(rounds):
        back: list[set[int]] = [set() for _ in range(n)]
        for i in range(n):
            for j in nb[i]:
                back[j].add(i)
        changed = 0
        for i in range(n):
            around = set(nb[i]) | back[i]
            cand = {int(x) for a in around for x in (*nb[a], *back[a])} | back[i]
            cand = np.array(sorted(cand - set(nb[i].tolist()) - {i}), dtype=int)
            if len(cand):
                s = np.nan_to_num(sim.block([vals[i]], [vals[j] for j in cand])[0], nan=-np.inf)
                ai, as_ = np.concatenate([nb[i], cand]), np.concatenate([score[i], s])
                best = np.lexsort((ids[ai], -np.nan_to_num(as_, nan=-np.inf)))[:k]
                changed += len(set(ai[best].tolist()) - set(nb[i].tolist()))
                nb[i], score[i] = ai[best], as_[best]
        if changed < delta * n * k:
            break
    r = np.repeat(np.arange(n), k)
    return pd.DataFrame({"src": ids[r], "dst": ids[nb.ravel()], "sim": np.round(score.ravel(), DECIMALS)}).dropna()


class SuperBitLsh(BucketBuilder):
    """Dense vectors of ``dim`` components: signs against orthonormal directions, ``stages`` values of ``buckets``."""

    def __init__(self, dim: int, stages: int = 3, buckets: int = 10, similarity: Similarity = COSINE, k: int = 10, seed: int = 11, **more) -> None:
        if min(dim, stages, buckets) <= 0:
            raise ValueError("dim, stages and buckets must be positive")
        bits = max(1, math.ceil(math.log2(max(2, buckets)))) + 1
        self.planes = encoders.superbit_planes(dim, bits * stages, seed)
        super().__init__(lambda v: encoders.superbit_signature(v, self.planes, stages, buckets), similarity, k, **more)


class SuperBitLshSparse(BucketBuilder):
    """The same for maps from dimension to number (integer or double)."""

    def __init__(self, dim: int, stages: int = 3, buckets: int = 10, similarity: Similarity = SPARSE_COSINE, k: int = 10, seed: int = 11, **more) -> None:
        if min(dim, stages, buckets) <= 0:
            raise ValueError("dim, stages and buckets must be positive")
        bits = max(1, math.ceil(math.log2(max(2, buckets)))) + 1
        hashed = dim > encoders.TABLED_DIMS
        planes = np.zeros((bits * stages, 1)) if hashed else encoders.superbit_planes(dim, bits * stages, seed)
        super().__init__(lambda v: encoders.superbit_signature_sparse(v, planes, stages, buckets, hashed, seed), similarity, k, **more)


class Ctph(BucketBuilder):
    """Texts: buckets by context-triggered pieces."""

    def __init__(self, similarity: Similarity | None = None, stages: int = 3, buckets: int = 10, k: int = 10, **more) -> None:
        if min(stages, buckets) <= 0:
            raise ValueError("stages and buckets must be positive")
        super().__init__(lambda v: encoders.ctph_signature(v, stages, buckets), similarity, k, **more)


def score_pairs(pairs: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """(src, dst, sim) of pairs(src, dst): values are joined to the ids late, so that only ids are shuffled before."""
    v = nodes.select("id", "value")
    a, b = v.select(F.col("id").alias("src"), F.col("value").alias("_a")), v.select(F.col("id").alias("dst"), F.col("value").alias("_b"))
    j = pairs.select("src", "dst").join(a, "src").join(b, "dst")
    return j.select("src", "dst", sim.column(F.col("_a"), F.col("_b")).alias("sim"))


class NNDescent(GraphBuilder):
    """Neighbour-of-neighbour refinement: random start lists, then per round all pairs of nodes around a common centre.

    ``iterations`` rounds at most; it stops earlier when under ``delta`` of all places change. All neighbours and all reverse neighbours of a centre
    are joined; a centre with more than ``tile`` of them is joined tile pair by tile pair, so that no task receives a hub.
    A node keeps its list even if nothing else is found.
    """

    def __init__(self, similarity: Similarity | None = None, k: int = 10, iterations: int = 10, delta: float = 0.002, tile: int = 256, seed: int = 3) -> None:
        super().__init__(similarity, k)
        if iterations <= 0:
            raise ValueError("iterations must be positive")
        self.iterations, self.delta, self.tile, self.seed = iterations, delta, tile, seed

    def start(self, nodes: DataFrame) -> DataFrame:
        """About 2k partners per node: every node enters ten of n / (2k) hashed buckets, and meets the next ones there in a hashed order."""
        from pyspark.sql.window import Window

        n = nodes.count()
        buckets = max(1, n // (4 * self.k))
        e = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
        e = e.select("id", "i", F.pmod(F.xxhash64("id", "i", F.lit(self.seed)), F.lit(buckets)).alias("b"), F.xxhash64("id", "i", F.lit(self.seed + 1)).alias("h"))
        w = Window.partitionBy("i", "b").orderBy("h", "id")
        ahead = range(1, max(2, self.k // 3) + 1)
        near = e.select(F.col("id").alias("src"), *[F.lead("id", j).over(w).alias(f"d{j}") for j in ahead])
        pairs = near.select("src", F.explode(F.array(*[f"d{j}" for j in ahead])).alias("dst")).where("dst IS NOT NULL AND src <> dst")
        return symmetrise(pairs)

    def around(self, g: DataFrame) -> DataFrame:
        """(src, dst), src < dst: pairs around a common centre of which at least one came to it in the last round; all others were scored before."""
        both = g.select(F.col("src").alias("c"), F.col("dst").alias("x"), "fresh").unionByName(g.select(F.col("dst").alias("c"), F.col("src").alias("x"), "fresh"))
        around = cut(both.groupBy("c", "x").agg(F.max("fresh").alias("fresh")))
        large = F.broadcast(cut(around.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > self.tile)))  # at most rows / tile
        sized = around.join(large, "c", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        pairs = tiled_self_join(sized, "c", "n", "x", ["fresh"], lambda x, y: x("fresh") | y("fresh"), self.tile)
        return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()

    def _build(self, nodes: DataFrame) -> DataFrame:
        nodes = cut(nodes)
        g = cut(top_k(score_pairs(self.start(nodes), nodes, self.similarity), self.k).withColumn("fresh", F.lit(True)))
        for _ in range(self.iterations):
            two = self.around(g)
            scored = cut(score_pairs(two, nodes, self.similarity))
            known = g.select("src", "dst", "sim")
            both = scored.unionByName(known)
            ways = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
            new = cut(top_k(ways, self.k).join(g.select("src", "dst", F.lit(False).alias("_old")), ["src", "dst"], "left").select("src", "dst", "sim", "rank", F.col("_old").isNull().alias("fresh")))
            changed, total = new.agg(F.coalesce(F.sum(F.col("fresh").cast("bigint")), F.lit(0)), F.count("*")).first()
            drop_cut(scored, g)
            g = new
            if changed <= self.delta * total:
                break
        return g.drop("fresh")
