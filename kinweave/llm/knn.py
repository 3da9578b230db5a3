"""Most similar vectors for every vector: an HNSW graph per shard, shard results merged (problem 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.hnsw import Hnsw
from kinweave.llm.vectors import radius_of, similarity, stack, usable_vectors, vector_classes
from kinweave.operators.skew import salted_join, sized_join
from kinweave.session import cut, drop_cut


@dataclass(frozen=True)
class Knn:
    """``shard_rows``: vectors per shard aimed at, a shard of more than twice as many is cut again; ``m``, ``ef``: links and beam width of the graphs;
    ``fit_rows``: rows of the sample on which a block of at most ``block`` shards is fitted; ``probes``: other shards that a query goes
    on to at most, nearest planes first (None: all that its ball touches, so that only what the walks miss is lost)."""

    dim: int = 24
    k: int = 10
    min_sim: float = 0.25
    shard_rows: int = 16384
    m: int = 12
    ef: int = 48
    fit_rows: int = 20000
    block: int = 256
    probes: int | None = 24
    seed: int = 5


@dataclass
class Planes:
    """A binary tree of planes in heap order: below a node t = x.w - b > 0 goes to the second child. Leaves are shards."""

    w: np.ndarray
    b: np.ndarray
    depth: int

    def homes(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = node * 2 + (np.einsum("nd,nd->n", x, self.w[node]) - self.b[node] > 0)
        return node - (1 << self.depth)

    def reach(self, x: np.ndarray, radius: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, gap) of the shards that a ball around each row touches, its own first: per row the ``most`` of least gap.

        The gap, the largest distance to a plane that lies between, bounds the distance to anything in the shard from below.
        """
        row, node, gap = np.arange(len(x)), np.ones(len(x), dtype=np.int64), np.zeros(len(x))
        for _ in range(self.depth):
            t = np.einsum("nd,nd->n", x[row], self.w[node]) - self.b[node]
            side, far = t > 0, np.maximum(gap, np.abs(t))
            both = far <= radius[row] * (1 + 1e-9) + 1e-12
            row, node, gap = np.concatenate([row, row[both]]), np.concatenate([node * 2 + side, node[both] * 2 + ~side[both]]), np.concatenate([gap, far[both]])
        order = np.lexsort((node, gap, row))
        row, node, gap = row[order], node[order], gap[order]
        if most is not None:
            first = np.searchsorted(row, np.arange(len(x)))
            keep = np.arange(len(row)) - first[row] < most
            row, node, gap = row[keep], node[keep], gap[keep]
        return row, node - (1 << self.depth), gap

    def flat(self) -> dict[str, bytes | int]:
        return {"depth": self.depth, "w": self.w.astype("<f8").tobytes(), "b": self.b.astype("<f8").tobytes()}

    @classmethod
    def load(cls, depth: int, w: bytes, b: bytes) -> Planes:
        return cls(np.frombuffer(w, dtype="<f8").reshape(1 << depth, -1), np.frombuffer(b, dtype="<f8"), depth)


def fit_planes(sample: np.ndarray, shards_log2: int, margin: float) -> Planes:
    """Planes across the direction of largest spread, placed in the middle range where the fewest sample points lie near."""
    dim = sample.shape[1] if sample.size else 1
    size = 1 << shards_log2
    w, b = np.zeros((size, dim)), np.zeros(size)
    parts = {1: sample}
    for node in range(1, size):
        x = parts.pop(node, sample[:0])
        if len(x) >= 4:
            _, vectors = np.linalg.eigh(np.cov(x.T) + 1e-12 * np.eye(dim))
            w[node] = vectors[:, -1]
            t = np.sort(x @ w[node])
            at = t[(np.linspace(0.35, 0.65, 31) * (len(t) - 1)).astype(int)]
            near = np.searchsorted(t, at + margin) - np.searchsorted(t, at - margin)
            b[node] = at[near.argmin()]
            if b[node] >= t[-1]:  # most points lie at one place of this direction: cut below it
                lower = t[t < t[-1]]
                b[node] = (lower[-1] + t[-1]) / 2 if len(lower) else t[-1]
            side = x @ w[node] > b[node]
        else:
            w[node, node % dim] = 1.0
            b[node] = float(np.median(x[:, node % dim])) if len(x) else 0.0
            side = x @ w[node] > b[node] if len(x) else np.zeros(0, dtype=bool)
        if 2 * node < size:
            parts[2 * node], parts[2 * node + 1] = x[~side], x[side]
    return Planes(w, b, shards_log2)


_INDEX = "n int, dim int, m int, vectors binary, base binary, sizes binary, members binary, links binary"
_FLAT = ["n", "dim", "m", "vectors", "base", "sizes", "members", "links"]


def _found(reps: np.ndarray, own: np.ndarray, ids: np.ndarray, d2: np.ndarray, labels: np.ndarray, p: Knn) -> tuple[list, list, np.ndarray]:
    """Per query the k nearest other points within reach, ties by id; and the radius beyond which nothing more is wanted."""
    lab = np.where(ids >= 0, labels[np.maximum(ids, 0)], np.iinfo(np.int64).max)
    bad = (ids < 0) | (lab == own[:, None]) | (similarity(d2) < p.min_sim)
    d2 = np.where(bad, np.inf, d2)
    order = np.lexsort((lab, d2), axis=1)[:, : p.k]
    d2, lab = np.take_along_axis(d2, order, 1), np.take_along_axis(lab, order, 1)
    count = np.isfinite(d2).sum(axis=1)
    radius = np.where(count >= p.k, np.sqrt(np.where(np.isfinite(d2[:, -1]), d2[:, -1], 0)), radius_of(p.min_sim))
    return [r[:c] for r, c in zip(lab, count)], [r[:c] for r, c in zip(d2, count)], radius


def _block_bytes(p: Knn) -> int:
    return 64 + 8 * p.block * (p.dim + 1)


def nearest_vectors(nodes: DataFrame, p: Knn) -> DataFrame:
    """For every usable vector its k most similar others with similarity of at least ``min_sim``: (src, dst, sim, place).

    Similarity is 1 / (1 + Euclidean distance); equal ones rank by smaller id. ``nodes``: (id, value, loaded_at); unusable values take no part,
    re-delivered ids count once, equal vectors are indexed once and expanded at the end. Every vector is indexed and every one is a query.

    1. Planes fitted on a bounded sample cut space into shards of about ``shard_rows`` vectors: a block of up to ``block`` shards from the
       whole, then blocks of their own, fitted in tasks, for shards that are still too large.
    2. One task per shard builds the shard's graph and searches it for the shard's own vectors, starting at themselves.
    3. A query goes on to the shards that the ball of its k-th distance (or of ``min_sim``) touches, nearest first, at most ``probes``: none
       of the untouched can hold a better answer. The shards' flat arrays are read from the written index.
    4. The shards' results are merged per query.

    What is lost is what the walk in a graph misses, and what lies beyond the probes; recall is measured against brute force in the tests.
    """
    spark = nodes.sparkSession
    classes, members = vector_classes(usable_vectors(nodes, p.dim), p.k + 1)
    n = classes.count()
    margin = min(radius_of(p.min_sim), 1.0)
    log2 = min(max(0, math.ceil(math.log2(max(1, n) / p.shard_rows))), int(math.log2(p.block)))
    sample = classes.select("vec").orderBy(F.xxhash64("rep", F.lit(p.seed))).limit(p.fit_rows).toPandas()["vec"] if log2 else pd.Series(dtype=object)
    planes = fit_planes(stack(sample) if len(sample) else np.zeros((0, p.dim)), log2, margin)
    shared = spark.sparkContext.broadcast(planes)  # at most ``block`` planes

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(shard=shared.value.homes(stack(b["vec"])))

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        d = min(max(1, math.ceil(math.log2(int(b["n"].iloc[0]) / p.shard_rows))), int(math.log2(p.block)))
        return pd.DataFrame([{"shard": int(b["shard"].iloc[0]), **fit_planes(stack(b.sort_values("rep")["vec"]), d, margin).flat()}])

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (_, depth), part in b.groupby(["shard", "depth"]):
                f = part.iloc[0]
                yield pd.DataFrame({"rep": part["rep"], "vec": part["vec"], "shard": part["shard"], "leaf": Planes.load(int(depth), f["w"], f["b"]).homes(stack(part["vec"]))})

    placed = cut(classes.select("rep", "vec").mapInPandas(place, "rep bigint, vec array<double>, shard bigint"))
    blocks: list[DataFrame] = []
    below = F.xxhash64("shard", "leaf").alias("shard")
    while True:
        sizes = cut(placed.groupBy("shard").agg(F.count("*").alias("n")))
        large = sizes.where(F.col("n") > 2 * p.shard_rows)
        if not large.limit(1).count():
            break
        few = sized_join(placed, large, "shard", 24).where(F.pmod(F.xxhash64("rep", F.lit(p.seed)), F.ceil(F.col("n") / F.lit(p.fit_rows))) == 0)
        blocks.append(cut(few.groupBy("shard").applyInPandas(fit, "shard bigint, depth int, w binary, b binary")))
        inner = sized_join(placed, blocks[-1], "shard", _block_bytes(p)).mapInPandas(deeper, "rep bigint, vec array<double>, shard bigint, leaf bigint")
        whole = sized_join(placed, large.select("shard"), "shard", 16, "left_anti")
        after = cut(whole.unionByName(inner.select("rep", "vec", below)))
        drop_cut(placed)
        placed = after
    shards = max(1, sizes.count())

    def build(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rep")
        x, reps = stack(b["vec"]), b["rep"].to_numpy()
        h = Hnsw(x, m=p.m, ef=p.ef, seed=p.seed).build()
        ids, d2 = h.search(x, p.ef, own=np.arange(len(x)))
        nn, nd, radius = _found(reps, reps, ids, d2, reps, p)
        shard = int(b["shard"].iloc[0])
        f = h.flat()
        none = [None] * len(reps)
        table = {"shard": [shard] * (len(reps) + 1), "rep": [*reps.tolist(), None], "vec": [*b["vec"], None], "nn": [*nn, None], "nd": [*nd, None], "radius": [*radius.tolist(), None], "reps": [*none, reps.astype("<i8").tobytes()]}
        table |= {c: [*none, f[c]] for c in _FLAT}
        return pd.DataFrame({c: pd.Series(v, dtype="Int64" if c in ("rep", "n", "dim", "m") else None if c in ("shard", "radius") else object) for c, v in table.items()})

    schema = f"shard bigint, rep bigint, vec array<double>, nn array<bigint>, nd array<double>, radius double, reps binary, {_INDEX}"
    built = cut(placed.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(build, schema))
    own = built.where("rep IS NOT NULL")
    index = built.where("rep IS NULL").select("shard", "reps", *_FLAT)
    results = own.select("rep", "nn", "nd")

    if shards > 1:
        most = None if p.probes is None else p.probes + 1
        kind = "rep bigint, vec array<double>, home bigint, radius double, gap double, shard bigint"

        def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    row, shard, gap = shared.value.reach(stack(b["vec"]), b["radius"].to_numpy(), most)
                    yield pd.DataFrame({"rep": b["rep"].to_numpy()[row], "vec": b["vec"].to_numpy()[row], "home": b["home"].to_numpy()[row], "radius": b["radius"].to_numpy()[row], "gap": gap, "shard": shard})

        def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for (_, depth), part in b.groupby(["shard", "depth"]):
                    f, radius = part.iloc[0], part["radius"].to_numpy()
                    row, leaf, gap = Planes.load(int(depth), f["w"], f["b"]).reach(stack(part["vec"]), radius, most)
                    up = part.iloc[row]
                    yield pd.DataFrame({**{c: up[c].to_numpy() for c in ("rep", "vec", "home", "radius", "shard")}, "gap": np.maximum(up["gap"].to_numpy(), gap), "leaf": leaf})

        def search(q: pd.DataFrame, ix: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(ix):
                return pd.DataFrame({"rep": [], "nn": [], "nd": []})
            f = ix.iloc[0]
            ids, d2 = Hnsw.load(f).search(stack(q["vec"]), p.ef)
            reps = q["rep"].to_numpy()
            nn, nd, _ = _found(reps, reps, ids, d2, np.frombuffer(f["reps"], dtype="<i8"), p)
            return pd.DataFrame({"rep": reps, "nn": nn, "nd": nd})

        ways = own.select("rep", "vec", F.col("shard").alias("home"), "radius").mapInPandas(forward, kind)
        for block in blocks:
            inner = sized_join(ways, block, "shard", _block_bytes(p)).mapInPandas(onward, "rep bigint, vec array<double>, home bigint, radius double, shard bigint, gap double, leaf bigint")
            rest = sized_join(ways, block.select("shard"), "shard", 16, "left_anti")
            ways = cut(rest.unionByName(inner.select("rep", "vec", "home", "radius", "gap", below)))
        if blocks and most is not None:
            ways = ways.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("gap", "shard"))).where(F.col("r") <= most)
        sent = cut(ways.where("shard <> home").select("rep", "vec", "shard"))
        chunks = cut(sent.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(p.shard_rows)).cast("int").alias("chunks")))  # a row per shard
        q = sized_join(sent, chunks, "shard", 24).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).select("shard", "chunk", "rep", "vec")
        per = chunks.select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        ix = index.join(per, "shard").select("shard", "chunk", "reps", *_FLAT)
        tasks = 2 * shards
        q, ix = q.repartition(tasks, "shard", "chunk"), ix.repartition(tasks, "shard", "chunk")
        more = q.groupBy("shard", "chunk").cogroup(ix.groupBy("shard", "chunk")).applyInPandas(search, "rep bigint, nn array<bigint>, nd array<double>")
        results = results.unionByName(more)

    near = results.select("rep", F.explode(F.arrays_zip("nn", "nd")).alias("z")).select("rep", F.col("z.nn").alias("other"), F.col("z.nd").alias("d2"))
    best = Window.partitionBy("rep").orderBy("d2", "other")
    top = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= p.k).drop("r")
    ids = classes.select(F.col("rep").alias("other"), "ids")
    wide = salted_join(top, ids, "other", spread_by=["rep"]).select("rep", "d2", F.explode("ids").alias("dst"))
    wide = wide.unionByName(classes.where("m > 1").select("rep", F.lit(0.0).alias("d2"), F.explode("ids").alias("dst")))
    few = wide.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("d2", "dst"))).where(F.col("r") <= p.k + 1).select("rep", "d2", "dst")
    pairs = salted_join(members, few, "rep").where("id <> dst")
    place_ = F.row_number().over(Window.partitionBy("id").orderBy("d2", "dst"))
    out = pairs.withColumn("place", place_).where(F.col("place") <= p.k)
    return out.select(F.col("id").alias("src"), "dst", (1 / (1 + F.sqrt("d2"))).alias("sim"), "place")
