"""Partitioners: by mixing hash, by balanced k-medoids, by swaps that cut fewer edges."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.encoders import mixing_partition, random_partition
from kinweave.functions.similarity import DECIMALS, Similarity
from kinweave.operators.graph import symmetrise
from kinweave.operators.skew import salted_join
from kinweave.operators.topk import sample_ids
from kinweave.session import cut, drop_cut


class Budget:
    """Never exhausted."""

    def exhausted(self, rounds: int) -> bool:
        return False


@dataclass
class IterationBudget(Budget):
    rounds: int

    def exhausted(self, rounds: int) -> bool:
        return rounds >= self.rounds


@dataclass
class TimeBudget(Budget):
    seconds: float
    began: float = field(default_factory=time.time)

    def exhausted(self, rounds: int) -> bool:
        return time.time() - self.began >= self.seconds


@dataclass
class Partitioning:
    """nodes with their new partition, the edges, the time taken, and the medoids where there are any."""

    nodes: DataFrame
    edges: DataFrame
    runtime_ms: int
    medoids: DataFrame | None = None

    def moved(self, partitions: int) -> DataFrame:
        """The nodes laid out by partition."""
        return self.nodes.repartition(partitions, "partition")


def nearest_of(sim: Similarity, names: list[int], values: list, weights: np.ndarray | None = None, seed: int | None = None):
    """A column function (id, value) -> the name of the most similar of a few values (the first of equal ones, or with ``seed`` one at random).

    ``weights`` multiply the similarities. A value that can be compared with none goes to the first name.
    """

    @F.pandas_udf("int")
    def pick(ids: pd.Series, v: pd.Series) -> pd.Series:
        m = np.round(sim.block(v.tolist(), values), DECIMALS)
        m = np.where(np.isnan(m), -np.inf, m)
        if weights is not None:
            m = np.where(np.isfinite(m), m * weights, m)
        if seed is not None:
            tie = np.array([[zlib.crc32(f"{i}:{n}:{seed}".encode()) for n in names] for i in ids]) / 2.0**33
            m = np.where(m == m.max(axis=1, keepdims=True), tie, -np.inf)
        return pd.Series(np.array(names)[m.argmax(axis=1)], dtype="int32")

    return pick


class Partitioner:
    def partition(self, nodes: DataFrame, edges: DataFrame) -> Partitioning:
        began = time.time()
        new, medoids = self._assign(nodes, edges)
        return Partitioning(cut(new), edges, int((time.time() - began) * 1000), medoids)

    def _assign(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        raise NotImplementedError


@dataclass
class Edge1D(Partitioner):
    partitions: int

    def _assign(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, None]:
        return nodes.withColumn("partition", mixing_partition(F.col("id"), self.partitions)), None


@dataclass
class KMedoids(Partitioner):
    """Medoids by a local search over swaps, then assignment under a capacity.

    Each round draws ``candidates`` nodes by hash and finds, in one pass over all nodes, the swap of a medoid for a candidate that raises the sum of the
    nodes' best similarities most; ``trials`` candidates are tried in all. Nodes are then assigned, group by group of about
    ``group_rows`` hashed nodes and in the order of their ids, to the medoid of the highest similarity times (1 - size / capacity);
    capacity is ``imbalance`` times the mean size (rounded up, so small groups stay feasible).
    """

    similarity: Similarity
    partitions: int
    imbalance: float = float("inf")
    trials: int = 1000
    candidates: int = 32
    group_rows: int = 4096
    budget: Budget = field(default_factory=Budget)
    seed: int = 13

    def medoids(self, nodes: DataFrame) -> DataFrame:
        spark = nodes.sparkSession
        sim, p = self.similarity, self.partitions
        n_draw = p + self.trials
        drawn = sample_ids(nodes.where("value IS NOT NULL"), n_draw, self.seed)
        pool = nodes.join(drawn, "id").select("id", "value").dropDuplicates(["id"]).orderBy(F.xxhash64("id", F.lit(self.seed)), "id").collect()  # p + trials rows
        ids, values = [r["id"] for r in pool], [r["value"] for r in pool]
        chosen, rest = list(range(min(p, len(ids)))), list(range(p, len(ids)))
        rounds = 0
        while rest and not self.budget.exhausted(rounds):
            tried, rest = rest[: self.candidates], rest[self.candidates :]
            now = [values[i] for i in chosen] + [values[i] for i in tried]
            k = len(chosen)

            def gains(batches: Iterator[pd.DataFrame], now=now, k=k) -> Iterator[pd.DataFrame]:
                total = np.zeros((len(now) - k, k + 1))
                for b in batches:
                    m = np.nan_to_num(sim.block(b["value"].tolist(), now), nan=0.0)
                    own = m[:, :k]
                    order = np.argsort(-own, axis=1)
                    first = np.take_along_axis(own, order[:, :1], 1)[:, 0]
                    second = np.take_along_axis(own, order[:, 1:2], 1)[:, 0] if k > 1 else np.zeros(len(own))
                    for c in range(len(now) - k):
                        for j in range(k):
                            without = np.where(order[:, 0] == j, second, first)
                            total[c, j] += np.maximum(without, m[:, k + c]).sum()
                        total[c, k] += first.sum()
                c, j = np.indices(total.shape)
                yield pd.DataFrame({"c": c.ravel(), "j": j.ravel(), "g": total.ravel()})

            g = nodes.where("value IS NOT NULL").select("value").mapInPandas(gains, "c int, j int, g double").groupBy("c", "j").agg(F.sum("g").alias("g")).collect()  # candidates x medoids
            base = next((r["g"] for r in g if r["j"] == k), 0.0)
            best = max((r for r in g if r["j"] < k), key=lambda r: r["g"], default=None)
            if best is not None and best["g"] > base + 1e-9:
                chosen[best["j"]] = tried[best["c"]]
            rounds += 1
        kind = nodes.schema["value"].dataType.simpleString()
        return spark.createDataFrame([(j, ids[i], values[i]) for j, i in enumerate(chosen)], f"partition int, id bigint, value {kind}")

    def assign(self, nodes: DataFrame, medoids: DataFrame) -> DataFrame:
        """nodes(id, value) with the partition of their medoid. Null values go to the emptiest partitions of their group."""
        rows = medoids.orderBy("partition").collect()  # one per partition
        names, values = [r["partition"] for r in rows], [r["value"] for r in rows]
        sim, imbalance, p = self.similarity, self.imbalance, len(rows)
        if not np.isfinite(imbalance):
            return nodes.select("id", "value").withColumn("partition", nearest_of(sim, names, values)(F.col("id"), F.col("value")))
        n = nodes.count()
        groups = max(1, -(-n // self.group_rows))
        kind = nodes.schema["value"].dataType.simpleString()

        def greedy(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("id")
            cap = np.ceil(imbalance * len(b) / p)
            size, out = np.zeros(p), np.empty(len(b), dtype=int)
            m = np.nan_to_num(sim.block(b["value"].tolist(), values), nan=0.0)
            for i in range(len(b)):
                score = np.where(size < cap, m[i] * (1 - size / cap) + 1e-12 * (cap - size), -np.inf)
                out[i] = int(score.argmax())
                size[out[i]] += 1
            return pd.DataFrame({"id": b["id"], "value": b["value"], "partition": np.array(names)[out]})

        g = nodes.select("id", "value", F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(groups)).alias("g"))
        return g.groupBy("g").applyInPandas(greedy, f"id bigint, value {kind}, partition int")

    def _assign(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        m = self.medoids(nodes)
        return self.assign(nodes.select("id", "value"), m), m


def swap_candidates(edges: DataFrame, color: DataFrame, sample: int, seed: int, symmetric: bool = False) -> DataFrame:
    """(p, q, cp, cq, dpp, dqq, dpq, dqp): pairs of nodes of different colors, neighbours or drawn by hash, with their neighbours per color.

    ``symmetric``: edges are distinct and hold both directions already. Every node carries its degrees as one map from color to count,
    of at most as many entries as there are partitions, so that each end of a pair is looked up once.
    """
    sym = edges.select("src", "dst") if symmetric else symmetrise(edges)
    c = color.select("id", "color")
    per = salted_join(sym, c.select(F.col("id").alias("dst"), "color"), "dst", spread_by=["src"]).groupBy(F.col("src").alias("id"), "color").agg(F.count("*").alias("d"))
    deg = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("color", "d"))).alias("deg"))
    node = cut(c.join(deg, "id", "left"))
    pairs = sym.select(F.col("src").alias("p"), F.col("dst").alias("q"))
    if sample > 0:
        rows = c.select("id", F.xxhash64("id", F.lit(seed)).alias("h"))
        w = Window.partitionBy("b").orderBy("h", "id")
        near = rows.withColumn("b", F.pmod("h", F.lit(4096))).select(F.col("id").alias("p"), *[F.lead("id", j).over(w).alias(f"q{j}") for j in range(1, sample + 1)])
        pairs = pairs.unionByName(near.select("p", F.explode(F.array(*[f"q{j}" for j in range(1, sample + 1)])).alias("q")).where("q IS NOT NULL")).distinct()
    end = lambda x: node.select(F.col("id").alias(x), F.col("color").alias(f"c{x}"), F.col("deg").alias(f"m{x}"))
    j = salted_join(salted_join(pairs.where("p <> q"), end("p"), "p", spread_by=["q"]), end("q"), "q", spread_by=["p"]).where("cp <> cq")
    d = lambda of, c: F.coalesce(F.try_element_at(f"m{of}", F.col(c)), F.lit(0))
    return j.select("p", "q", "cp", "cq", d("p", "cp").alias("dpp"), d("q", "cq").alias("dqq"), d("p", "cq").alias("dpq"), d("q", "cp").alias("dqp"))


def swap_requests(candidates: DataFrame, temperature: float) -> DataFrame:
    """(src, dst, src_color, dst_color, gain): per node its best partner among those whose new score times the temperature exceeds the old one."""
    old, new = F.col("dpp") * F.col("dpp") + F.col("dqq") * F.col("dqq"), F.col("dpq") * F.col("dpq") + F.col("dqp") * F.col("dqp")
    s = candidates.withColumn("old", old).withColumn("new", new).where((F.col("new") > 0) & (F.col("new") * F.lit(temperature) > F.col("old")))
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.col("new").desc(), "q"))).where("r = 1")
    return best.select(F.col("p").alias("src"), F.col("q").alias("dst"), F.col("cp").alias("src_color"), F.col("cq").alias("dst_color"), (F.col("new") - F.col("old")).alias("gain"))


def match_swaps(requests: DataFrame) -> DataFrame:
    """Requests of which no two share a node: each node takes part in its best one only, and both ends must agree on it."""
    r = requests.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    one = r.groupBy("a", "b").agg(F.max_by(F.struct("src", "dst", "src_color", "dst_color", "gain"), F.struct("gain", "src")).alias("s")).select("a", "b", "s.*")
    ends = one.select(F.col("a").alias("n"), "a", "b", "gain").unionByName(one.select(F.col("b").alias("n"), "a", "b", "gain"))
    best = ends.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.col("gain").desc(), "a", "b"))).where("r = 1")
    agreed = best.groupBy("a", "b").agg(F.count("*").alias("k")).where("k = 2")
    return one.join(agreed, ["a", "b"], "left_semi").select("src", "dst", "src_color", "dst_color")


@dataclass
class JaBeJa(Partitioner):
    """Random start, then rounds of agreed color swaps under annealing (Rahimian et al., 2013): sizes never change, cut edges fall.

    A node asks its neighbours and ``sample`` drawn nodes. Rounds end when no swap is agreed while the temperature is 1, when ``budget`` is
    spent (by default there is none), or, as swaps of one round do not see each other and may go to and fro, when ``patience`` rounds
    at temperature 1 agreed on no fewer swaps than one before them. ``rounds`` tells how many were made.
    """

    partitions: int
    budget: Budget = field(default_factory=Budget)
    temperature: float = 2.0
    delta: float = 0.003
    sample: int = 10
    patience: int = 20
    seed: int = 21
    rounds: int = 0

    def _assign(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, None]:
        color = cut(nodes.select("id").distinct().select("id", random_partition(F.col("id"), self.partitions, self.seed).alias("color")))
        links = cut(symmetrise(edges))  # edges never change
        t = self.temperature
        self.rounds, fewest, since = 0, None, 0
        while not self.budget.exhausted(self.rounds):
            requests = cut(swap_requests(swap_candidates(links, color, self.sample, self.seed + self.rounds, symmetric=True), t))
            swaps = cut(match_swaps(requests))
            drop_cut(requests)
            self.rounds += 1
            agreed = swaps.count()
            if t <= 1:
                since = 0 if fewest is None or agreed < fewest else since + 1
                fewest = agreed if fewest is None else min(fewest, agreed)
            if t <= 1 and not agreed:
                drop_cut(swaps)
                break
            if agreed:
                new = swaps.select(F.col("src").alias("id"), F.col("dst_color").alias("to")).unionByName(swaps.select(F.col("dst").alias("id"), F.col("src_color").alias("to")))
                after = cut(color.join(new, "id", "left").select("id", F.coalesce("to", "color").alias("color")))
                drop_cut(color)
                color = after
            drop_cut(swaps)
            if since >= self.patience:
                break
            t = max(1.0, t - self.delta)
        return nodes.drop("partition").join(color, "id").withColumnRenamed("color", "partition"), None
