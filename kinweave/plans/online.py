"""Adding and removing batches of nodes with bounded local repair."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.similarity import Similarity
from kinweave.operators.graph import drop_nodes, in_neighbours, k_hop, partition_sizes
from kinweave.operators.topk import top_k
from kinweave.plans.builders import block_top_k, score_pairs
from kinweave.plans.partition import nearest_of
from kinweave.plans.search import SearchConfig, approximate_search
from kinweave.session import cut, drop_cut


@dataclass(frozen=True)
class OnlineConfig(SearchConfig):
    """Search settings for new nodes, and the depth of the repair around them. ``exhaustive``: compare new nodes with all."""

    update_depth: int = 2
    exhaustive: bool = False
    imbalance: float = 1.1


@dataclass
class OnlineGraph:
    """A graph that changes by batches; ``add`` and ``remove`` replace its frames. ``k`` is the length of all lists.

    ``similarities`` counts comparisons made so far, as the frames' metrics do.
    """

    nodes: DataFrame
    edges: DataFrame
    similarity: Similarity
    k: int = 10
    config: OnlineConfig = field(default_factory=OnlineConfig)
    medoids: DataFrame | None = None
    _own: list[DataFrame] = field(default_factory=list)
    similarities: dict[str, int] = field(default_factory=lambda: {"add": 0, "remove": 0, "search": 0})

    def add(self, batch: DataFrame) -> OnlineGraph:
        """Adds batch(id, value). Ids already present, repeated or null, and null values, are left out.

        New nodes find their lists by search (and among each other), are assigned to a partition, and are then offered to every node within
        ``update_depth`` steps of their neighbours.
        """
        c, k = self.config, self.k
        fresh = batch.where("id IS NOT NULL AND value IS NOT NULL").select("id", "value").dropDuplicates(["id"])
        new = cut(fresh.join(self.nodes.select("id"), "id", "left_anti"))
        if c.exhaustive:
            found = block_top_k(new, self.nodes.select("id", "value"), k, self.similarity)
        else:
            q = new.select(F.col("id").alias("query_id"), "value")
            found, m = approximate_search(self.nodes, self.edges, q, self.similarity, SearchConfig(k, c.speedup, c.expansion, c.random_jumps, False, c.max_rounds, c.seed, memory=c.memory))
            self.similarities["search"] += m.agg(F.sum("similarities")).first()[0] or 0
            found = found.withColumnRenamed("query_id", "src")
        among = block_top_k(new, new, k, self.similarity, same=True)
        own = cut(top_k(found.select("src", "dst", "sim").unionByName(among.select("src", "dst", "sim")), k))
        reached = k_hop(self.edges.select("src", "dst"), own.select(F.col("src").alias("new"), F.col("dst").alias("id")), c.update_depth, origin="new")
        offers = cut(score_pairs(reached.select(F.col("id").alias("src"), F.col("new").alias("dst")).where("src <> dst").distinct(), self.nodes.select("id", "value").unionByName(new), self.similarity))
        self.similarities["add"] += offers.count()
        everything = self.edges.select("src", "dst", "sim").unionByName(offers).unionByName(own.select("src", "dst", "sim"))
        self._replace(self.nodes.select("id", "value", "partition").unionByName(self.assign(new)), top_k(everything, k), offers, own, reached, new)
        return self

    def _replace(self, nodes: DataFrame, edges: DataFrame, *scratch: DataFrame) -> None:
        """Writes the new frames and deletes the tables that only the old ones needed."""
        old = self._own
        self.nodes, self.edges = cut(nodes), cut(edges)
        self._own = [self.nodes, self.edges]
        drop_cut(*scratch, *old)

    def clean(self) -> None:
        """Deletes the tables written for this graph; its frames can no longer be read."""
        drop_cut(*self._own)
        self._own = []

    def assign(self, new: DataFrame) -> DataFrame:
        """new(id, value) with its partition: that of the medoid of the highest similarity, lowered by how full the partition is; ties at random.

        Sizes are those before the batch; the discount is a real number, not one that stays zero until a partition is full.
        """
        if self.medoids is None:
            return new.select("id", "value", F.lit(0).alias("partition"))
        rows = self.medoids.orderBy("partition").collect()  # one row per partition
        sizes = {r["partition"]: r["n_nodes"] for r in partition_sizes(self.nodes).collect()}
        cap = max(1.0, self.config.imbalance * sum(sizes.values()) / len(rows))
        names = [r["partition"] for r in rows]
        room = np.array([1 - sizes.get(p, 0) / cap for p in names])
        pick = nearest_of(self.similarity, names, [r["value"] for r in rows], room, self.config.seed)
        return new.select("id", "value", pick(F.col("id"), F.col("value")).alias("partition"))

    def remove(self, ids: DataFrame) -> OnlineGraph:
        """Removes ids(id). Nodes that lose a neighbour are offered all nodes within ``update_depth`` steps of it and of its in-neighbours."""
        gone = cut(ids.where("id IS NOT NULL").select("id").distinct())
        hurt = cut(in_neighbours(self.edges, gone).join(gone.withColumnRenamed("id", "src"), "src", "left_anti"))
        starts = hurt.select(F.col("dst").alias("x"), F.col("src").alias("id")).unionByName(gone.select(F.col("id").alias("x"), "id"))
        around = k_hop(self.edges.select("src", "dst"), starts, self.config.update_depth, origin="x").join(gone, "id", "left_anti")
        pairs = hurt.join(around.select(F.col("x").alias("dst"), F.col("id").alias("y")), "dst").select("src", F.col("y").alias("dst")).where("src <> dst").distinct()
        left = drop_nodes(self.edges.select("src", "dst", "sim"), gone)
        nodes = self.nodes.select("id", "value", "partition").join(gone, "id", "left_anti")
        offers = cut(score_pairs(pairs.join(left.select("src", "dst"), ["src", "dst"], "left_anti"), nodes, self.similarity))
        self.similarities["remove"] += offers.count()
        self._replace(nodes, top_k(left.unionByName(offers), self.k), offers, hurt, gone)
        return self

    def size(self) -> int:
        return self.nodes.count()

    def sizes(self) -> DataFrame:
        return partition_sizes(self.nodes)
