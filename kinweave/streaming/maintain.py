"""Keeping a graph in parquet up to date from a stream of additions and removals, batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kinweave.functions.similarity import Similarity
from kinweave.plans.online import OnlineConfig, OnlineGraph
from kinweave.sources.graph_io import read_graph, write_graph


@dataclass(frozen=True)
class Maintainer:
    """``path`` holds one graph per version (v=0, v=1, ...); a batch reads the latest and writes the next.

    A version is named after its batch, so a batch that is run again after a failure overwrites its own result and adds nothing twice.
    With ``medoids`` (partition, id, value) new nodes go to the partition of the nearest medoid that has room, else to partition 0. Tables written
    on the way are deleted with each batch.
    """

    path: str
    similarity: Similarity
    k: int = 10
    config: OnlineConfig = OnlineConfig()
    medoids: DataFrame | None = None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch(id, value, op): op 'remove' takes the id out, anything else adds it."""
        spark = batch.sparkSession
        nodes, edges = read_graph(spark, f"{self.path}/v={batch_id}")
        g = OnlineGraph(nodes, edges, self.similarity, self.k, self.config, self.medoids)
        g.add(batch.where(~F.col("op").eqNullSafe("remove")).select("id", "value"))
        g.remove(batch.where("op = 'remove'").select("id"))
        write_graph(g.nodes, g.edges, f"{self.path}/v={batch_id + 1}", mode="overwrite")
        g.clean()

    def attach(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """The writer of a streaming frame (id, value, op); call ``start()`` on it. Version 0 must have been written."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
