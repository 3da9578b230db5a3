"""Graphs, text lines, numbers per line, generated mixtures and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(id, value): one row per line of the text files at ``path``."""
    t = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), "value")
    return t.repartition(partitions) if partitions else t


def in_memory(spark: SparkSession, values: list, kind: str = "string") -> DataFrame:
    """(id, value) from a small list."""
    return spark.createDataFrame(list(enumerate(values)), f"id bigint, value {kind}")


def parse_numbers(line: Column, sep: str = ",") -> Column:
    """array<double> of the numbers of a line; what is no number becomes null."""
    return F.transform(F.split(line, sep), lambda x: F.trim(x).try_cast("double"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, files: int | None = None, mode: str = "error") -> None:
    """Parquet folders nodes/ and edges/ under ``path``."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        (df.coalesce(files) if files else df).write.mode(mode).parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def gaussian_mixture(spark: SparkSession, n: int, dim: int, centers: int, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, value array<double>, partition): n points around ``centers`` hashed centres in [0, 10 * spread)^dim; the same for the same seed.

    Normal deviates come from two hashes of id and component (Box-Muller), so a row does not depend on the layout.
    """
    unit = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    c = F.col("id") % centers
    comps = []
    for i in range(dim):
        z = F.sqrt(-2 * F.log(unit(F.col("id"), F.lit(i), F.lit(1)))) * F.cos(F.lit(6.283185307179586) * unit(F.col("id"), F.lit(i), F.lit(2)))
        comps.append(unit(c, F.lit(i), F.lit(3)) * F.lit(10.0 * spread) + z)
    return spark.range(n).select("id", F.array(*comps).alias("value"), F.lit(0).alias("partition"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Appends rows as tab-separated files with a header line."""
    rows.coalesce(1).write.mode("append").csv(path, sep="\t", header=True)
