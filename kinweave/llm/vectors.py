"""What the vector problems share: usable values, one row per distinct vector, exact distances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import salted_join
from kinweave.session import cut


def usable_vectors(nodes: DataFrame, dim: int) -> DataFrame:
    """(id, vec): one row per id whose value has ``dim`` finite components; of re-delivered ids the latest usable value.

    Null values, other lengths, null, NaN or infinite components make a value unusable.
    """
    v = F.col("value")
    fine = F.size(v) == dim
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = nodes.where("id IS NOT NULL AND value IS NOT NULL").where(F.coalesce(fine, F.lit(False))).select("id", F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"), "loaded_at")
    at = F.coalesce("loaded_at", F.lit("0001-01-01").cast(dict(rows.dtypes)["loaded_at"]))
    return rows.groupBy("id").agg(F.max_by("vec", F.struct(at, F.xxhash64("vec"))).alias("vec"))


def vector_classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row per distinct vector with its ``keep`` least ids, and the class of each id.

    classes: rep (least id), vec, m (ids), x (xor of the ids' hashes), ids (the least ``keep`` ids, ascending). The least ids are
    gathered over salts, so that a vector held by a third of all ids costs no task more than ``keep`` ids per salt.
    """
    keyed = vectors.select("id", F.xxhash64("vec", F.lit(1)).alias("h1"), F.xxhash64("vec", F.lit(2)).alias("h2"), "vec")
    salt = F.pmod(F.xxhash64("id"), F.lit(32)).cast("int")
    few = lambda c: F.slice(F.array_sort(c), 1, keep)
    # ids are gathered per class and salt in slices of the id's hash, then cut to the least ones
    part = keyed.groupBy("h1", "h2", salt.alias("s")).agg(F.min("id").alias("lo"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.any_value("vec").alias("vec"))
    classes = part.groupBy("h1", "h2").agg(F.min("lo").alias("rep"), F.sum("m").alias("m"), F.bit_xor("x").alias("x"), F.any_value("vec").alias("vec"))
    classes = cut(classes)
    members = cut(salted_join(keyed.select("h1", "h2", "id"), classes.select("h1", F.col("h2").alias("_h2"), "rep", "m"), "h1").where("h2 = _h2").select("rep", "id", "m"))
    from pyspark.sql.window import Window

    near = members.where("m > 1").withColumn("s", salt).withColumn("r", F.row_number().over(Window.partitionBy("rep", "s").orderBy("id"))).where(F.col("r") <= keep)
    least = near.groupBy("rep").agg(few(F.collect_list("id")).alias("ids"))
    full = classes.join(least, "rep", "left").select("rep", "vec", "m", "x", F.coalesce("ids", F.array("rep")).alias("ids"))
    return cut(full), members.select("rep", "id")


def dot(vec: str, other: Column | list[float], dim: int) -> Column:
    """Inner product written out per component, so that it stays in generated code."""
    total = None
    for i in range(dim):
        o = F.lit(float(other[i])) if isinstance(other, list) else F.get(other, F.lit(i))
        term = F.get(F.col(vec), F.lit(i)) * o
        total = term if total is None else total + term
    return total


def similarity(d2: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.sqrt(d2))


def radius_of(min_sim: float) -> float:
    """The distance at which 1 / (1 + distance) falls to ``min_sim``."""
    return math.inf if min_sim <= 0 else 1.0 / min_sim - 1.0


def stack(column) -> np.ndarray:
    """A pandas or Arrow column of equal-length lists as a matrix."""
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))
