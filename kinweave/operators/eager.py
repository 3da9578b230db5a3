"""Per-key results without imbalance: eager aggregation through joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_profile(nodes: DataFrame, refs: DataFrame, ref_key: str, group: str = "partition", removed: Column | None = None) -> DataFrame:
    """Counts per ``group`` over nodes and over nodes joined to the rows that refer to them.

    SELECT group, count(*) rows, count(distinct id) ids, removed ids, count of (node row, reference)
    pairs and the sum of their ``sim`` FROM nodes LEFT JOIN refs ON id = ref_key GROUP BY group,
    without ever joining rows to rows or shuffling by the skewed ``group``:

    1. both inputs are aggregated by the join key (combined before the shuffle): nodes to
       (id, group) -> rows, removed; refs to key -> count, sum;
    2. these compact states are joined by id, one row per (id, group);
    3. products give what the row join would have counted: pairs = rows * refs, sum = rows * sum;
    4. the states are rolled up to ``group``, combined before the shuffle, so a group with a third of
       all rows costs its final task one row per map task.

    A null id counts as a row and not as an id, and joins nothing; a null group is a group of its own.
    Empty inputs give no rows. Columns that the two inputs share do not clash: only those named are read.
    """
    removed = removed if removed is not None else F.lit(False)
    n = nodes.groupBy(F.col("id").alias("_id"), F.col(group).alias("_g")).agg(F.count("*").alias("_rows"), F.max(removed.cast("int")).alias("_gone"))
    r = refs.where(F.col(ref_key).isNotNull()).groupBy(F.col(ref_key).alias("_ref")).agg(F.count("*").alias("_refs"), F.sum("sim").alias("_sim"))
    j = n.join(r, F.col("_id") == F.col("_ref"), "left")
    return j.groupBy(F.col("_g").alias(group)).agg(
        F.sum("_rows").alias("n_rows"),
        F.count("_id").alias("n_ids"),
        F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.col("_gone"))), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.sum(F.col("_rows") * F.col("_refs")), F.lit(0)).cast("bigint").alias("n_refs"),
        F.sum(F.col("_rows") * F.col("_sim")).alias("sum_sim"),
    )


def heavy_groups(profile: DataFrame, group: str = "partition", share: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Groups that own at least ``share`` of all rows (per value of ``by``); the profile is already small."""
    w = [F.col(c) for c in by]
    totals = profile.groupBy(*w).agg(F.sum("n_rows").alias("_total"))
    j = profile.join(F.broadcast(totals), list(by)) if by else profile.join(F.broadcast(totals))
    # exact integer form of n / total >= share for shares given to four digits
    return j.where(F.col("n_rows") * 10000 >= F.col("_total") * F.lit(round(share * 10000))).select(*by, group, "n_rows")
