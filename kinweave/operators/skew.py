"""Joins, ranks and prefix sums that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.session import BROADCAST_BYTES, cores

#: A key is heavy from this share of the rows on,
HEAVY_SHARE = 0.01
#: or from this many rows on, whatever the share: about what one task should receive of one key.
HEAVY_ROWS = 500_000
#: At most this many keys are heavy (beside those by share), so that their list may be broadcast: of very many rows, HEAVY_ROWS is raised.
HEAVY_KEYS = 200_000


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys that own at least ``share`` of all rows or at least ``rows`` rows, with exact counts: (key, n).

    Counts are combined before the shuffle. At most ``1 / share`` + HEAVY_KEYS keys come out, so the result may
    be broadcast whatever the input's size. The null key is counted like any other.
    """
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    least = F.least(F.col("total") * F.lit(share), F.greatest(F.lit(float(rows)), F.col("total") / F.lit(HEAVY_KEYS)))
    return counts.join(F.broadcast(total), F.col("n") >= least).select("key", "n")


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None, spread_by: Sequence[str] | None = None, salts: int | None = None) -> DataFrame:
    """Equi-join on ``key`` in which the rows of a heavy left key are spread over several tasks.

    A heavy key gets at least ``salts`` salts (default: the cores), and more in proportion to its rows. ``right`` should be unique or nearly
    unique by ``key``, as its rows of heavy keys are repeated once per salt. ``how`` is inner, left, left_semi or left_anti; null keys match
    nothing, as in SQL. ``spread_by``: left columns that decide a row's salt (default: all others). ``heavy``: the result of ``heavy_keys``.
    """
    salts = salts or max(8, cores(left.sparkSession))
    h = heavy if heavy is not None else heavy_keys(left, key)
    h = F.broadcast(h.where(F.col("key").isNotNull()).select(F.col("key").alias("_hk"), F.greatest(F.lit(salts), F.ceil(F.col("n") / F.lit(HEAVY_ROWS)).cast("int")).alias("_hs")))
    cols = list(spread_by or [c for c in left.columns if c != key] or [key])
    marked = left.join(h, left[key] == F.col("_hk"), "left")
    # rows without a key match nothing: they are spread too, as they would all hash to one task
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.coalesce("_hs", F.lit(1 << 16))).cast("int")
    a = marked.withColumn("_salt", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), spread).otherwise(F.lit(0))).drop("_hk", "_hs")
    r = right.join(h, right[key] == F.col("_hk"), "left")
    b = r.withColumn("_salt", F.explode(F.when(F.col("_hk").isNotNull(), F.sequence(F.lit(0), F.col("_hs") - 1)).otherwise(F.array(F.lit(0))))).drop("_hk", "_hs")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` marked for broadcast if its counted size is under ``limit``, else None."""
    n = df.limit(limit // max(1, row_bytes) + 1).count()
    return F.broadcast(df) if n * row_bytes <= limit else None


def sized_join(left: DataFrame, right: DataFrame, key: str, row_bytes: int, how: str = "inner", spread_by: Sequence[str] | None = None) -> DataFrame:
    """Equi-join on ``key`` that broadcasts ``right`` (rows of ``row_bytes``) if its counted size allows, else a ``salted_join``. Count a written table, not a long plan."""
    few = checked_broadcast(right, row_bytes)
    return left.join(few, key, how) if few is not None else salted_join(left, right, key, how, spread_by=spread_by)


def chunk_of(columns: Sequence[str], chunks: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(chunks)).cast("int")


def group_rank(df: DataFrame, group: str, order: Sequence[str], chunks: int = 64, name: str = "rank") -> DataFrame:
    """Number the rows of each group 1..n without bringing a group into one task.

    Rows are cut into ``chunks`` per group by a hash of ``order``; counts per (group, chunk) are summed
    up to offsets, and each row's number is its chunk's offset plus its place in the chunk. The
    numbering is dense and deterministic (``order`` must be unique within the group), not sorted.
    A null group is a group.
    """
    d = df.withColumn("_chunk", chunk_of(order, chunks))
    sizes = d.groupBy(F.col(group).alias("_g"), F.col("_chunk").alias("_c")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = d.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*[F.col(c) for c in order])))
    j = local.join(offsets, local[group].eqNullSafe(F.col("_g")) & (local["_chunk"] == F.col("_c")))
    return j.withColumn(name, F.col("_r") + F.col("_off")).drop("_g", "_c", "_off", "_r", "_chunk")
