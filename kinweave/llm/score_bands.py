"""Top N items within every group by descending score bands (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators.skew import HEAVY_ROWS, heavy_keys
from kinweave.session import cores, cut

#: Shares of all rows in the bands, from the top; the last band takes the rest.
BAND_SHARES = (0.1, 0.2, 0.3)


def band_edges(rows: DataFrame, shares: tuple[float, ...] = BAND_SHARES) -> list[float]:
    """Descending lower bounds of all bands but the last, from the quantiles of all scores.

    The quantiles are approximate; they decide how much work a band holds, not what comes out.
    """
    upto, at = 0.0, []
    for s in shares:
        upto += s
        at.append(1 - upto)
    q = rows.agg(F.percentile_approx("score", F.array(*[F.lit(a) for a in at]), F.lit(1000))).first()[0] or []
    return sorted(set(q), reverse=True)


def top_items(df: DataFrame, k: int = 10, group: str = "src", item: str = "dst", score: str = "sim", low: float | None = None, high: float | None = None) -> DataFrame:
    """The k best distinct items of every group: (group, item, score, place).

    Each (group, item) counts with its highest score; places 1..k follow score descending, then item ascending. Rows whose
    group, item or score is null or NaN, whose item equals the group, or whose score lies outside [low, high] take no part.
    Groups with fewer than k items keep what they have; an empty table gives no rows; other columns are not read.

    The rows are written once, split into bands of the score's range, so that each is read by itself, and processed from the top. Of each band only the rows of groups that are not yet full are kept (anti-join),
    together with the items such a group already has; a group is full once it has k items, as every later score is lower.
    The band in which a group becomes full ranks its ties exactly. Rows of heavy groups are spread over salts, in proportion to their rows; equal items are
    combined and cut to k per group and salt before each shuffle, so that no task receives a large group.
    """
    g, i, s = F.col(group), F.col(item), F.col(score).cast("double")
    ok = g.isNotNull() & i.isNotNull() & (g != i) & s.isNotNull() & ~F.isnan(s)
    if low is not None:
        ok = ok & (s >= low)
    if high is not None:
        ok = ok & (s <= high)
    rows = df.where(ok).select(g.alias("g"), i.alias("i"), s.alias("score"))
    edges = band_edges(rows)
    number = F.lit(0)
    for e in edges:
        number = number + (F.col("score") < e).cast("int")
    rows = cut(rows.withColumn("band", number), partition_by="band")
    salts = max(8, cores(df.sparkSession))
    hot = cut(heavy_keys(rows, "g").select(F.col("key").alias("g"), F.greatest(F.lit(salts), F.ceil(F.col("n") / F.lit(HEAVY_ROWS)).cast("int")).alias("salts")))

    def salted(d: DataFrame) -> DataFrame:
        m = d.join(F.broadcast(hot), "g", "left")  # bounded by heavy_keys
        return m.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("i"), F.col("salts")).cast("int")).otherwise(F.lit(0))).drop("salts")

    full: DataFrame | None = None
    out: list[DataFrame] = []
    carry: DataFrame | None = None
    bounds = [*edges, None]
    for n, lo in enumerate(bounds):
        keyed = salted(rows.where(F.col("band") == n).select("g", "i", "score"))
        if full is not None:
            every = F.explode(F.when(F.col("salts").isNotNull(), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.lit(0))))
            done = full.join(F.broadcast(hot), "g", "left").select("g", every.alias("salt"))
            keyed = keyed.join(done, ["g", "salt"], "left_anti")
        if carry is not None:
            keyed = keyed.unionByName(salted(carry))
        order = [F.col("score").desc(), F.col("i").asc()]
        best = keyed.groupBy("g", "salt", "i").agg(F.max("score").alias("score"))
        near = best.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("r") <= k)
        ranked = near.select("g", "i", "score").withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("place") <= k)
        if lo is None:
            out.append(ranked)
            break
        state = cut(ranked.withColumn("full", F.count("*").over(Window.partitionBy("g")) == k))
        done_now = state.where("full")
        out.append(done_now.drop("full"))
        carry = state.where("NOT full").select("g", "i", "score")
        ids = done_now.where(F.col("place") == 1).select("g")
        full = ids if full is None else full.unionByName(ids)
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result.select(F.col("g").alias(group), F.col("i").alias(item), F.col("score").alias(score), F.col("place").cast("int").alias("place"))
