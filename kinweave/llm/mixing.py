"""Mixing sources to target shares along a time-varying curriculum (problem 9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.session import cut


def plain_source(c: str) -> Column:
    """The plain spelling of a source: lower case, trimmed, words joined by underscores; null where empty."""
    s = F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s\-_]+", "_")
    return F.when(s != "", s)


@dataclass(frozen=True)
class Target:
    share: float
    max_repeats: int
    #: weight relative to ``share`` at evenly spaced times from start to end, linear in between, with mean 1
    weights: tuple[float, ...] = (1.0, 1.0)


def tilted(targets: Mapping[str, tuple[float, int]], strength: float = 0.5) -> dict[str, Target]:
    """A default curriculum: sources that are scarce (may be repeated more) gain weight over time, the others lose it.

    The weights of all sources sum to 1 at every time, and each source's mean weight is its share.
    """
    total = sum(s for s, _ in targets.values()) or 1.0
    mean = sum(s / total * r for s, r in targets.values())
    widest = max((abs(r - mean) for _, r in targets.values()), default=0.0) or 1.0
    return {k: Target(s / total, r, (1 - strength * (r - mean) / widest, 1 + strength * (r - mean) / widest)) for k, (s, r) in targets.items()}


def mix(docs: DataFrame, targets: Mapping[str, Target], total_tokens: float | None = None, seed: int = 7, rows_per_chunk: int = 20000) -> DataFrame:
    """Chosen documents in training order: (doc_id, source, repeat, tokens, position), position from 0 to 1.

    ``docs``: (doc_id, source in plain spelling, tokens). ``total_tokens``: size of the mix, by default the largest at which every source that has
    tokens can reach its share within its repeats. A source without tokens, without target or null contributes nothing.

    A source's weight schedule is integrated to its cumulative token demand over time. Its documents, in an order drawn by hash for each
    repeat, are laid end to end; the time at which demand reaches the middle of a document is its position. Documents whose middle lies beyond the
    demand at the end, or beyond the allowed repeats, are not used. Running token sums are taken over chunks of the hash order: sums per chunk are
    added up to offsets, so that a source with most of the documents never lies in one task. The result is range-sorted.
    """
    spark = docs.sparkSession
    d = docs.where("doc_id IS NOT NULL AND tokens > 0 AND source IS NOT NULL").select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens"))
    held = {r["source"]: (r["t"], r["n"]) for r in d.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).where(F.col("source").isin(*targets) if targets else F.lit(False)).collect()}
    live = {s: t for s, t in targets.items() if s in held and t.share > 0 and t.max_repeats > 0}
    schema = "doc_id bigint, source string, repeat int, tokens bigint, position double"
    if not live:
        return spark.createDataFrame([], schema)
    most = min(t.max_repeats * held[s][0] / t.share for s, t in live.items())
    total = most if total_tokens is None else float(total_tokens)
    plan, segments = [], []
    for s, t in live.items():
        tokens, rows = held[s]
        demand = min(total * t.share, float(t.max_repeats * tokens))
        passes = min(t.max_repeats, int(-(-demand // tokens)) or 1)
        plan.append((s, passes, max(1, -(-rows // rows_per_chunk)), tokens, demand))
        segments += [(s, *seg) for seg in _segments(t.weights, demand)]
    # a few rows per source
    p = F.broadcast(spark.createDataFrame(plan, "source string, passes int, chunks bigint, held bigint, demand double"))
    seg = F.broadcast(spark.createDataFrame(segments, "source string, t0 double, len double, w0 double, w1 double, c0 double, c1 double"))
    h = F.xxhash64("doc_id", "repeat", F.lit(seed))
    copies = d.join(p, "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("h", h)
    # the top 31 bits of the unsigned hash, cut into equal ranges: chunks follow the order of the hash
    top = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 33)
    copies = cut(copies.withColumn("chunk", F.shiftright(top * F.col("chunks"), 31)).select("doc_id", "source", "repeat", "tokens", "h", "chunk", "demand"))
    sums = copies.groupBy("source", "repeat", "chunk").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("repeat", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "repeat", "chunk", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "repeat", "chunk").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = copies.withColumn("upto", F.sum("tokens").over(inside)).join(offsets, ["source", "repeat", "chunk"])
    middle = F.col("offset") + F.col("upto") - F.col("tokens") / 2
    used = run.withColumn("c", middle).where(F.col("c") <= F.col("demand")).drop("demand")
    j = used.join(seg, "source").where((F.col("c") > F.col("c0")) & (F.col("c") <= F.col("c1")))
    # w0 u + (w1 - w0) u^2 / 2 = (c - c0) / len, solved for u without cancellation
    x = (F.col("c") - F.col("c0")) / F.col("len")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * (F.col("w1") - F.col("w0")) * x))
    at = F.least(F.lit(1.0), F.col("t0") + F.col("len") * 2 * x / (F.col("w0") + root))
    return j.select("doc_id", "source", "repeat", "tokens", at.alias("position")).orderBy("position", "source", "doc_id", "repeat")


def _segments(weights: Sequence[float], demand: float) -> list[tuple[float, float, float, float, float, float]]:
    """(t0, length, w0, w1, cum0, cum1) of the linear pieces, scaled so that the integral is ``demand``."""
    n = len(weights) - 1
    area = sum((weights[i] + weights[i + 1]) / 2 / n for i in range(n))
    out, at = [], 0.0
    for i in range(n):
        w0, w1 = weights[i] * demand / area, weights[i + 1] * demand / area
        upto = demand * (1 + 1e-9) if i == n - 1 else at + (w0 + w1) / 2 / n
        out.append((i / n, 1 / n, w0, w1, at, upto))
        at = upto
    return out


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, uses, most_repeats) for every row of ``targets``; sources that gave nothing have 0."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("u"), F.sum("tokens").alias("t"))
    g = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("documents"), F.sum("u").alias("uses"), F.max("u").alias("most_repeats"))
    j = targets.select("source", "target_share").join(g, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy())  # one row per source
    return j.withColumn("actual_share", F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(F.lit(0.0)))
