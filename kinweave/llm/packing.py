"""Filling containers of fixed capacity: best fit planned on the histogram of lengths (problem 8)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import group_rank
from kinweave.session import cut

_KEY = 1 << 44  # ranks within one length stay below this


@dataclass
class Plan:
    """Slots of all lengths. Slot range k serves items of ``length[k]`` with ranks start[k] <= rank < start[k + 1]: item number j of the range goes to
    container base[k] + j // each[k], in which ``left[k]`` tokens stay free."""

    capacity: int
    key: np.ndarray
    base: np.ndarray
    each: np.ndarray
    left: np.ndarray
    containers: int
    space: int


def plan_best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing over counts: the same containers that placing item by item, longest first, each where least space remains, would give.

    Open containers with equal contents are one group with a count; a length with its count is laid into groups at once. Work and result
    depend on the number of different lengths (at most ``capacity``), not on the number of items.
    """
    groups: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # space left -> [(contents as linked pairs, count)]
    spaces: list[int] = []

    def put(space: int, contents: tuple, count: int) -> None:
        if count:
            if not groups[space]:
                insort(spaces, space)
            groups[space].append((contents, count))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        left = histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                contents, count = groups[space].pop()
                if not groups[space]:
                    spaces.pop(at)
            else:
                space, contents, count = capacity, (), left
            each = space // length
            full = min(count, left // each)
            put(space - each * length, ((length, each), contents), full)
            left -= full * each
            count -= full
            rest = min(left, each) if count and left else 0
            if rest:
                put(space - rest * length, ((length, rest), contents), 1)
                left -= rest
                count -= 1
            if contents:
                put(space, contents, count)
    rows: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    base = total = 0
    for space in sorted(groups):
        for contents, count in groups[space]:
            node = contents
            while node:
                (length, each), node = node
                rows.append((length, used[length], base, each, space))
                used[length] += count * each
            base += count
            total += space * count
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return Plan(capacity, a[:, 0] * _KEY + a[:, 1], a[:, 2], a[:, 3], a[:, 4], base, total)


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, length): a document over the capacity gives full pieces and a rest; any other is one piece. Without tokens: no piece."""
    n = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    e = docs.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return e.select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * F.lit(capacity)).cast("int").alias("length"))


def pack(docs: DataFrame, capacity: int, chunks: int = 64) -> tuple[DataFrame, Plan]:
    """Places documents (doc_id, tokens) into containers: (doc_id, piece, tokens, container, space_left), and the plan.

    Only a document over the capacity is split. The histogram of piece lengths (at most ``capacity`` rows) is planned on the driver;
    pieces take the planned slots by their rank within their length, numbered over chunks so that a length with a third
    of all documents occupies many tasks. Documents with null or no tokens get no container. Ties and repeated rows get slots of their own.
    """
    p = pieces(docs, capacity)
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, not by the documents

    @F.pandas_udf("container bigint, space_left int")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = shared.value
        key = length.to_numpy().astype(np.int64) * _KEY + (rank.to_numpy() - 1)
        k = np.searchsorted(s.key, key, side="right") - 1
        return pd.DataFrame({"container": s.base[k] + (key - s.key[k]) // s.each[k], "space_left": s.left[k].astype(np.int32)})

    ranked = group_rank(p, "length", ["doc_id", "piece"], chunks)
    return ranked.withColumn("s", slot("length", "rank")).select("doc_id", "piece", F.col("length").alias("tokens"), "s.container", "s.space_left"), plan


def pack_all(docs: DataFrame, limits: DataFrame) -> tuple[DataFrame, list[tuple[str, Plan]]]:
    """``pack`` for each row of the small table (limit_name, capacity_tokens); rows with a null or non-positive capacity are left out."""
    spark = docs.sparkSession
    sized = cut(docs)
    out: DataFrame | None = None
    plans = []
    for r in limits.where("capacity_tokens > 0").orderBy("limit_name").collect():
        rows, plan = pack(sized, r["capacity_tokens"])
        rows = rows.select(F.lit(r["limit_name"]).alias("limit_name"), "*")
        plans.append((r["limit_name"], plan))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "limit_name string, doc_id bigint, piece int, tokens int, container bigint, space_left int")
    return out, plans
