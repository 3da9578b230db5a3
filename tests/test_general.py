"""Heavy keys, orphan references and table differences on small fixtures with nulls, repeats, ties, skew and empty tables."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import skew
from kinweave.operators.components import connected_components
from kinweave.operators.diff import field_differences, residues
from kinweave.operators.eager import eager_profile, heavy_groups
from kinweave.operators.orphans import bloom_words, might_contain, orphan_references
from kinweave.operators.skew import group_rank, heavy_keys, salted_join
from kinweave.operators.tiles import tiled_self_join

NODE = "id bigint, partition int, removed_at timestamp_ntz, added_at timestamp_ntz, loaded_at timestamp_ntz"
T = [datetime(2025, m, 1) for m in range(1, 8)]


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE)


def test_profile_multiplies_repeats_and_keeps_nulls(spark):
    n = nodes(spark, [(1, 0, None, T[0], T[0]), (1, 0, None, T[0], T[1]), (2, None, T[2], T[0], T[0]), (None, 0, None, T[0], T[0])])
    refs = spark.createDataFrame([(1, 0.5, 9), (1, 0.25, 9), (2, 1.0, 9), (None, 1.0, 9), (7, 1.0, 9)], "src bigint, sim double, partition int")
    got = {r["partition"]: tuple(r)[1:] for r in eager_profile(n, refs, "src", removed=F.col("removed_at").isNotNull()).collect()}
    assert got == {0: (3, 1, 0, 4, 1.5), None: (1, 1, 1, 1, 1.0)}
    assert eager_profile(n.limit(0), refs, "src").count() == 0
    assert eager_profile(n, refs.limit(0), "src").agg(F.sum("n_refs")).first()[0] == 0


def test_heavy_groups_include_the_bound(spark):
    p = spark.createDataFrame([(0, 95), (1, 5)], "partition int, n_rows bigint")
    assert {r[0] for r in heavy_groups(p).collect()} == {0, 1}
    assert {r[0] for r in heavy_groups(p, share=0.0501).collect()} == {0}


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1500, 1).when(F.col("id") < 1600, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("k"), "id")
    right = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, salted_join(left, right, "k", how).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect())), how
    assert [r["key"] for r in heavy_keys(left, "k").where("key IS NOT NULL").collect()] == [1]
    assert salted_join(left.limit(0), right, "k").count() == 0


def test_group_rank_is_dense_in_hot_and_null_groups(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").when(F.col("id") < 1600, F.lit(None)).otherwise(F.col("id").cast("string")).alias("g"), "id")
    rows = group_rank(df, "g", ["id"], chunks=7).collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append(r["rank"])
    assert len(rows) == 2000 and all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_tiled_self_join_gives_every_pair_once(spark):
    df = spark.createDataFrame([(k, i, n) for k, n in (("a", 25), ("b", 3), ("c", 1)) for i in range(n)], "k string, i bigint, n bigint")
    got = sorted(map(tuple, tiled_self_join(df, "k", "n", "i", [], lambda a, b: F.lit(True), 4).collect()))
    assert got == sorted((i, j) for n in (25, 3) for i in range(n) for j in range(i + 1, n))


def test_bloom_filter_never_denies_a_key(spark, monkeypatch):
    keys = spark.range(5000).select((F.col("id") * 7).alias("id"))
    bloom = bloom_words(keys.unionByName(spark.createDataFrame([(None,)], "id bigint")), "id")
    assert 5000 / 8 <= bloom[1] <= 5000
    rows = spark.range(35000).select("id", (F.col("id") % 7 == 0).alias("in"))
    plain = sorted(map(tuple, might_contain(rows, "id", bloom, "m").collect()))
    assert all(m for _, known, m in plain if known) and sum(m for _, known, m in plain if not known) < 0.05 * 30000
    monkeypatch.setattr(skew, "checked_broadcast", lambda *a: None)  # as with a filter too large to broadcast
    assert sorted(map(tuple, might_contain(rows, "id", bloom, "m").collect())) == plain
    assert not any(r["m"] for r in might_contain(rows, "id", bloom_words(keys.limit(0), "id"), "m").collect())


def test_orphans(spark):
    n = nodes(spark, [(1, 0, None, T[1], T[0]), (1, 0, None, T[1], T[5]), (2, 0, T[3], T[0], T[0]), (3, 0, T[2], T[4], T[0]), (4, 0, None, None, None)])
    rows = [(9, 1, T[2]), (9, 1, T[2]), (9, 1, T[0]), (9, 2, T[3]), (9, 2, T[2]), (9, 3, T[3]), (9, 4, T[0]), (9, 5, T[0]), (9, None, T[0]), (9, 1, None)]
    refs = spark.createDataFrame([(*r, "x") for r in rows], "ref_from bigint, dst bigint, at timestamp_ntz, added_at string")
    got = {(r["dst"], r["at"], r["kind"]) for r in orphan_references(refs, n).collect()}
    assert got == {(1, T[0], "early"), (2, T[3], "removed"), (3, T[3], "removed"), (5, T[0], "missing"), (None, T[0], "missing")}
    assert {r["kind"] for r in orphan_references(refs, n.limit(0)).collect()} == {"missing"}
    assert orphan_references(refs.limit(0), n).count() == 0


EDGE = "src bigint, dst bigint, sim double, rank int"


def test_differences(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, 2, 0.5, 1), (1, 2, 0.5, 1), (1, 3, 0.25, 2), (1, 4, 0.0, 3), (2, 1, None, 1), (2, 3, nan, 2), (None, 1, 0.5, 1), (5, 5, 1.0, None)], EDGE)
    b = spark.createDataFrame([(1, 2, 0.5 + 1e-12, 1), (1, 3, 0.26, 1), (1, 4, -0.0, 3), (2, 1, 0.1, 1), (2, 3, nan, 2), (None, 1, 0.5, 1), (6, 6, 1.0, 1)], EDGE)
    got = {tuple(r) for r in field_differences(a, b, ["src", "dst"], {"sim": 1e-9, "rank": None}).collect()}
    assert got == {(1, 3, "sim"), (1, 3, "rank"), (2, 1, "sim"), (5, 5, "not_in_copy"), (6, 6, "only_in_copy")}
    assert residues(a, a, ["src", "dst", "sim", "rank"]).count() == 0
    assert residues(a, a.distinct(), ["src", "dst", "sim", "rank"], repeats=True).count() == 1
    two = spark.createDataFrame([(1, 2, 0.5, 1), (1, 2, 0.6, 1), (3, 3, 0.1, 1), (3, 3, 0.2, 1)], EDGE)
    one = spark.createDataFrame([(1, 2, 0.5, 1), (3, 3, 0.2, 1), (3, 3, 0.1, 1), (None, 4, 0.2, 1)], EDGE)
    assert {tuple(r) for r in field_differences(two, one, ["src", "dst"], {"sim": 1e-9, "rank": None}).collect()} == {(1, 2, "sim"), (None, 4, "only_in_copy")}
    assert {tuple(r) for r in field_differences(one, two, ["src", "dst"], {"sim": 1e-9, "rank": None}).collect()} == {(1, 2, "sim"), (None, 4, "not_in_copy")}
    assert field_differences(a.limit(0), b, ["src", "dst"], {"sim": 1e-9}).count() == b.select("src", "dst").distinct().count()


def test_except_all_keeps_surplus_counts(spark, duck):
    r = np.random.default_rng(4)
    a, b = (spark.createDataFrame([(int(x), None if y == 3 else float(y)) for x, y in r.integers(0, 4, (60, 2))], "x int, y double") for _ in range(2))
    got = sorted((str(t[:3]), t[3]) for t in map(tuple, residues(a, b, ["x", "y"], repeats=True).collect()))
    pa, pb = a.toPandas(), b.toPandas()  # noqa: F841 - read by name
    sql = "SELECT x, CASE WHEN isnan(y) THEN NULL ELSE y END AS y, {s} AS side, count(*) AS n FROM (SELECT * FROM {l} EXCEPT ALL SELECT * FROM {r}) GROUP BY ALL"
    want = duck.execute(sql.format(s=1, l="pa", r="pb")).fetchall() + duck.execute(sql.format(s=-1, l="pb", r="pa")).fetchall()
    assert got == sorted((str((x, y, s)), n) for x, y, s, n in want) and max(n for *_, n in want) > 1


def test_keys_with_many_rows_are_heavy_and_joined_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 4)
    df = spark.range(4000).select((F.col("id") % 500).alias("k"), "id")
    assert skew.heavy_keys(df, "k", rows=4).count() == 500 and skew.heavy_keys(df, "k", rows=4000).count() == 0
    assert skew.salted_join(df, spark.range(250).withColumnRenamed("id", "k"), "k", heavy=skew.heavy_keys(df, "k", rows=4)).count() == 2000


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*pairs, (None, 1), (5000, 5000)], "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in connected_components(df, spark.createDataFrame([(5000,), (1,), (None,)], "id bigint")).collect()}
    assert got[5000] == 5000 and got[1] == find(1)
    every = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert all(c == find(i) for i, c in every.items())
    assert connected_components(df.limit(0)).count() == 0
