"""Similarities, encoders, builders, search, maintenance and partitioners: brute force, recall floors, invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import encoders, similarity
from kinweave.operators import graph, topk
from kinweave.plans import builders, partition, search
from kinweave.plans.online import OnlineConfig, OnlineGraph
from kinweave.session import cut
from kinweave.sources import graph_io
from kinweave.streaming.maintain import Maintainer


@pytest.fixture(scope="module")
def mixture(spark):
    return cut(graph_io.gaussian_mixture(spark, 1200, 6, 13))


@pytest.fixture(scope="module")
def exact(mixture):
    return cut(builders.Brute(similarity.L2, 10, tile=500).build(mixture))


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(120)]
    base = [" ".join(rng.choice(words, 5)) for _ in range(60)]
    out = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(0, len(t)))] = str(rng.choice(list("abcxyz ")))
            out.append("".join(t))
    return cut(graph_io.in_memory(spark, out))


def recall(got, want):
    a, b = {(r["src"], r["dst"]) for r in got.collect()}, {(r["src"], r["dst"]) for r in want.collect()}
    return len(a & b) / len(b)


def pairs_of(df):
    return [tuple(r) for r in df.select("src", "dst", "sim", "rank").collect()]


def test_jaro_winkler_known_values():
    s = similarity.jaro_winkler().block(["MARTHA", "DIXON", "", None, "é"], ["MARHTA", "DICKSONX", "", "e"])
    assert round(s[0, 0], 6) == 0.961111 and round(s[1, 1], 6) == 0.813333 and s[2, 2] == 1 and np.isnan(s[3]).all() and s[4, 3] == 0


def test_jaro_winkler_in_bits_equals_that_by_places():
    """Exactly, for texts of any number of words, empty, null and repeated ones; and it takes a fraction of the time."""
    from time import thread_time

    rng = np.random.default_rng(5)
    size = [0, 1, 2, 3, 4, 63, 64, 65, 127, 128, 129, 192, 200, 256, 257, 300, *rng.integers(1, 260, 60)]
    texts = ["".join(rng.choice(list("abcdeé \U0001f600"), n)) for n in size]
    texts = [*texts, *(t[:3] + "x" + t[4:] for t in texts), None, "zzz", "a" * 600]
    for unit in ("char", "byte"):
        x, lx = similarity._codes(texts, unit)
        block = similarity.jaro_winkler(unit).block(texts, texts)
        for i, t in enumerate(texts):
            n = int(lx[i])
            row = similarity._jaro_winkler(np.broadcast_to(x[i, : n + 1], (len(texts), n + 1)), np.full(len(texts), n), x, lx)
            row = np.array([np.nan if t is None or u is None else v for u, v in zip(texts, row)])
            assert np.array_equal(row, block[i], equal_nan=True)
    long = ["".join(rng.choice(list("abcdefghijklmnop "), 110)) for _ in range(256)]
    s = similarity.jaro_winkler()
    began = thread_time()
    s.block(long, long)
    took = thread_time() - began
    began = thread_time()
    s.pairs(long * 16, long * 16)  # a sixteenth of the pairs, place by place
    assert took < 8 * (thread_time() - began)


def test_tiles_of_a_bucket_are_compared_once(spark):
    """A bucket in four tiles gives what one tile gives, from the comparisons that one tile makes."""
    seen = spark.sparkContext.accumulator(0)

    def block(a, b):
        seen.add(len(a) * len(b))
        return similarity.L2.block(a, b)

    nodes = spark.createDataFrame([(i, [float(i * i % 97)]) for i in range(200)], "id bigint, value array<double>")
    got = []
    for tile in (200, 50):
        seen.value = 0
        got.append(sorted(pairs_of(builders.BucketBuilder(lambda v: F.array(F.lit(0)), similarity.Similarity("counted", block), 5, tile=tile).build(nodes))))
        assert seen.value == 200 * 200
    assert got[0] == got[1]


def test_dtw_and_grams():
    m = similarity.DTW.block([[1.0, 2.0, 3.0], [], [float("nan")]], [[1.0, 1.0, 2.0, 3.0], [2.0]])
    assert m[0, 0] == 1 and m[0, 1] == 1 / 3 and np.isnan(m[1]).all() and np.isnan(m[2]).all()
    assert similarity.grams("abab", 2) == {"ab": 2, "ba": 1} and similarity.grams("a", 2) == {} and similarity.grams(None, 2) is None


def test_native_and_block_forms_agree(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(30)] + [(90, [0.0] * 4), (91, [1.0]), (92, None)]
    df = spark.createDataFrame(rows, "id bigint, value array<double>")
    for sim in (similarity.COSINE, similarity.L2):
        j = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.value").alias("x"), F.col("b.value").alias("y"))
        for r in j.withColumn("s", sim.column(F.col("x"), F.col("y"))).collect():
            want = sim.block([r["x"]], [r["y"]])[0, 0]
            assert (r["s"] is None or math.isnan(r["s"])) if math.isnan(want) else abs(r["s"] - want) < 1e-8


def test_mixing_partition_wraps_like_64_bit_arithmetic(spark):
    ids = [0, 1, 8191, 8192, 8193, 123456789, 2**40 + 7, 1_700_000_000_000_000, -5]
    got = {r["id"]: r["p"] for r in spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", encoders.mixing_partition(F.col("id"), 8).alias("p")).collect()}
    for i in ids:
        m = (i * encoders.MIXING_PRIME + 2**63) % 2**64 - 2**63
        assert got[i] == abs(m) % 8


def test_signatures(spark):
    df = spark.createDataFrame([("some text about a thing",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(encoders.ctph_signature(F.col("t"))).collect()]
    assert len(got[0]) == 3 and all(0 <= x < 10 for x in got[0]) and got[1] == [0, 0, 0] and got[2] is None
    q = encoders.superbit_planes(8, 8)
    assert np.allclose(q @ q.T, np.eye(8), atol=1e-9)


def test_top_k_rules(spark):
    e = spark.createDataFrame([(1, 2, 0.5, "a"), (1, 2, 0.9, "b"), (1, 3, 0.9, "c"), (1, 1, 1.0, "d"), (1, 4, float("nan"), "e"), (1, 5, None, "f"), (None, 1, 1.0, "g"), (2, 1, 0.1, "h")], "src bigint, dst bigint, sim double, rank string")
    assert sorted(pairs_of(topk.top_k(e, 2))) == [(1, 2, 0.9, 1), (1, 3, 0.9, 2), (2, 1, 0.1, 1)]
    assert topk.top_k(e.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(e, 0)
    a = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (2, 1, float("nan"))], "g bigint, i bigint, v double")
    assert [tuple(r) for r in topk.arg_max(a, "g", "i", "v").collect()] == [(1, 3, 0.5)]
    assert topk.sample_ids(a.select(F.col("i").alias("id")), 2, 1).count() == 2 and topk.sample_ids(a.select(F.col("i").alias("id")), 9, 1).count() == 3


def test_brute_against_numpy(mixture, exact):
    rows = mixture.orderBy("id").collect()
    x = np.array([r["value"] for r in rows])
    d = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(-1))
    s = np.round(1 / (1 + d), 9)
    s[np.arange(200), np.arange(200)] = -1
    want = {(i, int(j)) for i in range(200) for j in np.argsort(-s[i], kind="stable")[:10]}
    got = {(r["src"], r["dst"]) for r in exact.where("src < 200").collect()}
    assert got == want and exact.count() == 12000


def test_builders_on_odd_input(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0]), (6, [0.0, float("inf")])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, value array<double>, sim int")
    for b in (builders.Brute(similarity.COSINE, 3), builders.SuperBitLsh(2, k=3), builders.NNDescent(similarity.COSINE, 3, iterations=1)):
        got = {(r["src"], r["dst"]) for r in b.build(df).collect()}
        assert got <= {(1, 2), (2, 1)}, type(b)
        assert b.build(df.limit(0)).count() == 0
    assert {(r["src"], r["dst"]) for r in builders.Brute(similarity.COSINE, 3).build(df).collect()} == {(1, 2), (2, 1)}
    for bad in (lambda: builders.Brute(k=0), lambda: builders.NNDescent(iterations=0), lambda: builders.SuperBitLsh(0), lambda: builders.Ctph(stages=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        builders.Brute().build(df)


def test_user_similarity_of_structs(spark):
    df = spark.createDataFrame([(i, (i % 3, f"t{i}")) for i in range(9)], "id bigint, value struct<a: int, t: string>")
    s = similarity.from_scalar("same", lambda x, y: 1.0 if x["a"] == y["a"] else 0.0)
    got = builders.Brute(s, 2).build(df).where("sim = 1").collect()
    assert len(got) == 18 and all(r["src"] % 3 == r["dst"] % 3 for r in got)


def test_nn_descent_recall_on_texts(texts):
    sim = similarity.jaro_winkler()
    want = builders.Brute(sim, 10).build(texts)
    assert recall(builders.NNDescent(sim, 10, iterations=5).build(texts), want) >= 0.9


def test_nn_descent_joins_all_neighbours_of_a_hub(spark):
    # node 0 is in the lists of 1..60, and of these only 60 is new to it; tiles of 16 cut the centre
    g = spark.createDataFrame([(i, 0, 0.5, i == 60) for i in range(1, 61)], "src bigint, dst bigint, sim double, fresh boolean")
    got = [tuple(r) for r in builders.NNDescent(similarity.L2, 10, tile=16).around(g).collect()]
    assert sorted(got) == [(i, 60) for i in range(1, 60)]
    every = builders.NNDescent(similarity.L2, 10, tile=16).around(g.withColumn("fresh", F.lit(True))).collect()
    assert len(every) == 60 * 59 // 2


def test_nn_descent_finds_all_around_a_hub(spark):
    # every list of one neighbour names the node in the middle, or one that is nearer still and is met only through it
    rows = [(0, [0.0, 0.0])] + [(i, [math.cos(i // 2 * 0.07) * (1 + i % 2 * 1e-3), math.sin(i // 2 * 0.07) * (1 + i % 2 * 1e-3)]) for i in range(2, 82)]
    df = spark.createDataFrame(rows, "id bigint, value array<double>")
    e = [(i, 0, 0.5, True) for i in range(2, 82)]
    b = builders.NNDescent(similarity.L2, 1, tile=16)
    pairs = b.around(spark.createDataFrame(e, "src bigint, dst bigint, sim double, fresh boolean"))
    scored = builders.score_pairs(pairs, df, similarity.L2)
    ways = scored.unionByName(scored.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    assert {(r["src"], r["dst"]) for r in topk.top_k(ways, 1).collect()} == {(i, i ^ 1) for i in range(2, 82)}


def test_ctph_and_lsh_recall(texts, mixture, exact):
    sim = similarity.jaro_winkler()
    want = builders.Brute(sim, 5).build(texts)
    assert recall(builders.Ctph(sim, k=5).build(texts), want) >= 0.7
    assert recall(builders.SuperBitLsh(6, stages=5, buckets=4, similarity=similarity.L2, tile=200).build(mixture), exact) >= 0.7
    inner = builders.SuperBitLsh(6, stages=2, buckets=4, similarity=similarity.L2, inner="nndescent").build(mixture.where("id < 300"))
    assert inner.groupBy("src").count().where("count > 10").count() == 0


def test_graph_algebra(spark, exact):
    ids = spark.createDataFrame([(0,), (1,)], "id bigint")
    left = graph.drop_nodes(exact, ids)
    assert left.where("src IN (0, 1) OR dst IN (0, 1)").count() == 0
    hops = {r["id"]: r["hops"] for r in graph.k_hop(exact, ids, 2).collect()}
    near = {}
    for r in exact.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    one = near[0] | near[1]
    assert {i for i, h in hops.items() if h == 1} == one - {0, 1}
    assert {i for i, h in hops.items() if h <= 2} == {0, 1} | one | {y for x in one for y in near[x]}
    assert graph.common_edges(exact, exact).agg(F.sum("n_common")).first()[0] == exact.count()


def test_approximate_search_hits(spark, mixture, exact):
    q = graph_io.gaussian_mixture(spark, 60, 6, 13, seed=42).select((F.col("id") + 100000).alias("query_id"), F.transform("value", lambda x: x + 0.05).alias("value"))
    want = {(r["query_id"], r["dst"]) for r in search.exhaustive_search(mixture, q, 1, similarity.L2).collect()}
    nodes = mixture.withColumn("partition", encoders.mixing_partition(F.col("id"), 4))
    found, metrics = search.approximate_search(nodes, exact, q, similarity.L2, search.SearchConfig(k=1, speedup=4, restart_at_boundary=False))
    assert len(want & {(r["query_id"], r["dst"]) for r in found.collect()}) > 0.4 * len(want)
    assert metrics.where("similarities > 600").count() == 0
    rest, drawn = search.split_queries(mixture, 100, 3)
    assert drawn.count() == 100 and rest.count() == 1100
    with pytest.raises(ValueError):
        search.SearchConfig(speedup=0.5)


def test_search_goes_on_until_the_budget_is_spent(mixture, exact):
    nodes = mixture.withColumn("partition", encoders.mixing_partition(F.col("id"), 4))
    q = mixture.where("id % 40 = 0").select(F.col("id").alias("query_id"), "value")
    want = {(r["query_id"], r["dst"]) for r in search.exhaustive_search(mixture, q, 11, similarity.L2).where("query_id <> dst").collect()}
    for found, metrics in (
        search.approximate_search(nodes, graph.symmetrise(exact), q, similarity.L2, search.SearchConfig(10, 4, restart_at_boundary=False, keep_self=False)),
        search.naive_search(nodes, graph.symmetrise(exact), q, similarity.L2, 10, 4, keep_self=False),
    ):
        got = {(r["query_id"], r["dst"]) for r in found.collect()}
        assert len(got) == 300 and len(want & got) >= 0.9 * len(want)
        assert {r["similarities"] for r in metrics.collect()} == {300}


@pytest.mark.parametrize("inside", [False, True])
def test_walks_in_tasks_and_over_tables_agree(spark, mixture, exact, inside):
    """Values that cannot be compared, edges that lead nowhere, ids without a node and texts included; equal values tie."""
    from dataclasses import replace

    rows = [(5000 + i, v, i % 3) for i, v in enumerate(([1.0] * 6, [1.0] * 6, [float("nan")] * 6, [None] * 6, [1.0] * 6))]
    nodes = mixture.select("id", "value", F.when(F.col("id") % 5 > 0, encoders.mixing_partition(F.col("id"), 3)).alias("partition")).unionByName(spark.createDataFrame(rows, "id bigint, value array<double>, partition int"))
    edges = graph.symmetrise(exact.select("src", "dst").unionByName(spark.createDataFrame([(i, 5000 + i % 7) for i in range(0, 1200, 9)], "src bigint, dst bigint")))
    q = mixture.where("id % 100 = 0").select(F.col("id").alias("query_id"), "value").unionByName(spark.createDataFrame([(-1, None), (5002, [0.5] * 6), (-3, [1.0, 2.0])], "query_id bigint, value array<double>"))
    words = nodes.select("id", F.concat_ws(" ", F.transform("value", lambda x: F.round(x).cast("string"))).alias("value"), "partition")
    told = q.where("query_id > 0").select("query_id", F.concat_ws(" ", F.transform("value", lambda x: F.round(x).cast("string"))).alias("value"))
    for n, asked, sim in ((nodes, q, similarity.L2), (words, told, similarity.jaro_winkler())):
        c = search.SearchConfig(5, 6, restart_at_boundary=inside, keep_self=False)
        held, tables = ([sorted(map(tuple, x.collect())) for x in search.approximate_search(n, edges, asked, sim, replace(c, memory=m))] for m in (c.memory, 0))
        assert held == tables and len(held[1]) >= 12


def test_walks_held_in_tasks_take_few_jobs(spark, mixture, exact):
    """The number of jobs does not grow with the rounds."""
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("walks", "walks")
    q = mixture.where("id % 100 = 0").select(F.col("id").alias("query_id"), "value")
    search.naive_search(mixture, graph.symmetrise(exact), q, similarity.L2, 10, 2, keep_self=False)[0].collect()
    sc.setJobGroup("other", "other")
    assert len(tracker.getJobIdsForGroup("walks")) < 40


def test_walks_restart_beyond_a_border(spark):
    # a chain of which every two nodes are a partition, in which only the first partition has a start
    nodes = spark.createDataFrame([(i, [float(i)], i // 2) for i in range(6)], "id bigint, value array<double>, partition int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src bigint, dst bigint")
    q = spark.createDataFrame([(100, [5.0])], "query_id bigint, value array<double>")
    only = spark.createDataFrame([(0, 0)], "id bigint, partition int")
    from unittest.mock import patch

    with patch.object(search, "sample_ids", lambda *a, **k: only):
        confined = search.approximate_search(nodes, edges.where("floor(src / 2) = floor(dst / 2)"), q, similarity.L2, search.SearchConfig(1, 1, restart_at_boundary=True))[0]
        found, metrics = search.naive_search(nodes, edges, q, similarity.L2, 1, 1)
        assert confined.first()["dst"] == 1 and found.first()["dst"] == 5 and metrics.first()["similarities"] == 6


def test_online_add_and_remove(mixture, exact):
    base = mixture.where("id >= 60")
    g = OnlineGraph(base, cut(builders.Brute(similarity.L2, 10).build(base)), similarity.L2, 10, OnlineConfig(exhaustive=True))
    g.add(mixture.where("id < 60").select("id", "value").unionByName(mixture.where("id = 70").select("id", "value")))
    assert g.size() == 1200 and recall(g.edges, exact) > 0.95
    g.remove(mixture.where("id < 60").select("id"))
    want = builders.Brute(similarity.L2, 10).build(base)
    assert g.size() == 1140 and recall(g.edges, want) > 0.95
    assert g.edges.where("src < 60 OR dst < 60").count() == 0
    assert g.edges.groupBy("src").count().where("count <> 10").count() == 0


def test_partitioners(mixture, exact):
    n, k = 1200, 10
    e = partition.Edge1D(8).partition(mixture, exact)
    cross = graph.cross_edges(exact, graph.colors(e.nodes)).first()["n_cross"]
    assert abs(cross / (n * k * 7 / 8) - 1) < 0.05
    m = partition.KMedoids(similarity.L2, 8, imbalance=1.2, trials=16).partition(mixture, exact)
    assert graph.balance(m.nodes, 8).first()[0] <= 1.2 + 0.01 and m.nodes.count() == n and m.medoids.count() == 8
    assert graph.cross_edges(exact, graph.colors(m.nodes)).first()["n_cross"] < 0.8 * n * k * 7 / 8
    start = partition.JaBeJa(4, partition.IterationBudget(0)).partition(mixture, exact)
    j = partition.JaBeJa(4, partition.IterationBudget(4), temperature=1.0, sample=3)
    end = j.partition(mixture, exact)
    assert j.rounds == 4
    sizes = lambda x: sorted(map(tuple, graph.partition_sizes(x.nodes).collect()))
    assert sizes(start) == sizes(end)
    cut_edges = [graph.cross_edges(exact, graph.colors(x.nodes)).first()["n_cross"] for x in (start, end)]
    assert cut_edges[1] < cut_edges[0]
    assert partition.TimeBudget(0).exhausted(0) and not partition.Budget().exhausted(10**6)


def test_swaps_end_by_themselves(spark):
    # two cliques, no budget: rounds end when no swap is agreed, or no fewer than before
    rows = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(base, base + 6) if a != b]
    nodes = spark.createDataFrame([(i,) for base in (0, 10) for i in range(base, base + 6)], "id bigint")
    j = partition.JaBeJa(2, temperature=1.0, sample=2, patience=2)
    out = j.partition(nodes, spark.createDataFrame(rows, "src bigint, dst bigint")).nodes
    assert out.count() == 12 and j.rounds >= 1


def test_online_add_by_walks(spark):
    """2,000 nodes, 200 more found by walks from four medoids' partitions; ten neighbours each."""
    m = graph_io.gaussian_mixture(spark, 2200, 4, 5)
    m = cut(m.withColumn("partition", encoders.mixing_partition(F.col("id"), 4)))
    base, new = m.where("id < 2000"), m.where("id >= 2000").select("id", "value")
    medoids = base.where("id < 4").select(F.col("id").cast("int").alias("partition"), "id", "value")
    g = OnlineGraph(base, cut(builders.Brute(similarity.L2, 10).build(base)), similarity.L2, 10, OnlineConfig(speedup=4), medoids)
    g.add(new)
    want = builders.Brute(similarity.L2, 10).build(m)
    assert g.size() == 2200 and recall(g.edges, want) > 0.95 and recall(g.edges.where("src >= 2000"), want.where("src >= 2000")) > 0.9
    g.clean()


def test_prepared_graph_search(mixture, exact):
    s = search.GraphSearch(mixture, graph.symmetrise(exact), similarity.L2, partition.Edge1D(4))
    q = mixture.where("id % 60 = 0").select(F.col("id").alias("query_id"), "value")
    found, _ = s.search(q, search.SearchConfig(10, 4, restart_at_boundary=False))
    want = {(r["query_id"], r["dst"]) for r in s.exhaustive(q, 10).collect()}
    assert len(want & {(r["query_id"], r["dst"]) for r in found.collect()}) >= 0.9 * len(want)
    s.clean()
    with pytest.raises(Exception):
        s.nodes.count()


def test_sparse_signatures_in_large_spaces():
    a, b = encoders.hashed_planes(np.array([5, 10**9]), 40), encoders.hashed_planes(np.array([10**9]), 40)
    assert np.allclose(a[:, 1], b[:, 0]) and abs(encoders.hashed_planes(np.arange(20000), 4).mean()) < 0.02 and abs(encoders.hashed_planes(np.arange(20000), 4).std() - 1) < 0.02


def test_tiles_of_a_symmetric_similarity(spark, mixture, exact):
    small = builders.Brute(similarity.L2, 10, tile=150).build(mixture)
    assert recall(small, exact) == 1.0 and small.count() == exact.count()


def test_online_assignment_prefers_room(spark, mixture, exact):
    nodes = mixture.withColumn("partition", F.when(F.col("id") < 1000, 0).otherwise(1))
    medoids = spark.createDataFrame([(0, 1, [0.0] * 6), (1, 2, [0.0] * 6)], "partition int, id bigint, value array<double>")
    g = OnlineGraph(nodes, exact, similarity.L2, 10, OnlineConfig(imbalance=2.0), medoids)
    new = spark.createDataFrame([(9000, [0.0] * 6)], "id bigint, value array<double>")
    assert g.assign(new).first()["partition"] == 1


def test_sources_and_stream(spark, mixture, exact, tmp_path):
    (tmp_path / "lines.txt").write_text("1, 2.5,x\n\n3")
    lines = graph_io.read_lines(spark, str(tmp_path / "lines.txt"), 2)
    assert sorted(map(str, (r[0] for r in lines.select(graph_io.parse_numbers(F.col("value"))).collect()))) == sorted(["[1.0, 2.5, None]", "[None]", "[3.0]"])
    path = f"file://{tmp_path}/g"
    small = mixture.where("id < 300")
    graph_io.write_graph(small, builders.Brute(similarity.L2, 5).build(small), f"{path}/v=0", files=1)
    s = tmp_path / "in"
    mixture.where("id BETWEEN 300 AND 309").select("id", "value", F.lit("add").alias("op")).unionByName(small.where("id < 5").select("id", "value", F.lit("remove").alias("op"))).coalesce(1).write.parquet(str(s))
    stream = spark.readStream.schema("id bigint, value array<double>, op string").parquet(str(s))
    medoids = spark.createDataFrame([(3, 1, [0.0] * 6)], "partition int, id bigint, value array<double>")
    q = Maintainer(path, similarity.L2, 5, OnlineConfig(exhaustive=True), medoids).attach(stream, f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    n, e = graph_io.read_graph(spark, f"{path}/v=1")
    assert n.where("id >= 300 AND partition = 3").count() == 10
    assert n.count() == 305 and e.where("src < 5 OR dst < 5").count() == 0 and e.where("src = 300").count() == 5
    graph_io.append_metrics(n.limit(2).select("id"), f"{tmp_path}/m")
    graph_io.append_metrics(n.limit(2).select("id"), f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", sep="\t", header=True).count() == 4
