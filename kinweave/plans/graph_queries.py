"""Queries of the graph operators: builders, algebra, search, maintenance, partitioning and measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import encoders, quality, similarity
from kinweave.operators import graph, topk
from kinweave.operators.components import connected_components
from kinweave.plans import builders, partition, search
from kinweave.plans.online import OnlineConfig, OnlineGraph
from kinweave.plans.registry import Registry
from kinweave.session import cut
from kinweave.sources.graph_io import gaussian_mixture
from kinweave.sources.tables import table

R = Registry()
K = 10


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("value"))


def _items(spark: SparkSession, d: str, column: str = "item_name") -> DataFrame:
    return table(spark, d, "items").select(F.col("item_id").alias("id"), F.col(column).alias("value"))


def _search_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select(F.col("query_id").alias("id"), "value")


def _latest(rows: DataFrame) -> DataFrame:
    last = F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.xxhash64("value", "partition"))
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("value", "partition"), last).alias("s")).select("id", "s.value", "s.partition")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """One row per id that has a text: the one loaded last."""
    return _latest(table(spark, d, "text_nodes").where("value IS NOT NULL"))


def _usable(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of 24 finite components, one row per id: the one loaded last."""
    v = F.col("value")
    fine = (F.size(v) == 24) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return _latest(table(spark, d, "vector_nodes").where(v.isNotNull() & fine))


def _edges(spark: SparkSession, d: str, name: str = "edges") -> DataFrame:
    return table(spark, d, name)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.round("sim", 6).alias("sim"), F.col("rank").cast("int").alias("rank"))


def _rank_sql(pairs: str, k: int = K, src: str = "src") -> str:
    return (
        f"SELECT {src}, dst, round(s, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (SELECT {src}, dst, s, row_number() OVER (PARTITION BY {src} ORDER BY s DESC, dst) AS rank "
        f"FROM ({pairs})) WHERE rank <= {k}"
    )


# --- builders -----------------------------------------------------------------------------------------------------

_EMB = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@R.query("brute_cosine", _rank_sql(f"SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM {_EMB} a JOIN {_EMB} b ON a.id <> b.id"))
def brute_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.Brute(similarity.COSINE, K).build(_embeddings(spark, d)), "src", "dst")


@R.query("brute_l2", _rank_sql(f"SELECT a.id AS src, b.id AS dst, round(1 / (1 + list_distance(a.v, b.v)), 9) AS s FROM {_EMB} a JOIN {_EMB} b ON a.id <> b.id"))
def brute_l2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.Brute(similarity.L2, K).build(_embeddings(spark, d)), "src", "dst")


@R.query("brute_inverse_abs", _rank_sql("SELECT a.item_id AS src, b.item_id AS dst, round(1 / (1 + abs(a.price - b.price)), 9) AS s FROM items a JOIN items b ON a.item_id <> b.item_id WHERE a.price IS NOT NULL AND b.price IS NOT NULL"))
def brute_inverse_abs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.Brute(similarity.INVERSE_ABS, K).build(_items(spark, d, "price")), "src", "dst")


@R.query("brute_jaro_winkler", _rank_sql("SELECT a.item_id AS src, b.item_id AS dst, round(jaro_winkler_similarity(a.item_name, b.item_name), 9) AS s FROM items a JOIN items b ON a.item_id <> b.item_id"))
def brute_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.Brute(similarity.jaro_winkler("byte"), K).build(_items(spark, d)), "src", "dst")


def _gram_sql(tab: str, key: str, text: str, n: int) -> str:
    return f"SELECT {key} AS id, substr({text}, CAST(i AS BIGINT), {n}) AS g, count(*) AS n FROM (SELECT {key}, {text}, unnest(range(1, length({text}) - {n} + 2)) AS i FROM {tab} WHERE length({text}) >= {n}) GROUP BY 1, 2"


def _profile_cosine_sql(tab: str, key: str, text: str, n: int) -> str:
    return (
        f"WITH p AS ({_gram_sql(tab, key, text, n)}), l AS (SELECT id, sqrt(sum(n * n)) AS l FROM p GROUP BY 1), "
        "dots AS (SELECT a.id AS src, b.id AS dst, sum(a.n * b.n) AS d FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2) "
        + _rank_sql("SELECT x.id AS src, y.id AS dst, round(coalesce(d, 0) / (x.l * y.l), 9) AS s FROM l x JOIN l y ON x.id <> y.id LEFT JOIN dots ON dots.src = x.id AND dots.dst = y.id")
    )


@R.query("brute_cosine_2gram", _profile_cosine_sql("items", "item_id", "item_name", 2))
def brute_cosine_2gram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.Brute(similarity.cosine_of_grams(2), K).build(_items(spark, d)), "src", "dst")


@R.query("kshingle_profile", "SELECT id, g AS shingle, n FROM (" + _gram_sql("queries", "query_id", "value", 3) + ")")
def kshingle_profile(spark: SparkSession, d: str) -> DataFrame:
    return encoders.shingle_profile(table(spark, d, "queries"), "query_id", "value", 3)


@R.query("sparse_cosine", _profile_cosine_sql("queries", "query_id", "value", 3))
def sparse_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Brute force over 3-gram profiles kept as maps."""
    p = encoders.shingle_profile(table(spark, d, "queries"), "query_id", "value", 3)
    maps = p.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("shingle", "n"))).alias("value"))
    return _rounded(builders.Brute(similarity.SPARSE_COSINE, K).build(maps), "src", "dst")


@R.query("brute_sequence", _rank_sql("SELECT a.id AS src, b.id AS dst, round(1 / (1 + list_distance(a.v, b.v)), 9) AS s FROM n a JOIN n b ON a.id <> b.id").replace("SELECT src", "WITH n AS (SELECT id, list_transform(value, lambda x: x / sqrt(list_inner_product(value, value))) AS v FROM medoids) SELECT src", 1))
def brute_sequence(spark: SparkSession, d: str) -> DataFrame:
    """L2 of vectors scaled to unit length."""
    return _rounded(builders.Brute(similarity.SEQUENCE, K).build(table(spark, d, "medoids").select("id", similarity.normalised(F.col("value")).alias("value"))), "src", "dst")


_DTW_SQL = """
WITH RECURSIVE p AS (SELECT a.id AS src, b.id AS dst, a.value AS x, b.value AS y FROM medoids a JOIN medoids b ON a.id <> b.id),
w(src, dst, x, y, i, r) AS (
  SELECT src, dst, x, y, 0, list_concat([0.0::DOUBLE], list_transform(y, lambda v: 'inf'::DOUBLE)) FROM p
  UNION ALL
  SELECT src, dst, x, y, i + 1, list_reduce(list_concat([['inf'::DOUBLE]], list_transform(range(1, len(y) + 1), lambda j: [abs(x[i + 1] - y[j]), least(r[j], r[j + 1])])), lambda acc, c: list_append(acc, c[1] + least(c[2], acc[len(acc)])))
  FROM w WHERE i < len(x))
"""


@R.query("brute_dtw", _DTW_SQL + _rank_sql("SELECT src, dst, round(1 / (1 + r[len(r)]), 9) AS s FROM w WHERE i = len(x)", 5))
def brute_dtw(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.Brute(similarity.DTW, 5).build(table(spark, d, "medoids").select("id", "value")), "src", "dst")


_LSH = builders.SuperBitLsh(64, stages=3, buckets=10, k=K)


def _lsh_sql() -> str:
    per = len(_LSH.planes) // 3
    bit = lambda w, j: f"(CASE WHEN list_inner_product(v, [{', '.join(repr(float(x)) for x in w)}]::DOUBLE[]) >= 0 THEN {1 << j} ELSE 0 END)"
    codes = ", ".join("(" + " + ".join(bit(w, j) for j, w in enumerate(_LSH.planes[s * per : (s + 1) * per])) + ") % 10" for s in range(3))
    return (
        f"WITH e AS {_EMB}, b AS (SELECT DISTINCT id, unnest([{codes}]) AS bucket FROM e), p AS (SELECT DISTINCT x.id AS src, y.id AS dst FROM b x JOIN b y ON x.bucket = y.bucket AND x.id <> y.id) "
        + _rank_sql("SELECT src, dst, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM p JOIN e x ON x.id = src JOIN e y ON y.id = dst")
    )


@R.query("lsh_superbit", _lsh_sql())
def lsh_superbit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_LSH.build(_embeddings(spark, d)), "src", "dst")


@R.query("lsh_superbit_inner_nn_descent")
def lsh_superbit_inner(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.SuperBitLsh(64, stages=3, buckets=10, k=K, inner="nndescent").build(_embeddings(spark, d)), "src", "dst")


@R.query("lsh_superbit_sparse")
def lsh_superbit_sparse(spark: SparkSession, d: str) -> DataFrame:
    profile = cut(encoders.shingle_profile(table(spark, d, "queries"), "query_id", "value", 3))
    words = cut(encoders.shingle_dictionary(profile))
    v = encoders.sparse_vectors(profile, dictionary=words)
    return _rounded(builders.SuperBitLshSparse(max(1, words.count()), stages=4, buckets=8, k=K).build(v), "src", "dst")


def _sign(v: Column) -> Column:
    """A signature that SQL can give as well: the first and the second component in fifths."""
    return F.array(*[F.floor(F.get(v, F.lit(i)) * 5).cast("int") for i in (0, 1)])


def _bucket_sql(qualified: bool) -> str:
    code = "concat(1 - i, ':', CAST(floor(v[2 - i] * 5) AS INTEGER))" if qualified else "CAST(floor(v[2 - i] * 5) AS INTEGER)"
    return (
        f"WITH e AS {_EMB}, b AS (SELECT DISTINCT id, {code} AS bucket FROM e, range(0, 2) r(i)), p AS (SELECT DISTINCT x.id AS src, y.id AS dst FROM b x JOIN b y ON x.bucket = y.bucket AND x.id <> y.id) "
        + _rank_sql("SELECT src, dst, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM p JOIN e x ON x.id = src JOIN e y ON y.id = dst")
    )


@R.query("bucket_join_given_signature", _bucket_sql(False))
def bucket_join(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours among those that share a value of a given signature, whatever its place in it."""
    return _rounded(builders.BucketBuilder(_sign, similarity.COSINE, K, tile=256).build(_embeddings(spark, d)), "src", "dst")


@R.query("bucket_join_by_stage", _bucket_sql(True))
def bucket_join_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """The same with buckets kept apart by the place of the value."""
    return _rounded(builders.BucketBuilder(_sign, similarity.COSINE, K, stage_qualified=True, tile=256).build(_embeddings(spark, d)), "src", "dst")


@R.query("nnctph")
def nnctph(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.Ctph(similarity.jaro_winkler(), stages=3, buckets=10, k=K).build(_search_texts(spark, d)), "src", "dst")


@R.query("nn_descent")
def nn_descent(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(builders.NNDescent(similarity.COSINE, K, iterations=5).build(_embeddings(spark, d)), "src", "dst")


# --- algebra and measures --------------------------------------------------------------------------------------------


@R.query("symmetrise_edges", "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def symmetrise_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetrise(_edges(spark, d))


@R.query("merge_neighbor_lists", _rank_sql("SELECT src, dst, max(sim) AS s FROM (SELECT src, dst, sim FROM edges UNION ALL SELECT src, dst, sim FROM edges_copy) WHERE sim IS NOT NULL AND NOT isnan(sim) AND src <> dst GROUP BY 1, 2"))
def merge_neighbor_lists(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(topk.merge_lists([_edges(spark, d), _edges(spark, d, "edges_copy")], K), "src", "dst")


@R.query("union_graphs", "SELECT src, count(*) AS n_edges, CAST(sum(CAST(round(sim * 1000000) AS BIGINT)) AS BIGINT) AS sum_millionths FROM (SELECT src, dst, sim FROM edges UNION ALL SELECT src, dst, sim FROM edges_copy) GROUP BY 1")
def union_graphs(spark: SparkSession, d: str) -> DataFrame:
    return graph.union_graphs(_edges(spark, d), _edges(spark, d, "edges_copy")).groupBy("src").agg(F.count("*").alias("n_edges"), F.sum(F.round(F.col("sim") * 1000000).cast("bigint")).alias("sum_millionths"))


@R.query("common_edges", "SELECT a.src, count(*) AS n_common FROM (SELECT DISTINCT src, dst FROM edges) a JOIN (SELECT DISTINCT src, dst FROM edges_copy) b ON a.src = b.src AND a.dst = b.dst GROUP BY 1")
def common_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.common_edges(_edges(spark, d), _edges(spark, d, "edges_copy"))


@R.query("graph_size", "SELECT (SELECT count(DISTINCT id) FROM vector_nodes) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges)) AS n_edges")
def graph_size(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "vector_nodes").where("id IS NOT NULL").groupBy("id").agg(F.lit(1).alias("x")).select(F.lit(1).alias("n"), F.lit(0).alias("e"))
    e = _edges(spark, d).select("src", "dst").distinct().select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    return n.unionByName(e).agg(F.sum("n").cast("bigint").alias("n_nodes"), F.sum("e").cast("bigint").alias("n_edges"))


@R.query("total_similarity", "SELECT round(sum(sim), 4) AS total, count(*) AS n_edges FROM (SELECT DISTINCT src, dst, sim FROM edges)")
def total_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("src", "dst", "sim").distinct().agg(F.round(F.sum("sim"), 4).alias("total"), F.count("*").alias("n_edges"))


@R.query("in_neighbors", "SELECT DISTINCT dst, src FROM edges WHERE dst IN (SELECT id FROM medoids)")
def in_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_neighbours(_edges(spark, d), table(spark, d, "medoids"))


@R.query(
    "khop_neighbors",
    """WITH e AS (SELECT DISTINCT src, dst FROM edges), h0 AS (SELECT DISTINCT id FROM medoids), h1 AS (SELECT DISTINCT dst AS id FROM e JOIN h0 ON src = id), h2 AS (SELECT DISTINCT dst AS id FROM e JOIN h1 ON src = id)
    SELECT id, CAST(min(h) AS INTEGER) AS hops FROM (SELECT id, 0 AS h FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1""",
)
def khop_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(_edges(spark, d), table(spark, d, "medoids").select("id"), 2)


@R.query("unwrap_nodes", "SELECT q.value AS src_value, t.value AS dst_value, round(s.sim, 6) AS sim FROM (SELECT DISTINCT query_id, dst, sim FROM search_results) s JOIN queries q ON q.query_id = s.query_id JOIN (SELECT DISTINCT id, value FROM text_nodes) t ON t.id = s.dst")
def unwrap_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "search_results").select(F.col("query_id").alias("src"), "dst", "sim").distinct()
    both = _search_texts(spark, d).unionByName(table(spark, d, "text_nodes").select("id", "value").distinct())
    return graph.unwrap(e, both).withColumn("sim", F.round("sim", 6))


@R.query("best_overall", "SELECT dst, round(m, 6) AS sim FROM (SELECT dst, max(sim) AS m FROM candidates WHERE sim IS NOT NULL AND NOT isnan(sim) GROUP BY 1) ORDER BY m DESC, dst LIMIT 100")
def best_overall(spark: SparkSession, d: str) -> DataFrame:
    """The 100 nodes with the highest similarity of any candidate pair (a top-k report)."""
    return topk.best_overall(table(spark, d, "candidates"), 100).select("dst", F.round("sim", 6).alias("sim"))


@R.query("search_statistics", "SELECT stage, count(*) AS similarities, count(DISTINCT src) AS n_src FROM candidates GROUP BY 1")
def search_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Additive counters per stage."""
    per = table(spark, d, "candidates").groupBy("stage", "src").agg(F.count("*").alias("n"))
    return per.groupBy("stage").agg(F.sum("n").alias("similarities"), F.count("src").alias("n_src"))


@R.query("drop_removed_nodes", "WITH g AS (SELECT id FROM vector_nodes WHERE removed_at IS NOT NULL) SELECT DISTINCT src, dst, sim FROM edges WHERE src NOT IN (SELECT id FROM g WHERE id IS NOT NULL) AND dst NOT IN (SELECT id FROM g WHERE id IS NOT NULL)")
def drop_removed_nodes(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "vector_nodes").where("removed_at IS NOT NULL").select("id")
    return graph.drop_nodes(_edges(spark, d).select("src", "dst", "sim").distinct(), gone)


@R.query(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM search_results_edges UNION SELECT dst, src FROM search_results_edges),
    reach(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id)
    SELECT id, min(root) AS component FROM reach GROUP BY 1""".replace("search_results_edges", "(SELECT query_id AS src, dst FROM search_results)"),
)
def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected parts of the graph of queries and their results."""
    return connected_components(table(spark, d, "search_results"), src="query_id", dst="dst")


@R.query(
    "quality_metrics",
    """WITH c AS (SELECT partition, CAST(count(DISTINCT id) AS DOUBLE) AS n, CAST(count(DISTINCT CASE WHEN removed_at IS NOT NULL THEN id END) AS DOUBLE) AS r FROM vector_nodes GROUP BY 1),
    m AS (SELECT partition, n, r, n * 10 AS correct, n * 10 * r / (r + n) + r * 10 AS a_changed, 10 * r AS r_changed FROM c)
    SELECT partition, round(a_changed, 6) AS add_changed, round((n + r) * 10 - a_changed, 6) AS add_unchanged, round(CASE WHEN a_changed > 0 THEN (correct - ((n + r) * 10 - a_changed)) / a_changed END, 6) AS add_quality,
      round(CASE WHEN r_changed > 0 THEN (correct - (n * 10 - r_changed)) / r_changed END, 6) AS remove_quality, round(n * (n - 1) / 2, 6) AS naive_add FROM m""",
)
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The quality formulas per partition, with the partition's ids as nodes and its removed ids as changes."""
    per = table(spark, d, "vector_nodes").groupBy("partition", "id").agg(F.max(F.col("removed_at").isNotNull().cast("int")).alias("gone"))
    c = per.groupBy("partition").agg(F.count("id").cast("double").alias("n"), F.sum("gone").cast("double").alias("r"))
    n, r, k = F.col("n"), F.col("r"), F.lit(10)
    a, z = quality.add_quality(n, r, k, n * 10), quality.remove_quality(n, r, k, n * 10)
    return c.select(
        "partition", F.round(a["edges_changed"], 6).alias("add_changed"), F.round(a["edges_unchanged"], 6).alias("add_unchanged"),
        F.round(F.when(r > 0, F.try_divide(n * 10 - a["edges_unchanged"], a["edges_changed"])), 6).alias("add_quality"), F.round(F.when(r > 0, F.try_divide(n * 10 - z["edges_unchanged"], z["edges_changed"])), 6).alias("remove_quality"), F.round(quality.naive_add_cost(n), 6).alias("naive_add"),
    )


@R.query(
    "maintenance_costs",
    """WITH c AS (SELECT partition, CAST(count(DISTINCT id) AS DOUBLE) AS n, CAST(count(DISTINCT CASE WHEN removed_at IS NOT NULL THEN id END) AS DOUBLE) AS r FROM vector_nodes GROUP BY 1)
    SELECT partition, round(10 * (n * (n + 1) / 2 - (n - r) * (n - r + 1) / 2), 6) AS naive_remove, round(CASE WHEN n > 0 THEN n * (n - 1) / 2 / (n * 10) END, 6) AS speed_up FROM c""",
)
def maintenance_costs(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons that naive removal of a partition's removed ids takes, and how a full rebuild compares with ten per node."""
    per = table(spark, d, "vector_nodes").where("id IS NOT NULL").groupBy("partition", "id").agg(F.max(F.col("removed_at").isNotNull().cast("int")).alias("gone"))
    c = per.groupBy("partition").agg(F.count("id").cast("double").alias("n"), F.sum("gone").cast("double").alias("r"))
    n, r = F.col("n"), F.col("r")
    return c.select("partition", F.round(quality.naive_remove_cost(n, n - r, F.lit(10)), 6).alias("naive_remove"), F.round(quality.speed_up(quality.naive_add_cost(n), n * 10), 6).alias("speed_up"))


@R.query("best_candidate", "SELECT src, dst, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM candidates WHERE src IS NOT NULL AND sim IS NOT NULL AND NOT isnan(sim)) WHERE r = 1")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Per src the dst of its highest similarity, the least of equal ones."""
    return topk.arg_max(table(spark, d, "candidates").where("src IS NOT NULL"), "src", "dst", "sim").select("src", "dst", F.round("sim", 6).alias("sim"))


@R.query("wrapped_values", "SELECT item_id AS id, item_name AS value, 0 AS partition FROM items")
def wrapped_values(spark: SparkSession, d: str) -> DataFrame:
    """Plain values as nodes of partition 0."""
    return graph.wrap_nodes(table(spark, d, "items"), "item_name", "item_id")


# --- search --------------------------------------------------------------------------------------------------------


@R.query("exhaustive_search", _rank_sql("SELECT query_id, t.id AS dst, round(jaro_winkler_similarity(q.value, t.value), 9) AS s FROM queries q, (SELECT DISTINCT id, value FROM text_nodes WHERE value IS NOT NULL) t", src="query_id"))
def exhaustive_search(spark: SparkSession, d: str) -> DataFrame:
    """All search texts against all text nodes."""
    return _rounded(search.exhaustive_search(_texts(spark, d), table(spark, d, "queries"), K, similarity.jaro_winkler("byte"), tile=1024), "query_id", "dst")


_USABLE = "(SELECT DISTINCT id, value AS v FROM vector_nodes WHERE len(value) = 24 AND len(list_filter(value, lambda x: x IS NOT NULL AND isfinite(x))) = 24)"


@R.query("exhaustive_search_vectors", _rank_sql(f"SELECT q.id AS query_id, t.id AS dst, round(1 / (1 + list_distance(q.value, t.v)), 9) AS s FROM medoids q, {_USABLE} t", src="query_id"))
def exhaustive_search_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.exhaustive_search(_usable(spark, d), table(spark, d, "medoids").select(F.col("id").alias("query_id"), "value"), K, similarity.L2), "query_id", "dst")


def _known_edges(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(_edges(spark, d), K)


def _search_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors whose id is divisible by 100, as queries."""
    return _usable(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "value")


@R.query("approximate_search")
def approximate_search(spark: SparkSession, d: str) -> DataFrame:
    """Graph walks from a hundredth of the vectors over the stored vector graph, both ways, themselves left out."""
    c = search.SearchConfig(k=K, speedup=4, restart_at_boundary=False, keep_self=False)
    return _rounded(search.approximate_search(_usable(spark, d), graph.symmetrise(_known_edges(spark, d)), _search_vectors(spark, d), similarity.L2, c)[0], "query_id", "dst")


@R.query("naive_search")
def naive_search(spark: SparkSession, d: str) -> DataFrame:
    """The same inside the stored partitions, restarted at their borders."""
    return _rounded(search.naive_search(_usable(spark, d), graph.symmetrise(_known_edges(spark, d)), _search_vectors(spark, d), similarity.L2, K, 4, keep_self=False)[0], "query_id", "dst")


# --- maintenance ------------------------------------------------------------------------------------------------------


@R.query("online_add")
def online_add(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings whose id is divisible by 100 are added to the exact graph of the others, their neighbours found by walks."""
    return _rounded(_added(spark, d, OnlineConfig(speedup=2)), "src", "dst")


def _added(spark: SparkSession, d: str, config: OnlineConfig) -> DataFrame:
    e = cut(_embeddings(spark, d).withColumn("partition", F.lit(0)))
    base = cut(builders.Brute(similarity.COSINE, K).build(e.where("id % 100 <> 0")))
    g = OnlineGraph(e.where("id % 100 <> 0"), base, similarity.COSINE, K, config)
    return g.add(e.where("id % 100 = 0")).edges


@R.query("online_add_exact", _rank_sql(f"SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM {_EMB} a JOIN {_EMB} b ON a.id <> b.id WHERE a.id % 100 = 0"))
def online_add_exact(spark: SparkSession, d: str) -> DataFrame:
    """The lists that the added nodes get when they are compared with all."""
    return _rounded(_added(spark, d, OnlineConfig(exhaustive=True)).where("src % 100 = 0"), "src", "dst")


_REMOVE_SQL = (
    "WITH u AS " + _USABLE + ", g AS (SELECT DISTINCT id FROM vector_nodes WHERE removed_at IS NOT NULL AND id IS NOT NULL), "
    "b AS (SELECT src, dst, max(sim) AS sim FROM edges WHERE src <> dst AND sim IS NOT NULL AND NOT isnan(sim) GROUP BY 1, 2), e AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM b) WHERE r <= 10), "
    "hurt AS (SELECT src, dst FROM e WHERE dst IN (SELECT id FROM g) AND src NOT IN (SELECT id FROM g)), st AS (SELECT dst AS x, src AS id FROM hurt UNION SELECT id, id FROM g), "
    "ar AS (SELECT x, id FROM st UNION SELECT x, dst FROM st JOIN e ON e.src = st.id), l AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)), "
    "p AS (SELECT DISTINCT h.src, a.id AS dst FROM hurt h JOIN ar a ON a.x = h.dst WHERE a.id <> h.src AND a.id NOT IN (SELECT id FROM g)), "
    "o AS (SELECT p.src, p.dst, round(1 / (1 + list_distance(a.v, b.v)), 9) AS sim FROM p ANTI JOIN l USING (src, dst) JOIN u a ON a.id = p.src JOIN u b ON b.id = p.dst) "
    + _rank_sql("SELECT src, dst, sim AS s FROM (SELECT * FROM l UNION ALL SELECT * FROM o)")
)


@R.query("online_remove", _REMOVE_SQL)
def online_remove(spark: SparkSession, d: str) -> DataFrame:
    """Removed vector nodes are taken out of the stored graph, and the lists they were in are repaired."""
    gone = table(spark, d, "vector_nodes").where("removed_at IS NOT NULL").select("id")
    g = OnlineGraph(_usable(spark, d), _known_edges(spark, d), similarity.L2, K, OnlineConfig(update_depth=1))
    return _rounded(g.remove(gone).edges, "src", "dst")


# --- partitioning -----------------------------------------------------------------------------------------------------

_EDGE1D = "SELECT DISTINCT id, CAST(abs(CASE WHEN m >= 9223372036854775808::HUGEINT THEN m - 18446744073709551616::HUGEINT ELSE m END) % 8 AS INTEGER) AS partition FROM (SELECT id, (id::HUGEINT * 1125899906842597) % 18446744073709551616::HUGEINT AS m FROM vector_nodes WHERE id IS NOT NULL)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_nodes").where("id IS NOT NULL").select("id").distinct()


@R.query("edge1d_partition", _EDGE1D)
def edge1d_partition(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("id", encoders.mixing_partition(F.col("id"), 8).alias("partition"))


@R.query("partition_sizes", "SELECT partition, count(*) AS n_nodes FROM (SELECT DISTINCT id, partition FROM vector_nodes) GROUP BY 1")
def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.partition_sizes(table(spark, d, "vector_nodes").select("id", "partition").distinct())


@R.query("color_index", "SELECT id, min(partition) AS color FROM vector_nodes WHERE id IS NOT NULL GROUP BY 1")
def color_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.colors(table(spark, d, "vector_nodes"))


_COLORED = "WITH c AS (SELECT id, min(partition) AS color FROM vector_nodes WHERE id IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT src, dst FROM edges) "


@R.query("degrees_index", _COLORED + "SELECT src AS id, color, count(*) AS degree FROM e JOIN c ON c.id = dst GROUP BY 1, 2")
def degrees_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d), graph.colors(table(spark, d, "vector_nodes")))


@R.query("cross_edges", _COLORED + "SELECT CAST(coalesce(sum(CASE WHEN a.color IS DISTINCT FROM b.color THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_cross, count(*) AS n_edges FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst")
def cross_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cross_edges(_edges(spark, d), graph.colors(table(spark, d, "vector_nodes")))


@R.query("partition_balance", f"WITH p AS (SELECT partition, count(*) AS n FROM ({_EDGE1D}) GROUP BY 1) SELECT round(max(n) / sum(n) * 8, 9) AS balance FROM p")
def partition_balance(spark: SparkSession, d: str) -> DataFrame:
    return graph.balance(edge1d_partition(spark, d), 8).select(F.round("balance", 9).alias("balance"))


@R.query(
    "kmedoids_assign",
    f"SELECT id, partition FROM (SELECT t.id, m.partition, row_number() OVER (PARTITION BY t.id ORDER BY round(1 / (1 + list_distance(m.value, t.v)), 9) DESC, m.partition) AS r FROM {_USABLE} t, medoids m) WHERE r = 1",
)
def kmedoids_assign(spark: SparkSession, d: str) -> DataFrame:
    """Every usable vector to the most similar of the given medoids."""
    return partition.KMedoids(similarity.L2, 32).assign(_usable(spark, d), table(spark, d, "medoids")).select("id", "partition")


_CAPACITY_SQL = f"""
WITH RECURSIVE u AS {_USABLE}, s AS (SELECT t.id, list(round(1 / (1 + list_distance(m.value, t.v)), 15) ORDER BY m.partition) AS s FROM u t, medoids m GROUP BY 1),
n AS (SELECT id, s, row_number() OVER (ORDER BY id) AS i FROM s), k AS (SELECT ceil(1.25 * count(*) / 32) AS cap FROM n),
g(i, id, pick, size) AS (
  SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, list_transform(range(32), lambda x: 0::BIGINT)
  UNION ALL
  SELECT i, id, pick, list_transform(size, lambda x, j: x + (j = pick)::BIGINT) FROM (
    SELECT i, id, size, list_position(sc, list_max(sc)) AS pick FROM (
      SELECT n.i, n.id, g.size, list_transform(n.s, lambda x, j: CASE WHEN g.size[j] < k.cap THEN x * (1 - g.size[j] / k.cap) + 1e-12 * (k.cap - g.size[j]) ELSE -1e308 END) AS sc FROM g JOIN n ON n.i = g.i + 1, k)))
SELECT id, (SELECT list(partition ORDER BY partition) FROM medoids)[pick] AS partition FROM g WHERE i > 0
"""


@R.query(
    "discounted_similarity",
    f"""WITH u AS (SELECT DISTINCT t.id, t.value AS v, t.partition FROM vector_nodes t JOIN {_USABLE} x ON x.id = t.id), s AS (SELECT partition, count(DISTINCT id) AS n FROM u GROUP BY 1), k AS (SELECT 1.1 * count(DISTINCT id) / 32 AS cap FROM u)
    SELECT u.id, u.partition, round(round(1 / (1 + list_distance(m.value, u.v)), 9) * (1 - s.n / k.cap), 6) AS score FROM u JOIN medoids m ON m.partition = u.partition JOIN s ON s.partition = u.partition, k WHERE len(u.v) = 24""",
)
def discounted_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The similarity of every usable vector to the medoid of its stored partition, lowered by how full that partition is."""
    u = cut(_usable(spark, d))
    sizes = u.groupBy("partition").agg(F.count("*").alias("n"))
    total = u.agg((F.count("*") * 1.1 / 32).alias("cap"))
    m = table(spark, d, "medoids").select("partition", F.col("value").alias("m"))  # a row per partition
    j = u.join(F.broadcast(m), "partition").join(F.broadcast(sizes), "partition").join(F.broadcast(total))
    return j.select("id", "partition", F.round(encoders.discounted(similarity.L2.column(F.col("m"), F.col("value")), F.col("n"), F.col("cap")), 6).alias("score"))


@R.query("kmedoids_capacity", _CAPACITY_SQL)
def kmedoids_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Every usable vector to one of the given medoids, none of which takes more than 1.25 times the mean."""
    return partition.KMedoids(similarity.L2, 32, imbalance=1.25).assign(_usable(spark, d), table(spark, d, "medoids")).select("id", "partition")


@R.query("kmedoids")
def kmedoids(spark: SparkSession, d: str) -> DataFrame:
    """Eight partitions around medoids found in a thousand trials, none larger than 1.2 times the mean."""
    return partition.KMedoids(similarity.L2, 8, imbalance=1.2).partition(_usable(spark, d), _edges(spark, d)).nodes.select("id", "partition")


@R.query(
    "jabeja_scores",
    _COLORED
    + """, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT src AS id, color, count(*) AS d FROM s JOIN c ON c.id = dst GROUP BY 1, 2)
    SELECT x.src AS p, x.dst AS q, coalesce(pp.d, 0) * coalesce(pp.d, 0) + coalesce(qq.d, 0) * coalesce(qq.d, 0) AS old_score, coalesce(pq.d, 0) * coalesce(pq.d, 0) + coalesce(qp.d, 0) * coalesce(qp.d, 0) AS new_score
    FROM s x JOIN c a ON a.id = x.src JOIN c b ON b.id = x.dst LEFT JOIN d pp ON pp.id = x.src AND pp.color = a.color LEFT JOIN d qq ON qq.id = x.dst AND qq.color = b.color
    LEFT JOIN d pq ON pq.id = x.src AND pq.color = b.color LEFT JOIN d qp ON qp.id = x.dst AND qp.color = a.color WHERE a.color <> b.color AND x.src <> x.dst""",
)
def jabeja_scores(spark: SparkSession, d: str) -> DataFrame:
    """Swap scores of neighbours in different partitions of the stored graph."""
    c = partition.swap_candidates(_edges(spark, d), graph.colors(table(spark, d, "vector_nodes")), 0, 1)
    old, new = encoders.swap_scores(F.col("dpp"), F.col("dqq"), F.col("dpq"), F.col("dqp"))
    return c.select("p", "q", old.alias("old_score"), new.alias("new_score"))


_ROUND_SQL = (
    "WITH sc AS (" + R.sql["jabeja_scores"] + "), k AS (SELECT id, min(partition) AS color FROM vector_nodes WHERE id IS NOT NULL GROUP BY 1), "
    "r AS (SELECT p, q, new_score - old_score AS gain FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY new_score DESC, q) AS n FROM sc WHERE new_score > 0 AND new_score > old_score) WHERE n = 1), "
    "o AS (SELECT a, b, p, q, gain FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY gain DESC, p DESC) AS n FROM (SELECT *, least(p, q) AS a, greatest(p, q) AS b FROM r)) WHERE n = 1), "
    "t AS (SELECT a AS n, a, b, gain FROM o UNION ALL SELECT b, a, b, gain FROM o), z AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY gain DESC, a, b) AS i FROM t) WHERE i = 1 GROUP BY 1, 2 HAVING count(*) = 2) "
    "SELECT p AS src, q AS dst, x.color AS src_color, y.color AS dst_color FROM o JOIN z USING (a, b) JOIN k x ON x.id = p JOIN k y ON y.id = q"
)


@R.query("jabeja_round", _ROUND_SQL)
def jabeja_round(spark: SparkSession, d: str) -> DataFrame:
    """The swaps agreed in one round among neighbours, from the stored partitions and at temperature 1."""
    c = partition.swap_candidates(_edges(spark, d), graph.colors(table(spark, d, "vector_nodes")), 0, 1)
    return partition.match_swaps(cut(partition.swap_requests(c, 1.0))).select("src", "dst", "src_color", "dst_color")


@R.query("jabeja")
def jabeja(spark: SparkSession, d: str) -> DataFrame:
    """Eight partitions of equal size after twelve rounds of swaps that lower the cut (temperature 1)."""
    return partition.JaBeJa(8, partition.IterationBudget(12), temperature=1.0).partition(_ids(spark, d).withColumn("value", F.lit(None).cast("int")), _edges(spark, d)).nodes.select("id", "partition")


@R.query("gaussian_mixture")
def mixture(spark: SparkSession, d: str) -> DataFrame:
    """The generator, which reads no table."""
    return gaussian_mixture(spark, 1000, 10, 13)
