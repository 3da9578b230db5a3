"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bisect, knn, mixing, packing, pii, tokens
from kinweave.llm import chosen_path as cp
from kinweave.llm import score_bands as sb
from kinweave.plans.registry import Registry
from kinweave.session import cut
from kinweave.sources.tables import table

R = Registry()

P1 = cp.ChosenPath(threshold=0.6, min_words=5)


_PAIRS_SQL = r"""
WITH v AS (SELECT DISTINCT id, value FROM text_nodes WHERE id IS NOT NULL AND value IS NOT NULL),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(value), '[\p{L}\p{N}]+')) AS t FROM v),
n AS (SELECT id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM w a JOIN w b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 10 * o >= 6 * (x.n + y.n - o)
"""


@R.query("p1_found", _PAIRS_SQL)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids of text_nodes whose values share at least 60 % of their words."""
    return cp.near_duplicate_pairs(cp.latest_values(table(spark, d, "text_nodes")), P1)


_GROUPS_SQL = (
    "WITH RECURSIVE pairs AS (" + _PAIRS_SQL + r"""), e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
sets AS (SELECT id, list_sort(list(DISTINCT t)) AS l FROM (SELECT id, unnest(regexp_extract_all(lower(value), '[\p{L}\p{N}]+')) AS t FROM text_nodes WHERE id IS NOT NULL AND value IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT t) >= 5),
reach(id, root) AS (SELECT id, id FROM sets UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id),
g AS (SELECT id, min(root) AS group_id FROM reach GROUP BY 1), n AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY 1)
SELECT s.id, min(s.id) OVER (PARTITION BY l) AS class_id, group_id, coalesce(n_links, 0) AS n_links FROM sets s JOIN g ON g.id = s.id LEFT JOIN n ON n.id = s.id
"""
)


@R.query("p1_groups", _GROUPS_SQL)
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class, group and number of links of every text node with enough words."""
    return cp.near_duplicate_groups(cp.latest_values(table(spark, d, "text_nodes")), P1)


# --- p3 ---------------------------------------------------------------------------------------------------------

_TOP_SQL = """
SELECT src, dst, sim, CAST(place AS INTEGER) AS place FROM (
  SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS place
  FROM (SELECT src, dst, max(sim) AS sim FROM candidates WHERE src <> dst AND NOT isnan(sim) AND sim BETWEEN 0 AND 1 GROUP BY 1, 2))
WHERE place <= 10
"""


@R.query("p3_found", f"SELECT src, dst, place FROM ({_TOP_SQL})")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten best neighbours of every src in candidates."""
    return sb.top_items(table(spark, d, "candidates"), 10, low=0.0, high=1.0).select("src", "dst", "place")


@R.query("p3_lists", _TOP_SQL)
def p3_lists(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, with the similarity."""
    return sb.top_items(table(spark, d, "candidates"), 10, low=0.0, high=1.0)


# --- p5, p6 -----------------------------------------------------------------------------------------------------

P5 = knn.Knn(dim=24, k=10, min_sim=0.25)
P6 = bisect.Bisecting(dim=24, min_sim=0.25)


_USABLE = "WITH u AS (SELECT DISTINCT id, value AS v FROM vector_nodes WHERE id IS NOT NULL AND len(value) = 24 AND len(list_filter(value, lambda x: x IS NOT NULL AND isfinite(x))) = 24), "
_NEAREST_SQL = (
    _USABLE + "s AS (SELECT a.id AS src, b.id AS dst, 1 / (1 + list_distance(a.v, b.v)) AS sim FROM u a JOIN u b ON a.id <> b.id) "
    "SELECT src, dst, round(sim, 6) AS sim, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS place FROM s WHERE sim >= 0.25) WHERE place <= 10"
)
_CLUSTER_SQL = (
    _USABLE + "e AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON 1 / (1 + list_distance(a.v, b.v)) >= 0.25), "
    "nb AS (SELECT x, count(*) AS n, min(y) AS m, list(y ORDER BY y) AS l FROM e GROUP BY 1), c AS (SELECT l, count(*) AS k FROM nb GROUP BY 1) "
    "SELECT m AS cluster_id, x AS id FROM nb JOIN c ON nb.l = c.l WHERE k = n AND n >= 3"
)


@R.query("p5_found", f"SELECT src, dst FROM ({_NEAREST_SQL})")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The up to ten most similar other vectors of every usable vector."""
    return knn.nearest_vectors(table(spark, d, "vector_nodes"), P5).select("src", "dst")


@R.query("p5_neighbours", _NEAREST_SQL)
def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """As p5_found, with similarity and place."""
    return knn.nearest_vectors(table(spark, d, "vector_nodes"), P5).select("src", "dst", F.round("sim", 6).alias("sim"), "place")


@R.query("p6_found", _CLUSTER_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the sets of mutually similar vectors."""
    return bisect.similarity_clusters(table(spark, d, "vector_nodes"), P6)[0].select("cluster_id", "id")


_DESCRIBE_SQL = (
    f"WITH f AS ({_CLUSTER_SQL}), u AS (SELECT DISTINCT id, value AS v FROM vector_nodes WHERE len(value) = 24), "
    "p AS (SELECT cluster_id, id, i, v[i] AS x FROM f JOIN u USING (id), range(1, 25) r(i)), c AS (SELECT cluster_id, i, avg(x) AS x FROM p GROUP BY 1, 2), "
    "d AS (SELECT p.cluster_id, p.id, round(sqrt(sum((p.x - c.x) * (p.x - c.x))), 9) AS dist FROM p JOIN c ON p.cluster_id = c.cluster_id AND p.i = c.i GROUP BY 1, 2), "
    "n AS (SELECT cluster_id, count(DISTINCT coalesce(partition, -1)) AS n_partitions FROM f JOIN (SELECT DISTINCT id, partition FROM vector_nodes) USING (id) GROUP BY 1) "
    "SELECT cluster_id, count(*) AS n_members, any_value(n_partitions) AS n_partitions, (list(id ORDER BY dist, id))[:3] AS typical_ids, round(max(dist), 6) AS max_distance FROM d JOIN n USING (cluster_id) GROUP BY 1"
)


@R.query("p6_clusters", _DESCRIBE_SQL)
def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size, spread over partitions and most typical members of every cluster."""
    nodes = table(spark, d, "vector_nodes")
    members, _, classes = bisect.similarity_clusters(nodes, P6)
    return bisect.describe_clusters(members, classes, nodes, P6)


@R.query("p6_leaves")
def p6_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of the tree: distinct vectors, radius and, where it belongs to one, the cluster."""
    return bisect.similarity_clusters(table(spark, d, "vector_nodes"), P6)[1].select("leaf", "cluster_id", "n", F.round("radius", 6).alias("radius"))


# --- p8, p9 -----------------------------------------------------------------------------------------------------

_PACK_REPORT = "limit_name string, capacity_tokens int, containers bigint, space_left bigint, filled_share double"


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text")).drop("text")


@R.query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document (or piece of one) for each capacity of pack_limits, and the space it leaves."""
    return packing.pack_all(_sized(spark, d).select("doc_id", "tokens"), table(spark, d, "pack_limits"))[0]


@R.query("p8_space")
def p8_space(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and space left per capacity."""
    plans = packing.pack_all(_sized(spark, d).select("doc_id", "tokens"), table(spark, d, "pack_limits"))[1]
    rows = [(name, p.capacity, p.containers, p.space, round(1 - p.space / (p.containers * p.capacity), 6) if p.containers else 0.0) for name, p in plans]
    return spark.createDataFrame(rows, _PACK_REPORT)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets").collect()  # a row per source
    t = mixing.tilted({r["source"]: (r["target_share"], r["max_repeats"]) for r in targets})
    return mixing.mix(cut(_sized(spark, d).select("doc_id", mixing.plain_source("source").alias("source"), "tokens")), t)


@R.query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats, in training order."""
    return _mixed(spark, d)


@R.query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every source."""
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_targets"))


# --- p10 --------------------------------------------------------------------------------------------------------


@R.query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Names, e-mail addresses, phone numbers, street addresses and identity numbers in documents.text."""
    docs = table(spark, d, "documents")
    return pii.find(docs, pii.detector(docs, brands=pii.brand_words(table(spark, d, "items"))))


@R.query("p10_redacted")
def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """documents.text with every piece of personal data replaced by its placeholder."""
    docs = table(spark, d, "documents")
    det = pii.detector(docs, brands=pii.brand_words(table(spark, d, "items")))
    marks = {r["kind"]: r["placeholder"] for r in table(spark, d, "pii_kinds").collect()}  # five rows
    return pii.redact(docs, det, marks)
