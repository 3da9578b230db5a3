"""Queries of the general problems: heavy keys (p2), orphan references (p4), differences of two copies (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.diff import field_differences, residues
from kinweave.operators.eager import eager_profile, heavy_groups
from kinweave.operators.orphans import orphan_references, with_period
from kinweave.plans.registry import Registry
from kinweave.session import cut
from kinweave.sources.tables import table

R = Registry()

# --- p2: a few partitions own most rows ------------------------------------------------------------------------

_PROFILE_SQL = """
WITH refs AS (
  SELECT 'vector_nodes' AS tab_name, src AS ref, sim FROM edges WHERE src IS NOT NULL
  UNION ALL SELECT 'text_nodes', dst, sim FROM search_results WHERE dst IS NOT NULL),
nodes AS (
  SELECT 'vector_nodes' AS tab_name, partition, id, removed_at FROM vector_nodes
  UNION ALL SELECT 'text_nodes', partition, id, removed_at FROM text_nodes),
plain AS (
  SELECT tab_name, partition, count(*) AS n_rows, count(DISTINCT id) AS n_ids,
         count(DISTINCT CASE WHEN removed_at IS NOT NULL THEN id END) AS n_removed
  FROM nodes GROUP BY 1, 2),
joined AS (
  SELECT n.tab_name, n.partition, count(*) AS n_refs, sum(r.sim) AS sum_sim
  FROM nodes n JOIN refs r ON n.tab_name = r.tab_name AND n.id = r.ref GROUP BY 1, 2)
SELECT p.tab_name, p.partition, p.n_rows, p.n_ids, p.n_removed, coalesce(j.n_refs, 0) AS n_refs, round(j.sum_sim, 4) AS sum_sim
FROM plain p LEFT JOIN joined j ON p.tab_name = j.tab_name AND p.partition IS NOT DISTINCT FROM j.partition
"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    one = lambda nodes, refs, key: eager_profile(table(spark, d, nodes), table(spark, d, refs), key, removed=F.col("removed_at").isNotNull()).withColumn("tab_name", F.lit(nodes))
    return one("vector_nodes", "edges", "src").unionByName(one("text_nodes", "search_results", "dst"))


@R.query("p2_partition_profile", _PROFILE_SQL)
def p2_partition_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, ids, removed ids and joined references per partition of either node table."""
    p = _profiles(spark, d)
    return p.select("tab_name", "partition", "n_rows", "n_ids", "n_removed", "n_refs", F.round("sum_sim", 4).alias("sum_sim"))


@R.query(
    "p2_found",
    """
WITH n AS (
  SELECT 'vector_nodes' AS tab_name, partition FROM vector_nodes
  UNION ALL SELECT 'text_nodes', partition FROM text_nodes),
c AS (SELECT tab_name, partition, count(*) AS k FROM n GROUP BY 1, 2)
SELECT tab_name, partition FROM (SELECT *, sum(k) OVER (PARTITION BY tab_name) AS total FROM c) WHERE k >= 0.05 * total
""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Partitions with at least 5 % of all rows of their table, read off the written profile (a few rows per partition)."""
    return heavy_groups(cut(_profiles(spark, d)), share=0.05, by=["tab_name"]).select("tab_name", "partition")


# --- p4: references that resolve nowhere -------------------------------------------------------------------------

_ORPHANS_SQL = """
WITH refs AS (
  SELECT DISTINCT 'edges' AS tab_name, src AS ref_from, dst, written_at AS ts FROM edges
  UNION ALL SELECT DISTINCT 'search_results', query_id, dst, searched_at FROM search_results),
nodes AS (
  SELECT DISTINCT 'edges' AS tab_name, id, added_at, removed_at FROM vector_nodes
  UNION ALL SELECT DISTINCT 'search_results', id, added_at, removed_at FROM text_nodes),
f AS (
  SELECT r.*, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.removed_at <= r.ts THEN 'removed'
                   WHEN n.added_at > r.ts THEN 'early' END AS kind
  FROM refs r LEFT JOIN nodes n ON r.tab_name = n.tab_name AND r.dst = n.id)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    e, s = table(spark, d, "edges"), table(spark, d, "search_results")
    a = orphan_references(e.select(F.col("src").alias("ref_from"), "dst", F.col("written_at").alias("at")), table(spark, d, "vector_nodes"))
    b = orphan_references(s.select(F.col("query_id").alias("ref_from"), "dst", F.col("searched_at").alias("at")), table(spark, d, "text_nodes"))
    return with_period(a.withColumn("tab_name", F.lit("edges")).unionByName(b.withColumn("tab_name", F.lit("search_results"))))


@R.query("p4_found", _ORPHANS_SQL + "SELECT DISTINCT tab_name, ref_from, dst, strftime(ts, '%Y-%m') AS period, kind FROM f WHERE kind IS NOT NULL")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of edges and search results, with month and kind."""
    return _orphans(spark, d).select("tab_name", "ref_from", "dst", "period", "kind").distinct()


@R.query(
    "p4_orphan_counts",
    _ORPHANS_SQL + "SELECT tab_name, strftime(ts, '%Y-%m') AS period, kind, count(*) AS n_refs, count(DISTINCT dst) AS n_targets FROM f WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
)
def p4_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and kind."""
    per_target = _orphans(spark, d).groupBy("tab_name", "period", "kind", "dst").agg(F.count("*").alias("n"))
    return per_target.groupBy("tab_name", "period", "kind").agg(F.sum("n").alias("n_refs"), F.count("dst").alias("n_targets"))


# --- p7: two copies of the neighbour lists ---------------------------------------------------------------------------

_DIFF_SQL = """
WITH a AS (SELECT DISTINCT * FROM edges), b AS (SELECT DISTINCT * FROM edges_copy),
j AS (
  SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, a.src IS NULL AS no_a, b.src IS NULL AS no_b,
         a.sim AS s1, b.sim AS s2, a.rank AS r1, b.rank AS r2, a.written_at AS w1, b.written_at AS w2
  FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst),
f AS (
  SELECT src, dst, 'not_in_copy' AS difference FROM j WHERE no_b
  UNION ALL SELECT src, dst, 'only_in_copy' FROM j WHERE no_a
  UNION ALL SELECT src, dst, 'sim' FROM j WHERE NOT no_a AND NOT no_b AND (abs(s1 - s2) > 1e-9 OR (s1 IS NULL) <> (s2 IS NULL))
  UNION ALL SELECT src, dst, 'rank' FROM j WHERE NOT no_a AND NOT no_b AND r1 IS DISTINCT FROM r2
  UNION ALL SELECT src, dst, 'written_at' FROM j WHERE NOT no_a AND NOT no_b AND w1 IS DISTINCT FROM w2)
"""


def _differences(spark: SparkSession, d: str) -> DataFrame:
    return field_differences(table(spark, d, "edges"), table(spark, d, "edges_copy"), ["src", "dst"], {"sim": 1e-9, "rank": None, "written_at": None})


@R.query("p7_found", _DIFF_SQL + "SELECT DISTINCT src, dst, difference FROM f")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows missing on either side and fields that differ between edges and edges_copy."""
    return _differences(spark, d)


@R.query("p7_difference_counts", _DIFF_SQL + "SELECT difference, count(*) AS n_pairs, count(DISTINCT src) AS n_src FROM (SELECT DISTINCT * FROM f) GROUP BY 1")
def p7_difference_counts(spark: SparkSession, d: str) -> DataFrame:
    """Differences per kind."""
    per_src = _differences(spark, d).groupBy("difference", "src").agg(F.count("*").alias("n"))
    return per_src.groupBy("difference").agg(F.sum("n").alias("n_pairs"), F.count("src").alias("n_src"))


@R.query(
    "p7_surplus_rows",
    "SELECT 'edges' AS tab_name, *, count(*) AS surplus FROM (SELECT src, dst, sim, rank, written_at FROM edges EXCEPT ALL SELECT src, dst, sim, rank, written_at FROM edges_copy) GROUP BY ALL "
    "UNION ALL SELECT 'edges_copy', *, count(*) FROM (SELECT src, dst, sim, rank, written_at FROM edges_copy EXCEPT ALL SELECT src, dst, sim, rank, written_at FROM edges) GROUP BY ALL",
)
def p7_surplus_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that one of the two tables holds more often, repeats counted, and how many more."""
    r = residues(table(spark, d, "edges"), table(spark, d, "edges_copy"), ["src", "dst", "sim", "rank", "written_at"], repeats=True)
    return r.select(F.when(F.col("side") > 0, "edges").otherwise("edges_copy").alias("tab_name"), "src", "dst", "sim", "rank", "written_at", "surplus")
