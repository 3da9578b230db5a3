"""References to records that do not exist: Bloom filter first, exact join for what passes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import heavy_keys, salted_join, sized_join
from kinweave.session import cut, drop_cut

WORD_KEYS = 4  # keys per 64-bit word aimed at: 16 bits a key, about 1 % false positives
_BITS = 4


def _word(key: Column, words: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(11)), 8).bitwiseAND(F.lit(words - 1))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(23))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(_BITS)]
    m = bits[0]
    for b in bits[1:]:
        m = m.bitwiseOR(b)
    return m


def bloom_words(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A register-blocked Bloom filter over all values of ``key``: the table (_w, _m) of its words that are not empty, and the number of words.

    Built by an aggregation, bits combined before the shuffle. The number of words is a power of two and follows the number of keys, so the share
    of false positives is the same at every size.
    """
    n = keys.select(F.approx_count_distinct(key)).first()[0]
    words = 1
    while words * WORD_KEYS < n:
        words *= 2
    rows = keys.where(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("_w"), _mask(F.col(key)).alias("_m"))
    return cut(rows.groupBy("_w").agg(F.bit_or("_m").alias("_m"))), words


def might_contain(rows: DataFrame, key: str, bloom: tuple[DataFrame, int], name: str) -> DataFrame:
    """Adds ``name``: false proves that the key is not in the filter. The null key gives false.

    A filter of up to a million words (four million keys) is broadcast; a larger one lies partitioned by the hash of the keys, and
    rows are sent to the part that holds their word, those of words that are asked for very often spread over several tasks.
    """
    table, words = bloom
    j = sized_join(rows.withColumn("_w", F.coalesce(_word(F.col(key), words), F.lit(-1))), table, "_w", 16, "left")
    hit = F.col(key).isNotNull() & F.col("_m").isNotNull() & (F.col("_m").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key)))
    return j.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_w", "_m")


def node_states(nodes: DataFrame) -> DataFrame:
    """One row per id with the times of its latest delivery: (dst, added_at, removed_at)."""
    latest = F.max_by(F.struct("added_at", "removed_at"), F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.xxhash64("added_at", "removed_at")))
    return nodes.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("dst")).agg(latest.alias("s")).select("dst", "s.added_at", "s.removed_at")


def orphan_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose target does not exist at the time of the reference.

    ``refs``: (ref_from, dst, at); ``nodes``: (id, added_at, removed_at, loaded_at). Returns distinct
    (ref_from, dst, at, kind) with kind 'missing' (no node row has the id), 'removed' (removed_at <= at) or
    'early' (added_at > at); removal is named where both hold.

    Keys that the Bloom filter of the node ids rejects are orphans for certain and skip the join; only
    the rest is joined, spread out where one dst owns many references. A null dst refers to nothing and
    is reported as 'missing'; a null time satisfies neither comparison; a node without added_at exists from
    the start. Repeated references count once. Empty nodes make every reference 'missing'.
    """
    bloom = bloom_words(nodes, "id")
    marked = cut(might_contain(refs.select("ref_from", "dst", "at").distinct(), "dst", bloom, "_maybe"))
    drop_cut(bloom[0])
    sure = marked.where(~F.col("_maybe")).select("ref_from", "dst", "at", F.lit("missing").alias("kind"))
    maybe = marked.where("_maybe").drop("_maybe")
    joined = salted_join(maybe, node_states(nodes).withColumn("_known", F.lit(True)), "dst", "left", heavy=heavy_keys(maybe, "dst"))
    kind = F.when(F.col("_known").isNull(), "missing").when(F.col("removed_at") <= F.col("at"), "removed").when(F.col("added_at") > F.col("at"), "early")
    verified = joined.select("ref_from", "dst", "at", kind.alias("kind")).where(F.col("kind").isNotNull())
    return sure.unionByName(verified)


def with_period(orphans: DataFrame) -> DataFrame:
    """Adds the month of the reference, 'YYYY-MM' (null where the time is)."""
    return orphans.withColumn("period", F.date_format("at", "yyyy-MM"))
