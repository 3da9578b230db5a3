"""Near-duplicate sets by a chosen-path similarity join (problem 1).

After T. Christiani, R. Pagh, J. Sivertsen, "Scalable and Robust Set Similarity Join", 2018: a set enters the sub-buckets
of those of its tokens whose random value, drawn anew for each bucket, is small; buckets that became small are joined
by brute force, larger ones are split again; independent runs are repeated until the recall reached is the one asked for.
All buckets of all runs of one level are split by one Spark job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components
from kinweave.operators.skew import salted_join
from kinweave.operators.tiles import tiled_self_join
from kinweave.session import BROADCAST_BYTES, cut, drop_cut

#: A word is a run of letters and digits of the lower-cased text.
WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class ChosenPath:
    """Parameters. ``threshold``: least Jaccard similarity; ``target``: chance of being found for a pair just at it, of the least favourable sizes;
    ``branching``: common words that such a pair is expected to follow per level; ``leaf``: rows up to which a bucket is joined by brute
    force; ``stuck``: a bucket whose split would leave this many times the pairs it has is joined as it is, in tiles of ``tile`` rows.

    With branching 1.3 and stuck 3 the trees end by themselves: even a bucket of all but equal sets has less than one sub-bucket
    of its own size, on average, that is split again."""

    threshold: float = 0.8
    min_words: int = 5
    target: float = 0.99
    branching: float = 1.3
    leaf: int = 100
    stuck: float = 3.0
    tile: int = 1024
    seed: int = 17

    @property
    def common(self) -> float:
        """A set of k words has at least ``common`` * k of them in common with any set at the threshold."""
        return 2 * self.threshold / (1 + self.threshold)


def survival(p: ChosenPath, depth: int) -> float:
    """Least probability that one run of ``depth`` levels brings a pair at the threshold into one leaf.

    The pair follows a common word if its value is under the smaller of both sets' bounds, as those of one bucket are
    drawn once for all sets. A word is followed once on a path, so that both sets lose it. Of all sizes of the two sets the worst is taken;
    with the larger of n words, the smaller one of k shares at least threshold / (1 + threshold) * (n + k). A pair with no common word left
    is found, as the smaller set is finished by then (see ``_runs``).
    """

    def found(n: int, s: int, level: int) -> float:
        if s <= level or level >= depth:
            return 1.0
        left = p.threshold * n - level
        pick = 1.0 if left <= p.branching else p.branching / left
        return 1 - (1 - pick * found(n, s, level + 1)) ** (s - level)

    worst = 1.0
    for n in [*range(max(1, p.min_words), 80), 200, 1000]:
        for k in {max(p.min_words, math.ceil(p.threshold * n - 1e-9)), n}:
            worst = min(worst, found(n, math.ceil(p.threshold / (1 + p.threshold) * (n + k) - 1e-9), 0))
    return worst


def words(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))


def word_classes(docs: DataFrame, p: ChosenPath) -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row per distinct word set, and the class of each id.

    ``docs``: (id, value), one row per id. classes: rep (least id), n (words), toks (sorted hashes of the words), lo and hi (bits of the words,
    for a quick bound), m (ids). Values that are null or have under ``min_words`` distinct words are in neither.
    """
    w = docs.where("id IS NOT NULL AND value IS NOT NULL").select("id", words("value").alias("w")).where(F.size("w") >= p.min_words)
    h = w.select("id", F.array_sort(F.transform("w", lambda x: F.xxhash64(x))).alias("toks"), F.array_sort("w").alias("w"))
    keyed = cut(h.select("id", F.xxhash64("w", F.lit(1)).alias("h1"), F.xxhash64("w", F.lit(2)).alias("h2"), "toks"))
    g = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.any_value("toks").alias("toks"))
    one = F.lit(1).cast("bigint")
    bits = lambda hi: F.aggregate("toks", F.lit(0).cast("bigint"), lambda a, t: F.when((t.bitwiseAND(64) != 0) == F.lit(hi), a.bitwiseOR(F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int")))).otherwise(a))
    classes = cut(g.select("h1", "h2", "rep", "m", F.size("toks").alias("n"), "toks", bits(False).alias("lo"), bits(True).alias("hi")))
    members = salted_join(keyed.select("h1", "h2", "id"), classes.select(F.col("h1"), F.col("h2").alias("_h2"), "rep"), "h1").where("h2 = _h2").select("rep", "id")
    return classes, members


def _may_reach(a, b, p: ChosenPath) -> Column:
    """Exact bounds: sizes, and bits that differ, of which there are at most as many as words in only one set."""
    t = p.threshold
    least, most, both = F.least(a("n"), b("n")), F.greatest(a("n"), b("n")), a("n") + b("n")
    differ = F.bit_count(a("lo").bitwiseXOR(b("lo"))) + F.bit_count(a("hi").bitwiseXOR(b("hi")))
    return (least >= most * F.lit(t - 1e-9)) & (differ <= both * F.lit((1 - t) / (1 + t) + 1e-9))


def candidate_pairs(classes: DataFrame, p: ChosenPath) -> DataFrame:
    """Distinct candidates (a, b), a < b, of the class representatives: the pairs of all buckets of all runs that pass the exact bounds.

    Every set enters every run with all its words. As many runs are made as the depth of their trees asks for; should the trees get
    deeper than expected, another round of runs follows.
    """
    miss, first, depth = 1.0, 0, 6
    scratch: list[DataFrame] = []
    pairs: list[DataFrame] = []
    while miss > 1 - p.target + 1e-12:
        n_runs = max(1, math.ceil(math.log((1 - p.target) / miss) / math.log(1 - survival(p, depth)) - 1e-9))
        got, reached = _runs(classes, range(first, first + n_runs), p, scratch)
        pairs += got
        first, depth = first + n_runs, max(depth, reached)
        miss = (1 - survival(p, depth)) ** first
    if not pairs:
        return cut(classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
    result = cut(reduce(DataFrame.unionByName, pairs).distinct())
    drop_cut(*scratch)
    return result


_CARRY = ["n", "lo", "hi"]
#: Rows of (path, size) up to which they are broadcast.
MOST_SIZES = BROADCAST_BYTES // 32


def _runs(classes: DataFrame, runs: range, p: ChosenPath, scratch: list[DataFrame]) -> tuple[list[DataFrame], int]:
    """Candidates of all given runs, and the number of levels they took.

    Three kinds of buckets are joined by brute force and not split further: those of at most ``leaf`` rows; those that
    splitting does not help, as the sum of the squared sizes of their sub-buckets is ``stuck`` times their own squared size or more (the sets in them
    are alike, and most of the pairs asked for); and, against the rest of their bucket, sets that are finished: sets that followed
    so many words that a pair at the threshold may have no common word left. So no depth has to be set: every level uses up a word of each path.
    """
    ints = F.transform("toks", lambda t: F.shiftright(t, 32).cast("int"))
    roots = F.transform(F.sequence(F.lit(runs[0]), F.lit(runs[-1])), lambda r: F.xxhash64(r, F.lit(p.seed)))
    big = classes.select("rep", *_CARRY, ints.alias("left"), F.explode(roots).alias("path"), F.lit(None).cast("bigint").alias("k"))
    leaves: list[DataFrame] = []
    pairs: list[DataFrame] = []
    for depth in count(1):
        # every set follows those of its words not yet on the path whose value in this bucket is under its bound: ``branching`` over the common words that a pair at the threshold has left
        step = big.select("path", "k", "rep", *_CARRY, "left", F.explode("left").alias("t"))
        value = F.xxhash64("path", "t").bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
        took = step.where(value * (F.col("n") * p.threshold - (depth - 1)) < p.branching)
        rows = took.select(F.col("path").alias("parent"), F.col("k").alias("of"), F.xxhash64("path", "t", F.lit(depth)).alias("path"), "rep", *_CARRY, "left", "t")
        sizes = cut(rows.groupBy("path").agg(F.count("*").alias("k"), F.any_value("parent").alias("parent"), F.any_value("of").alias("of")).where("k > 1"))
        scratch.append(sizes)
        per = sizes.groupBy("parent").agg(F.count("*").alias("n"), F.sum((F.col("k") > p.leaf).cast("int")).alias("large"), (F.sum(F.col("k") * F.col("k")) >= F.max(F.col("of") * F.col("of")) * F.lit(p.stuck)).alias("stuck"))
        alike = F.coalesce(F.col("stuck"), F.lit(False))  # the roots are always split
        n_sizes, n_stuck, n_large = per.agg(F.sum("n"), F.sum(alike.cast("bigint")), F.sum(F.when(~alike, F.col("large")))).first()
        if not n_sizes:
            break
        if n_stuck:
            whole = cut(per.where("stuck").select("parent"))
            scratch.append(whole)
            pairs.append(_all_pairs(_keyed(big.select("path", "rep", *_CARRY, "k"), whole.select(F.col("parent").alias("path")), n_stuck), p))
            sizes = sizes.join(F.broadcast(whole) if n_stuck <= MOST_SIZES else whole, "parent", "left_anti")
        leaf = sizes.where(F.col("k") <= p.leaf).select("path")
        leaves.append(_keyed(rows.select("path", "rep", *_CARRY), leaf, n_sizes))
        if not n_large:
            break
        going = _keyed(rows.drop("parent", "of"), sizes.where(F.col("k") > p.leaf).select("path", "k"), n_large)
        big = cut(going.select("path", "k", "rep", *_CARRY, F.array_remove("left", F.col("t")).alias("left")))
        scratch.append(big)
        done = F.lit(depth) >= F.ceil(F.col("n") * F.lit(p.common) - 1e-9)
        if depth >= math.ceil(p.min_words * p.common - 1e-9) and big.where(done).limit(1).count():
            pairs.append(_against_bucket(big.where(done), big, p))
    if leaves:
        pairs.append(_leaf_pairs(reduce(DataFrame.unionByName, leaves), p))
    return pairs, depth


def _keyed(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` paths of ``keys``, whose columns are added; keys travel by broadcast where they are few enough."""
    return rows.join(F.broadcast(keys), "path") if n <= MOST_SIZES else salted_join(rows, keys, "path", spread_by=["rep"])


def _leaf_pairs(leaves: DataFrame, p: ChosenPath) -> DataFrame:
    """Pairs within buckets of at most ``leaf`` rows, which need no tiles: one shuffle serves both sides."""
    j = leaves.alias("x").join(leaves.alias("y"), (F.col("x.path") == F.col("y.path")) & (F.col("x.rep") < F.col("y.rep")))
    ok = j.where(_may_reach(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), p))
    return ok.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _all_pairs(rows: DataFrame, p: ChosenPath) -> DataFrame:
    return tiled_self_join(rows, "path", "k", "rep", _CARRY, lambda a, b: _may_reach(a, b, p), p.tile)


def _against_bucket(some: DataFrame, rows: DataFrame, p: ChosenPath) -> DataFrame:
    """Pairs of ``some`` with all ``rows`` of their bucket; a large bucket is cut into tiles, to each of which the few are sent."""
    tiles = F.ceil(F.col("k") / F.lit(p.tile)).cast("int")
    a = some.select("path", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("o"), *[F.col(c).alias(f"a_{c}") for c in ["rep", *_CARRY]])
    b = rows.select("path", F.pmod(F.xxhash64("rep", F.lit(77)), tiles).cast("int").alias("o"), *[F.col(c).alias(f"b_{c}") for c in ["rep", *_CARRY]])
    j = a.join(b, ["path", "o"]).where((F.col("a_rep") != F.col("b_rep")) & _may_reach(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), p))
    return j.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))


def similar_classes(classes: DataFrame, p: ChosenPath) -> DataFrame:
    """Pairs of representatives whose word sets reach the threshold: (a, b, shared, either). Exact on every candidate."""
    f = Fraction(str(p.threshold))
    cand = candidate_pairs(classes, p)
    toks = classes.select(F.col("rep"), "toks")
    j = salted_join(cand, toks.select(F.col("rep").alias("a"), F.col("toks").alias("ta")), "a")
    j = salted_join(j, toks.select(F.col("rep").alias("b"), F.col("toks").alias("tb")), "b", spread_by=["a"])
    s = j.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), (F.size("ta") + F.size("tb")).alias("_both"))
    s = s.withColumn("either", F.col("_both") - F.col("shared")).drop("_both")
    return s.where(F.col("shared") * f.denominator >= F.col("either") * f.numerator)


def latest_values(nodes: DataFrame) -> DataFrame:
    """One row (id, value) per id: of re-delivered ids the value loaded last."""
    kind = dict(nodes.dtypes)["loaded_at"]
    at = F.coalesce("loaded_at", F.lit("0001-01-01").cast(kind))
    return nodes.where("id IS NOT NULL").groupBy("id").agg(F.max_by("value", F.struct(at, F.xxhash64("value"))).alias("value"))


def near_duplicate_links(docs: DataFrame, p: ChosenPath) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, links) of (id, value) rows; links are the pairs of ``similar_classes``, as a written table."""
    classes, members = word_classes(docs, p)
    return classes, cut(members), cut(similar_classes(classes, p))


def near_duplicate_pairs(docs: DataFrame, p: ChosenPath) -> DataFrame:
    """All pairs of ids (id_a < id_b) whose word sets reach the threshold, copies included.

    Texts that are null, empty or have under ``min_words`` distinct words pair with nothing. Repeated rows of one id must have been
    reduced to one. Equal word sets are one class throughout the join and are expanded at the end only, in tiles where a class is large.
    """
    classes, members, links = near_duplicate_links(docs, p)
    sized = salted_join(members, classes.where("m > 1").select("rep", "m"), "rep")
    same = tiled_self_join(sized, "rep", "m", "id", [], lambda a, b: F.lit(True), p.tile)
    ma, mb = members.select(F.col("rep").alias("a"), F.col("id").alias("ia")), members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    one = salted_join(ma, links.select("a", "b"), "a")
    across = salted_join(one, mb, "b", spread_by=["ia"]).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return same.unionByName(across).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def near_duplicate_groups(docs: DataFrame, p: ChosenPath) -> DataFrame:
    """One row per id that has enough words: (id, class_id, group_id, n_links).

    class_id: least id with the same word set; group_id: least id of the connected group; n_links: ids that reach the threshold with
    this one. Counts come from class sizes, no pair of copies is formed.
    """
    classes, members, links = near_duplicate_links(docs, p)
    comp = connected_components(links, classes.select(F.col("rep").alias("id")), "a", "b")
    m = classes.select("rep", "m")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(m.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("m").alias("o"))
    per_class = m.join(others, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep").select("rep", "component", (F.col("m") - 1 + F.coalesce("o", F.lit(0))).cast("bigint").alias("n_links"))
    return salted_join(members, per_class, "rep").select("id", F.col("rep").alias("class_id"), F.col("component").alias("group_id"), "n_links")
