"""Training-data operators against brute force, round trips and held-out accuracy, on small fixtures with odd rows."""

import dataclasses
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bisect, boost, hnsw, knn, mixing, packing, pii, tokens
from kinweave.llm import chosen_path as cp
from kinweave.llm import queries as q
from kinweave.llm import score_bands as sb
from kinweave.llm.pii_sample import labelled_texts
from tests.conftest import SMALL, check_sql


@pytest.mark.parametrize("name", sorted(q.R.sql))
def test_matches_sql(spark, duck, name):
    check_sql(spark, duck, q.R.queries[name], q.R.sql[name])


# --- p1 -----------------------------------------------------------------------------------------------------------


def _word_sets(rows):
    return {i: frozenset(re.findall(r"[^\W_]+", v.lower())) for i, v in rows if i is not None and v}


def _texts(seed=1, n=500):
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"w{i}" for i in range(4000)]
    out = []
    while len(out) < n:
        base = r.sample(common, 4) + r.sample(rare, r.randint(1, 10))
        for _ in range(r.choice([1, 1, 2, 4])):
            v = [w for w in base if r.random() > 0.08] + r.sample(rare, r.choice([0, 0, 1, 2]))
            r.shuffle(v)
            out.append(" ".join(v))
    hot = " ".join(r.sample(common, 6))
    return list(enumerate([*out[:n], *[hot.upper() + "!"] * (n // 3), "", "a b c", None, "x" * 20000]))


def test_p1_pairs_equal_brute_force(spark):
    rows = _texts()
    p = cp.ChosenPath(threshold=0.6, min_words=5, leaf=6, tile=16)  # small leaves, so that buckets are split for several levels
    df = spark.createDataFrame([(i, v, "zz") for i, v in rows] + [(None, "a b c d e f", "zz")], "id bigint, value string, rep string")
    s = {i: w for i, w in _word_sets(rows).items() if len(w) >= 5}
    ids = sorted(s)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(s[a] & s[b]) >= 6 * len(s[a] | s[b])}
    got = [(r[0], r[1]) for r in cp.near_duplicate_pairs(df, p).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.99 * len(want)
    g = {r["id"]: r for r in cp.near_duplicate_groups(df, p).collect()}
    links = Counter(x for pair in want for x in pair)
    assert set(g) == set(ids) and sum(abs(g[i]["n_links"] - links[i]) for i in ids) <= 0.02 * len(want)
    assert all(g[a]["group_id"] == g[b]["group_id"] for a, b in got)
    assert cp.near_duplicate_pairs(df.limit(0), p).count() == 0


def test_p1_on_the_smallest_table(spark, duck):
    rows = duck.execute("SELECT DISTINCT id, value FROM text_nodes").fetchall()
    s = {i: w for i, w in _word_sets(rows).items() if len(w) >= 5}
    ids = sorted(s)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(s[a] & s[b]) >= 6 * len(s[a] | s[b])}
    assert {tuple(r) for r in q.p1_found(spark, SMALL).collect()} == want


def test_p1_survival():
    p = cp.ChosenPath(threshold=0.6)
    assert 0.4 < cp.survival(p, 8) <= cp.survival(p, 4) <= cp.survival(p, 1) < 1


def _kinds_of_pairs(spark, rows, p, monkeypatch):
    """What the runs yield, per kind of bucket: sets of (a, b)."""
    kinds = defaultdict(list)
    for name in ("_leaf_pairs", "_all_pairs", "_against_bucket"):
        def wrapped(*a, f=getattr(cp, name), name=name):
            kinds[name].append(f(*a))
            return kinds[name][-1]

        monkeypatch.setattr(cp, name, wrapped)
    classes, _ = cp.word_classes(spark.createDataFrame(rows, "id bigint, value string"), p)
    scratch = []
    _, depth = cp._runs(classes, range(0, 8), p, scratch)
    return {k: {tuple(r) for df in v for r in df.collect()} for k, v in kinds.items()}, depth


def test_p1_pairs_come_from_sampled_buckets(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]  # every word is held by a sixth of the sets: no word alone finds a pair
    rows = []
    while len(rows) < 900:
        base = r.sample(words, 10)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:9], r.choice(words)]))]
    p = cp.ChosenPath(threshold=0.75, min_words=5, leaf=12)
    s = _word_sets(rows)
    want = {(a, b) for a in s for b in s if a < b and s[a] != s[b] and 4 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b])}
    kinds, depth = _kinds_of_pairs(spark, rows, p, monkeypatch)
    assert len(want) > 400 and depth >= 2
    assert len(kinds["_leaf_pairs"] & want) >= 0.95 * len(want) and len(set().union(*kinds.values()) & want) >= 0.99 * len(want)


def test_p1_buckets_that_cannot_be_split(spark, monkeypatch):
    """Sets that are all alike end in buckets joined as they are, short sets of common words among the finished ones."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(5)]
    rows = [(i, " ".join([*[f"a{k}" for k in range(12)], f"x{i}"])) for i in range(120)] + [(1000 + i, " ".join([*common, f"y{i}", f"z{i % 7}"])) for i in range(90)]
    r.shuffle(rows)
    s = _word_sets(rows)
    p = cp.ChosenPath(threshold=0.6, min_words=5, leaf=4, tile=16)
    want = {(a, b) for a in s for b in s if a < b and 10 * len(s[a] & s[b]) >= 6 * len(s[a] | s[b])}
    kinds, _ = _kinds_of_pairs(spark, rows, p, monkeypatch)
    got = set().union(*kinds.values())
    assert len(got & want) >= 0.99 * len(want) and kinds["_all_pairs"]
    kinds, _ = _kinds_of_pairs(spark, [(i, v) for i, v in rows if i >= 1000], dataclasses.replace(p, stuck=1e9), monkeypatch)
    assert kinds["_against_bucket"]


# --- p3 -----------------------------------------------------------------------------------------------------------


def test_p3_with_ties_repeats_and_a_hot_group(spark):
    r = random.Random(2)
    rows = [(r.choice([1] * 5 + list(range(2, 60))), r.randint(1, 400), r.choice([0.0, 0.25, 0.5, 0.5, 1.0, r.random(), 1.5, float("nan"), None]), 3) for _ in range(9000)] + [(None, 1, 0.5, 3), (7, None, 0.5, 3)]
    df = spark.createDataFrame(rows, "src bigint, dst bigint, sim double, place int")
    best = defaultdict(dict)
    for s, d, v, _ in rows:
        if s is not None and d is not None and s != d and v is not None and 0 <= v <= 1:
            best[s][d] = max(v, best[s].get(d, -1))
    want = {(s, d, v, k + 1) for s, m in best.items() for k, (d, v) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:10])}
    got = [tuple(x) for x in sb.top_items(df, 10, low=0.0, high=1.0).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sb.top_items(df.limit(0), 10).count() == 0


# --- p5, p6 ---------------------------------------------------------------------------------------------------------


def _vectors(spark, seed=3):
    r = np.random.default_rng(seed)
    centres = r.uniform(-10, 10, (25, 8))
    x = [c + r.normal(0, 0.35, 8) for c in centres for _ in range(int(r.integers(1, 40)))] + list(r.uniform(-10, 10, (150, 8)))
    same = [x[0]] * 30
    rows = [(i, [float(y) for y in v]) for i, v in enumerate([*x, *same])]
    odd = [(9001, None), (9002, []), (9003, [1.0]), (9004, [float("nan")] * 8), (9005, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (9006, [None] + [0.0] * 7)]
    from datetime import datetime

    df = spark.createDataFrame([(i, v, k % 3, datetime(2025, 1, 1)) for k, (i, v) in enumerate([*rows, *odd, *rows[:20]])], "id bigint, value array<double>, partition int, loaded_at timestamp_ntz")
    return df, np.array([v for _, v in rows])


def _near(x, min_sim=0.25):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = 1 / (1 + d)
    np.fill_diagonal(s, -1)
    return s, s >= min_sim


def test_p5_recall_in_one_and_in_many_shards(spark):
    df, x = _vectors(spark)
    s, ok = _near(x)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:10] if ok[i, j]}
    for rows, block, probes in ((16384, 256, 24), (100, 256, None), (40, 4, None), (40, 4, 6)):  # one shard, several, blocks of blocks
        p = knn.Knn(dim=8, shard_rows=rows, ef=32, block=block, probes=probes)
        got = knn.nearest_vectors(df, p).collect()
        pairs = {(r["src"], r["dst"]) for r in got}
        assert len(pairs) == len(got) and len(pairs & want) / len(want) > 0.99 and len(pairs & want) / len(pairs) > 0.99
        assert all(r["sim"] >= 0.25 and r["src"] != r["dst"] for r in got)
    assert knn.nearest_vectors(df.limit(0), knn.Knn(dim=8)).count() == 0


def test_p5_planes_bound_distances():
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 6))
    planes = knn.fit_planes(x, 5, 0.5)
    assert max(np.bincount(planes.homes(x), minlength=32)) < 400
    radius = np.full(len(x), 1.0)
    row, shard, gap = planes.reach(x, radius)
    assert (shard[np.searchsorted(row, np.arange(len(x)))] == planes.homes(x)).all() and (gap <= 1.0 + 1e-9).all()
    touched = set(zip(row.tolist(), shard.tolist()))
    d = ((x[:200, None] - x[None]) ** 2).sum(-1) <= 1.0
    assert all((i, s) in touched for i, j in zip(*np.nonzero(d)) for s in [planes.homes(x[j : j + 1])[0]])
    few = planes.reach(x, radius, 3)
    assert np.bincount(few[0]).max() <= 3 and len(set(few[0])) == len(x)
    assert knn.fit_planes(np.repeat(np.eye(3), [1, 1, 98], axis=0), 1, 0.1).homes(np.eye(3)).tolist().count(1) in (1, 2)
    again = knn.Planes.load(**planes.flat())
    assert (again.homes(x) == planes.homes(x)).all()


def test_hnsw_flat_arrays_round_trip():
    x = np.random.default_rng(5).normal(size=(900, 10))
    h = hnsw.Hnsw(x).build()
    k = hnsw.Hnsw.load(h.flat())
    a, b = h.search(x[:50], 32)[0], k.search(x[:50], 32)[0]
    assert (a == b).all()
    d = ((x[:50, None] - x[None]) ** 2).sum(-1)
    assert np.mean([len(set(a[i][:10]) & set(np.argsort(d[i])[:10])) for i in range(50)]) > 9
    assert len(hnsw.Hnsw(x[:1]).build().search(x[:1], 8)[0]) == 1


@pytest.mark.parametrize("local", [20000, 60])
def test_p6_equals_brute_force(spark, local):
    df, x = _vectors(spark)
    _, ok = _near(x)
    sets = [frozenset(np.nonzero(ok[i])[0].tolist()) | {i} for i in range(len(x))]
    want = {(min(s), i) for i, s in enumerate(sets) if len(s) >= 3 and all(sets[j] == s for j in s)}
    p = bisect.Bisecting(dim=8, local_rows=local)
    members, leaves, classes = bisect.similarity_clusters(df, p)
    got = {(r["cluster_id"], r["id"]) for r in members.collect()}
    assert want and got == want
    leaf = {r["leaf"]: r for r in leaves.collect()}
    reps = {r["rep"]: np.array(r["vec"]) for r in classes.collect()}
    assert sum(r["n"] for r in leaf.values()) == len(reps) and all(r["radius"] <= 3.0 for r in leaf.values())
    assert {m["leaf"] for m in members.collect()} == {k for k, r in leaf.items() if r["cluster_id"] is not None} and len(leaf) < len(reps)
    d = {r["cluster_id"]: r for r in bisect.describe_clusters(members, classes, df, p).collect()}
    sizes = Counter(c for c, _ in want)
    assert {c: r["n_members"] for c, r in d.items()} == dict(sizes)
    for c, r in d.items():
        ids = [i for k, i in want if k == c]
        far = np.sqrt(((x[ids] - x[ids].mean(0)) ** 2).sum(1))
        assert r["typical_ids"][0] in {i for i, f in zip(ids, far) if f <= far.min() + 1e-8}
    assert bisect.similarity_clusters(df.limit(0), p)[0].count() == 0


# --- p8, p9 ---------------------------------------------------------------------------------------------------------


def _best_fit_decreasing(lengths, cap):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= x]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= x
        else:
            bins.append(cap - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_p8_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    cap = r.choice([10, 50, 128])
    lengths = [r.randint(1, cap) if r.random() < 0.7 else 3 for _ in range(400)]
    assert packing.plan_best_fit(dict(Counter(lengths)), cap).containers == _best_fit_decreasing(lengths, cap)


def test_p8_slots(spark):
    r = random.Random(1)
    rows = [(i, r.choice([7, 7, 7, r.randint(1, 60), 250, 100, 0, None])) for i in range(800)]
    out, plan = packing.pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), 100, chunks=5)
    got = out.collect()
    per, fill, left = defaultdict(int), defaultdict(int), {}
    for x in got:
        per[x["doc_id"]] += x["tokens"]
        fill[x["container"]] += x["tokens"]
        assert left.setdefault(x["container"], x["space_left"]) == x["space_left"]
    assert dict(per) == {i: t for i, t in rows if t}
    assert all(fill[c] + left[c] == 100 for c in fill) and set(fill) == set(range(plan.containers))
    pieces = Counter(x["doc_id"] for x in got)
    assert all(pieces[i] == -(-t // 100) for i, t in rows if t)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 100)[0].count() == 0


def test_token_counts_are_those_of_a_round_trip(spark):
    enc = tokens.encoding()
    texts = ["plain words here", "", None, "naïve café — 東京 <|endoftext|>", "ab " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["tokens"] for r in tokens.count_tokens(df).collect()}
    assert got == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_p9_shares_repeats_and_order(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["big"] * 8 + ["mid", "small", None, "other"]), r.choice([0, None, *range(1, 40)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    plan = mixing.tilted({"big": (0.5, 1), "mid": (0.3, 2), "small": (0.2, 4), "absent": (0.0, 2)})
    assert abs(sum(t.share * w for t in plan.values() for w in t.weights[:1]) - 1) < 1e-9
    out = mixing.mix(df, plan, rows_per_chunk=50).collect()
    assert [x["position"] for x in out] == sorted(x["position"] for x in out) and 0 <= out[0]["position"] and out[-1]["position"] <= 1
    by = Counter()
    for x in out:
        by[x["source"]] += x["tokens"]
    total = sum(by.values())
    assert all(abs(by[s] / total - plan[s].share) < 0.01 for s in ("big", "mid", "small")) and set(by) == {"big", "mid", "small"}
    uses = Counter((x["source"], x["doc_id"]) for x in out)
    assert all(n <= plan[s].max_repeats for (s, _), n in uses.items()) and max(uses.values()) > 1
    late = sum(x["tokens"] for x in out if x["source"] == "small" and x["position"] > 0.5)
    assert late > 0.55 * by["small"]
    assert mixing.mix(df.limit(0), plan).count() == 0
    t = spark.createDataFrame([(s, p.share) for s, p in plan.items()], "source string, target_share double")
    rep = {x["source"]: x for x in mixing.shares(spark.createDataFrame(out), t).collect()}
    assert rep["absent"]["tokens"] == 0 and abs(sum(x["actual_share"] for x in rep.values()) - 1) < 1e-4


def test_p9_source_spelling(spark):
    df = spark.createDataFrame([(" Shop-Web ",), ("shop web",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.plain_source("s")).collect()] == ["shop_web", "shop_web", None, None]


# --- p10 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def detector():
    return pii.train(brands=frozenset({"talvi"}))


def test_boosted_trees_learn_and_calibrate():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boost.Boosted().fit(x[:1500], y[:1500]).calibrate(x[1500:2200], y[1500:2200])
    p = m.score(x[2200:])
    assert ((p > m.threshold) == y[2200:]).mean() > 0.95 and abs(p.mean() - y[2200:].mean()) < 0.05
    assert len(m.score(x[:0])) == 0


def test_p10_held_out_accuracy(detector):
    """On generated texts of another seed; their carriers are known to the cue words."""
    hit, wrong, missed = Counter(), Counter(), Counter()
    sample = labelled_texts(500, 77)
    d = dataclasses.replace(detector, words=pii.Words.of([t for t, _ in sample], detector.words.known))
    for (text, truth), got in zip(sample, d.spans_of([t for t, _ in sample])):
        hit.update(k for *_, k in set(truth) & set(got))
        wrong.update(k for *_, k in set(got) - set(truth))
        missed.update(k for *_, k in set(truth) - set(got))
    for k in pii.KINDS:
        assert hit[k] / (hit[k] + wrong[k]) > 0.85 and hit[k] / (hit[k] + missed[k]) > 0.85, (k, hit[k], wrong[k], missed[k])


#: Written by hand, with carriers that the generator does not have: text with [kind|span].
UNSEEN = """The parcel was signed off by my cousin [name|Lorena Vasquillo] while I was at work.
If anything is unclear just buzz [phone|+44 20 7946 0018] and leave word.
Nobody at [address|88 Penrose Lane] had seen the driver.
They photographed my passport [id_number|KD4482190] at reception.
You may quote me: [email|t.okafor+garden@weststead.example] is read daily.
Part 4471-B broke, serial 8812-4471-90, and the lid came loose.
Our landlord, [name|Piet Vandermolen], fixed the hinge within a day.
Bitte klingeln bei [name|Swantje Ohlrogge], zweiter Stock.
Der Hausmeister hat die Nummer [phone|030 99887 123] am Tor stehen.
Unsere neue Adresse lautet [address|Birkenhorster Weg 17a].
Lieferschein 77120394 liegt bei, Sendung 884-221-903 fehlt noch.
On peut joindre [name|Aurélien Castagnet] après midi.
Le gardien vit au [address|14 bis, rue des Tanneurs].
Composez plutôt [phone|06 12 34 56 78] pendant la semaine.
La portera se llama [name|Remedios Tarrago] y es encantadora.
Vivimos desde hace poco en [address|Calle de Almendros 42, 3º B].
Mi hermano usa [email|j_benavides@rioclaro.example] para todo.
Guter Halt, schönes Holz, nur etwas laut.
The Talvi Pro 380 is quieter than the Talvi 200.
Very Nice Bench, will order another."""


def test_p10_texts_with_unseen_carriers(detector):
    hit = wrong = missed = 0
    texts, truths = [], []
    for line in UNSEEN.split("\n"):
        text, spans, at = "", set(), 0
        for m in re.finditer(r"\[(\w+)\|([^\]]*)\]", line):
            text += line[at : m.start()]
            spans.add((len(text), len(text) + len(m.group(2)), m.group(1)))
            text, at = text + m.group(2), m.end()
        texts.append(text + line[at:])
        truths.append(spans)
    for truth, got in zip(truths, detector.spans_of(texts)):
        hit, wrong, missed = hit + len(truth & set(got)), wrong + len(set(got) - truth), missed + len(truth - set(got))
    assert hit / (hit + missed) >= 0.75 and hit / (hit + wrong) >= 0.75, (hit, wrong, missed)


def test_p10_phrases_are_not_those_of_the_tables(duck):
    from kinweave.llm import pii_sample

    docs = "\0".join(t.lower() for (t,) in duck.execute("SELECT text FROM read_parquet('/root/testdata/sf0.1/documents.parquet') WHERE text IS NOT NULL").fetchall())
    pieces = {f.strip().lower() for tab in (pii_sample._CARRIERS, pii_sample._PLAIN) for v in tab.values() for c in re.split(r"[|\n]", v) for f in re.split(r"<\w>|\{\w+\}", c)}
    assert not [f for f in pieces if len(f) >= 12 and f in docs]


def test_p10_words_are_counted_alike_in_both_ways(spark):
    texts = ["The cat sat on a mat. Cat food, cat toys, Émile.", None, "", "cat and Cat, and cat", *["Red Hill", "Red Hill Farm"] * 3, "Red House"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    a, b = pii.words_of(df, frozenset({"mat"}), 1), pii.Words.of([t for t in texts if t], frozenset({"mat"}), 1)
    assert a.fixed == b.fixed == {"red hill": 6 / 7} and a.counts == b.counts and a.counts["cat"] == (4, 3) and a.ordinary("mat") and not a.ordinary("émile")
    assert pii.words_of(df.limit(0), frozenset()).counts == {}


@pytest.mark.parametrize("limit", [pii.BROADCAST_BYTES, 0])
def test_p10_rare_words_count_in_a_large_collection(spark, limit):
    """1.4 million pairs and 2.8 million words beside them leave what is known of a word met three times, and of a pair met six times, as it was."""
    few = ["We saw a flumpet and flumpet, flumpet there. The Mat, a Mat, a Mat."] + ["Red Hill"] * 6
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(few)], "doc_id bigint, text string")
    bulk = spark.range(700, numPartitions=4).select("id", F.lit("Tall Oak " * 2000).alias("text"))
    known = frozenset({"mat", "oak"})
    for x in (docs, docs.unionByName(bulk.withColumnRenamed("id", "doc_id"))):
        w = pii.words_of(x, known, limit=limit)
        lower, fixed = w.lower, w.fixed
        if w.tables is not None:
            lower, fixed = frozenset(r[0] for r in w.tables[0].collect()), dict(map(tuple, w.tables[1].collect()))
        w = dataclasses.replace(w, lower=lower, fixed=fixed)
        assert w.ordinary("flumpet") and not w.ordinary("mat") and w.fixed["red hill"] == 1


def test_p10_many_words_are_joined_with_the_same_result(spark, detector):
    texts = [t for t, _ in labelled_texts(300, 78)] + ["the flumpet gorbel, a flumpet gorbel, one flumpet gorbel rang. Red Hill"] * 6 + ["mail gorbel@flum​pet.test", "flumpet gorbel", "RED HILL red hill", "", None, None]
    df = spark.createDataFrame([(None if i == 5 else i % 290, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    whole, joined = (dataclasses.replace(detector, words=pii.words_of(df, detector.words.known, limit=n)) for n in (pii.BROADCAST_BYTES, 0))
    assert whole.words.tables is None and whole.words.fixed and joined.words.tables is not None and not joined.words.fixed
    assert {w for w in whole.words.counts if w in detector.words.known and not whole.words.ordinary(w)} == set(joined.words.counts)
    a, b = ([sorted(map(str, x.collect())) for x in (pii.find(df, d), pii.redact(df, d, {}))] for d in (whole, joined))
    assert a == b and len(a[0]) > 100 and len(a[1]) == len(texts)
    bare = dataclasses.replace(detector, words=pii.Words({}, detector.words.known))
    assert sorted(map(str, pii.find(df, bare).collect())) != a[0]  # the words do matter here


def test_p10_redaction_leaves_the_rest(spark, detector):
    texts = [
        "Thanks to Jorvi Tastrem it went well.\nContact number: +44 (0)7700 900 123. Order 4021-12345, part no. 12345678.",
        "Write: jorvi.tastrem@mail​wick.test. The Talvi Pro 380 broke.", "SSN: 123-45-6789, they said.", "We moved to 12 Old Mill Lane in May.",
        "Two of 7 pieces were bent. Version 1.88.171 of the app works.", "", None, "quiet and tidy. " * 3000,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string")
    red = {r["doc_id"]: r for r in pii.redact(df, detector, {"name": "[NAME]", "phone": "[PHONE]", "email": "[EMAIL]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}).collect()}
    assert red[0]["text"] == "Thanks to [NAME] it went well.\nContact number: [PHONE]. Order 4021-12345, part no. 12345678."
    assert red[1]["text"] == "Write: [EMAIL]. The Talvi Pro 380 broke."
    assert red[2]["text"] == "SSN: [ID_NUMBER], they said." and red[3]["text"] == "We moved to [ADDRESS] in May."
    assert all(red[i]["text"] == texts[i] and red[i]["n_found"] == 0 for i in (4, 5, 6, 7))
    found = {tuple(r) for r in pii.find(df, detector).collect()}
    assert (1, "email", "jorvi.tastrem@mail​wick.test") in found and (0, "name", "Jorvi Tastrem") in found
    assert pii.find(df.limit(0), detector).count() == 0


def test_p10_sample_is_reproducible():
    assert labelled_texts(40, 5) == labelled_texts(40, 5)
    for text, spans in labelled_texts(300, 6):
        assert all(0 <= a < b <= len(text) and k in pii.KINDS for a, b, k in spans)


def test_parameters_are_plain_dataclasses():
    assert dataclasses.replace(q.P5, k=3).k == 3 and q.P1.threshold == 0.6
