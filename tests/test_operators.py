"""Operators on small frames with known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.operators import blocking, calibration, decisions, evaluation, fellegi, groups, lexicon, models, pairs, records, sampling, windows
from tessera.sources import tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- similarity


def test_jaro_winkler_conventions():
    assert sim.jaro_winkler("", "") == 1 and sim.jaro_winkler("a", "") == 0
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert sim.jaro_winkler("ab", "cd") == 0
    # three mismatched places are one and a half transpositions; a low Jaro value still gets its prefix
    assert sim.jaro_winkler("abcd", "axyz") > sim.jaro_winkler("abcd", "axyz", floored=True)


def test_numbers(spark):
    cases = [(1131, 1132), (1131, 1113), (1131, 1311), (12, 21), (1, 2), (100, 1000), (252, 52), (1681, 16), (105, 5), (7, 77)]
    df = spark.createDataFrame(cases, "x long, y long")
    got = df.select("x", "y", sim.near_number(F.col("x"), F.col("y")).alias("near"), sim.one_deleted(F.col("x"), F.col("y")).alias("del"), sim.fuzzy_numbers(F.col("x"), F.col("y")).alias("fuzzy"))
    want = {(1131, 1132): (True, False, False), (1131, 1113): (True, False, False), (1131, 1311): (True, False, False), (12, 21): (True, False, False), (1, 2): (False, False, False),
            (100, 1000): (False, True, True), (252, 52): (False, True, True), (1681, 16): (False, False, True), (105, 5): (False, False, False), (7, 77): (False, False, False)}
    assert {(r["x"], r["y"]): (r["near"], r["del"], r["fuzzy"]) for r in got.collect()} == want


def test_sets(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], [])], "a array<long>, b array<long>")
    got = df.select(sim.jaccard(F.col("a"), F.col("b")).alias("j"), sim.number_stats(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["j"] for r in got] == [1 / 3, None, 0.0] and [r["n"]["conflict"] for r in got] == [0, 0, 0]
    assert sim.domain_cover("nmnidhiprivate", "nm nidhi private") == 1.0 and sim.domain_cover("abc", "xyz") == 0.0 and sim.domain_cover("", "a") is None
    assert sim.soft_share("main street", "main stret") == pytest.approx((4 + 6 * sim.jaro_winkler("street", "stret")) / 10)
    assert sim.monge_elkan([], ["a"]) is None and sim.monge_elkan(["ab"], ["ab", "xy"]) == pytest.approx((1 + 0.5) / 2)


@pytest.mark.parametrize("seed", range(3))
def test_string_ratios(spark, seed):
    rnd = random.Random(seed)
    cases = [("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))), "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12)))) for _ in range(60)]

    def dice(a, b):
        gram = lambda s: [("^" + s + "$")[i : i + 3] for i in range(len(s))]
        left = gram(b)
        return 2 * sum(left.remove(g) is None for g in gram(a) if g in left) / (len(a) + len(b)) if a and b else 0.0

    def prefix(a, b):
        return len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))) / min(len(a), len(b)) if a and b else 0.0

    got = spark.createDataFrame(cases, "a string, b string").select("a", "b", sim.tri_dice(F.col("a"), F.col("b")).alias("d"), sim.prefix_ratio(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r["d"] == pytest.approx(dice(r["a"], r["b"])) and r["p"] == pytest.approx(prefix(r["a"], r["b"]))


# ---------------------------------------------------------------- records and blocking


def business(spark):
    data = [(1, 1, "Acme Tools Ltd", "12 Main St, Austin, TX", "US"), (2, 1, "Blue Sky Cafe", "7 Oak Ave, Dallas, TX", "US"), (3, 1, "Acme Tools Ltd", "", "France"),
            (11, 2, "ACME T0OLS Limited", "12 Main Street, Austin, Texas", "US"), (12, 2, "Bluesky Cafe", "7 Oak Avenue, Dallas", "US"), (13, 3, "Acme Tools Partners", "99 Elm Rd, Austin, TX", "US"), (14, 3, "Acme Outils SARL", "3 rue X, Lyon", "France")]
    return records.encode(spark.createDataFrame(data, "id long, src int, name string, address string, country string"))


def test_blocking_stays_in_pools_and_breaks_ties_by_id(spark):
    rec = business(spark)
    cands = blocking.candidates(rec, blocking.Blocking(k1=2, rev_k=1))
    got = {(r["a"], r["b"]): r for r in cands.collect()}
    assert (1, 11) in got and (2, 12) in got and got[1, 11]["fwd_rank"] == 1 and not any((a == 3) != (b == 14) for a, b in got)
    assert got[1, 11]["rev_rank"] == 1 and got[1, 11]["gap_a"] == 0
    scored = spark.createDataFrame([(q, d, "p", round(random.Random(q * 100 + d).choice([0.1, 0.2, 0.3]), 1)) for q in range(20) for d in range(15)], "a long, b long, pool string, score double")
    one = rows(blocking.top_reverse(scored, 3), "b", "rank", "a")
    assert one == rows(blocking.top_reverse(scored.repartition(7), 3), "b", "rank", "a")


def test_blocking_without_limits_is_brute_force(spark):
    rec = business(spark)
    feats: dict = {}
    for r in blocking.features(rec).collect():
        feats.setdefault((r["id"], r["src"], r["pool"]), set()).add((r["type"], r["feature"]))
    right = {k: v for k, v in feats.items() if k[1] > 1}
    size = {p: sum(k[2] == p for k in right) for _, _, p in feats}
    df = {}
    for (_, _, p), own in right.items():
        for f in own:
            df[p, f] = df.get((p, f), 0) + 1
    weight = lambda p, f: blocking.Blocking().weights[f[0]] * math.log((size[p] + 1) / df[p, f]) if (p, f) in df else 0.0
    vector = {k: {f: weight(k[2], f) for f in own} for k, own in feats.items()}
    norm = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in vector.items()}
    want = {}
    for x, v in vector.items():
        for y, u in vector.items():
            if x[1] == 1 and y[1] > 1 and x[2] == y[2] and any(w and u.get(f) for f, w in v.items()):
                want[x[0], y[0]] = sum(w * u.get(f, 0.0) for f, w in v.items()) / (norm[x] * norm[y])
    sizes = rec.groupBy("pool").agg(F.count_if(F.col("src") > 1).alias("n_right"))
    every = blocking.features(rec)
    got = blocking.similar_pairs(blocking.vectors(every, blocking.retrieval_weights(every, sizes, blocking.Blocking(caps=None))), None)
    assert {(r["a"], r["b"]): pytest.approx(r["score"], abs=1e-8) for r in got.collect()} == want


def test_idf_is_per_pool(spark):
    df = spark.createDataFrame([(1, 1, "p", ["x", "y"]), (2, 2, "p", ["x"]), (3, 1, "q", ["x"])], "id long, src int, pool string, nt array<string>")
    got = {(r["pool"], r["token"]): r["idf"] for r in records.model_idf(df, "nt").collect()}
    assert got == {("p", "x"): 1.0, ("p", "y"): math.log(3 / 2) + 1, ("q", "x"): 1.0}


def test_state_fill(spark):
    data = [(i, 1, "france", ["x", "nantes"], "pays de la loire") for i in range(25)] + [(100 + i, 1, "france", ["y", "lyon"], "auvergne rhone alpes") for i in range(25)]
    data += [(200, 2, "france", ["rue", "nantes"], None), (201, 2, "france", ["a", "lyon", "nantes"], None)]
    df = spark.createDataFrame(data, "id long, src int, country string, at array<string>, state string")
    got = {r["id"]: r["state"] for r in records.fill_states(df, records.state_words(df)).collect()}
    assert got[200] == "pays de la loire" and got[201] is None and got[0] == "pays de la loire"


def test_all_columns(spark):
    rec = business(spark)
    full = pairs.full_features(blocking.candidates(rec), rec)
    assert [c for c in pairs.COLUMNS if c != "fs_llr"] == [c for c in full.columns if c not in ("a", "b")] or set(pairs.COLUMNS) - {"fs_llr"} == set(full.columns) - {"a", "b"}
    assert len(pairs.COLUMNS) == 71
    got = {(r["a"], r["b"]): r for r in full.collect()}
    assert got[1, 11]["jw_sorted"] == 1 and got[1, 11]["state_cat"] == 1 and got[1, 11]["num_shared"] == 1 and got[1, 13]["sib_b_only"] == 1


# ---------------------------------------------------------------- windows and groups


def test_context(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.2), (2, 1, 0.5)], "a long, b long, p double")
    got = {(r["a"], r["b"]): r for r in windows.pair_context(df, "p").collect()}
    assert got[1, 1]["p_other_a"] == 0.9 and got[1, 3]["p_other_a"] == 0.9 and got[2, 1]["p_other_a"] == 0.0
    assert got[1, 1]["p_rank_a"] == 1 and got[1, 2]["p_rank_a"] == 2 and got[2, 1]["p_margin_b"] == pytest.approx(-0.4) and got[1, 1]["p_c05_a"] == 2 and got[2, 1]["p_c05_a"] == 0


def test_group_agreement(spark):
    rec = spark.createDataFrame([(1, 1, "p", ["t"], ["s"], "s", [5]), (11, 2, "p", ["t"], ["s"], "s", [5, 6]), (12, 2, "p", ["t"], ["s"], "s", [5]), (13, 3, "p", ["u"], [], "", [])], "id long, src int, pool string, nt array<string>, at array<string>, a_sorted string, nu array<long>")
    df = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.8), (1, 13, 0.1)], "a long, b long, p double")
    got = {r["b"]: r for r in groups.group_agreement(df, rec, "p").collect()}
    assert (got[11]["g_n"], got[12]["g_n"], got[13]["g_n"]) == (1, 1, 2)
    assert got[11]["g_num_agree"] == 1 and got[11]["g_cons_num"] == 1 and got[13]["g_cons_num"] is None and got[13]["g_tri_wmean"] is None and got[13]["g_name_max"] == 0
    src = df.join(rec.select(F.col("id").alias("b"), "src"), "b")
    same = {r["b"]: (r["g_same_best"], r["g_other_best"], r["g_same_n"], r["g_other_n"]) for r in windows.source_context(src, "p").collect()}
    assert same == {11: (0.8, 0.1, 1, 0), 12: (0.9, 0.1, 1, 0), 13: (0.0, 0.9, 0, 2)}


# ---------------------------------------------------------------- Fellegi-Sunter


def test_levels(spark):
    df = spark.createDataFrame([(0.5, 0.1, None, None, 0.0, 1.0, 3.0, 2.0, 1.0)], "jw_sorted double, ntok_cos double, atok_cos double, tri_addr double, num_shared double, num_conflict double, state_cat double, legal_cat double, acro double")
    r = fellegi.patterns(df).first()
    assert [r[f"lv_{n}"] for n in fellegi.COMPARISONS] == [3, 3, 4, 3, 1, 2, 1, 0]


def test_em_recovers_the_mixture():
    rng = np.random.default_rng(7)
    sizes = list(fellegi.COMPARISONS.values())
    m = [np.r_[0.8, np.full(k - 1, 0.2 / (k - 1))] for k in sizes]
    u = [np.r_[np.full(k - 1, 0.3 / (k - 1)), 0.7] for k in sizes]
    n, lam = 200_000, 0.15
    y = rng.random(n) < lam
    grid = np.stack([np.where(y, rng.choice(k, n, p=a), rng.choice(k, n, p=b)) for k, a, b in zip(sizes, m, u, strict=True)], axis=1)
    patterns, counts = np.unique(grid, axis=0, return_counts=True)
    start = {"m": {c: np.r_[0.6, np.full(k - 1, 0.4 / (k - 1))] for c, k in fellegi.COMPARISONS.items()}, "u": {c: np.full(k, 1 / k) for c, k in fellegi.COMPARISONS.items()}, "lam": 0.3}
    fit = fellegi.em([(tuple(p), c) for p, c in zip(patterns.tolist(), counts.tolist(), strict=True)], start)
    assert fit["lam"] == pytest.approx(lam, abs=0.01) and fellegi.rejected(fit) is None
    assert all(np.abs(fit["m"][c] - a).max() < 0.02 for c, a in zip(fellegi.COMPARISONS, m, strict=True))
    assert fellegi.rejected({**fit, "lam": 0.9})


# ---------------------------------------------------------------- decisions


def test_exclusivity(spark):
    df = spark.createDataFrame([(1, 9, 0.9), (2, 9, 0.7), (3, 8, 0.6), (4, 7, 0.5), (5, 7, 0.5)], "a long, b long, q double")
    soft = {r["a"]: r["x"] for r in df.select("a", decisions.soft_exclusive().alias("x")).collect()}
    assert soft[1] == pytest.approx(0.73, abs=0.005) and soft[2] == pytest.approx(0.19, abs=0.005) and soft[3] == pytest.approx(0.6)
    hard = lambda d: {r["a"]: r["x"] for r in df.select("a", decisions.hard_exclusive("q", d).alias("x")).collect()}
    assert hard(0.0) == {1: 0.9, 2: 0.0, 3: 0.6, 4: 0.5, 5: 0.0} and hard(0.3) == {1: 0.0, 2: 0.0, 3: 0.6, 4: 0.0, 5: 0.0}
    assert df.select(decisions.odds_shift(F.lit(0.5), 2.0).alias("x")).first()["x"] == pytest.approx(2 / 3)


def brute(ps, k):
    out = 0.0
    for world in itertools.product((0, 1), repeat=len(ps)):
        chance = math.prod(p if w else 1 - p for p, w in zip(ps, world, strict=True))
        tp, true = sum(world[:k]), sum(world)
        out += chance * ((true == 0) if k == 0 else 1.25 * tp / (k + 0.25 * true))
    return out


@pytest.mark.parametrize("ps", [[0.9, 0.8, 0.1], [0.3], [0.5, 0.5, 0.5, 0.5], [0.05, 0.01], [0.99, 0.98, 0.97, 0.5, 0.2]])
def test_selection(spark, ps):
    df = spark.createDataFrame([(ps,)], "ps array<double>").select("ps", F.explode(F.sequence(F.lit(0), F.size("ps"))).alias("k"))
    got = {r["k"]: r["e"] for r in df.select("k", decisions.expected_f05(F.col("ps"), F.col("k")).alias("e")).collect()}
    assert all(got[k] == pytest.approx(brute(ps, k)) for k in got)
    best = max(range(len(ps) + 1), key=lambda k: (brute(ps, k), -k))
    assert decisions.best_prefix(np.array(ps)) == best and decisions.best_prefix(np.array(ps), 0.0) == 0
    chosen = decisions.select(spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "a long, b long, q double")).filter("sel")
    assert rows(chosen, "b") == [(i,) for i in range(best)]


def test_group_settings_and_floor(spark):
    df = spark.createDataFrame([(1, 9, 0.9, "us"), (2, 9, 0.85, "us"), (3, 7, 0.65, "fr"), (4, 6, 0.9, "fr")], "a long, b long, q double, country string")
    out = decisions.decide_groups(df, {"us": {"excl": "hard:0.0"}, "*": {"excl": "soft"}})
    assert rows(out.filter("sel"), "a") == [(1,), (3,), (4,)]
    assert rows(decisions.unseen_floor(out, ["us"]).filter("sel"), "a") == [(1,), (4,)]
    rate, lam = decisions.prior_shift([(0.9, 300), (0.1, 700)], 0.5)
    assert 0.1 < rate < 0.34 and lam < 1


def test_calibration(spark):
    assert calibration.pool_adjacent([1.0, 0.0, 2.0], [1, 1, 1]) == [0.5, 0.5, 2.0]
    rnd = random.Random(1)
    data = [(p, int(rnd.random() < p * p)) for p in (rnd.random() for _ in range(4000))]
    df = spark.createDataFrame(data, "p double, y int")
    knots = calibration.fit_isotonic(df, bins=50)
    got = df.select("p", calibration.apply_isotonic(F.col("p"), knots).alias("q")).collect()
    assert np.mean([abs(r["q"] - r["p"] ** 2) for r in got]) < 0.05
    xs, ys = knots
    assert all(r["q"] == pytest.approx(float(np.interp(r["p"], xs, ys)), abs=1e-9) for r in got[:200])
    assert calibration.fit_isotonic(df.limit(0)) == ([], [])


# ---------------------------------------------------------------- models, sampling, lexicon


def test_logistic_and_blend(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 1)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "u double, v double, y int")
    model = models.LogisticModel.fit(df, ["u", "v"], "y")
    assert model.weights[0] / model.sd[0] == pytest.approx(1.5, abs=0.15) and abs(model.weights[1]) < 0.15
    good = df.withColumn("good", F.when(F.col("y") == 1, 0.9).otherwise(0.1)).withColumn("flat", F.lit(0.5))
    assert models.blend_weights(good, ["flat", "good"]) == (0.0, 1.0) and len(models.simplex(3, 10)) == 66


def test_folds_and_trees(spark):
    rnd = random.Random(3)
    data = [(a, b, int(b % 2), float(b % 2) + rnd.random(), None if b % 5 == 0 else 1.0, a > 35) for a in range(40) for b in range(6)]
    df = spark.createDataFrame(data, "a long, b long, y int, f double, g double, hold boolean")
    scored, fitted = models.cv_scores(df, ["f", "g"], "p", folds=2, rounds=3, depth=2)
    got = scored.collect()
    assert len(got) == 240 and len(fitted) == 2 and sum((r["p"] > 0.5) == bool(r["y"]) for r in got) > 230
    assert models.importance_ranks(fitted[0], ["f", "g"], ["f"]) == {"f": 1}


def test_cv_options_experts_and_rebuilt_columns(spark):
    from tessera.operators import selftrain
    from tessera.plans import settings

    rnd = random.Random(5)
    data = [(a, 100 * a + b, int(b == 0), float(b == 0) + rnd.random() / 2, a % 7 == 0, "us" if a % 2 else "fr", 0.99 if b == 0 else 0.01, b == 0) for a in range(30) for b in range(3)]
    df = spark.createDataFrame(data, "a long, b long, y int, f double, hold boolean, country string, q double, sel boolean").cache()
    right = lambda rows, p: sum((r[p] > 0.5) == bool(r["y"]) for r in rows if r[p] is not None)
    scored, last = models.cv_scores(df, ["f"], "p", folds=2, seeds=2, max_left=20, final=True, rounds=2, depth=2)
    assert len(last) == 2 and right(scored.collect(), "p") > 80
    own, experts = models.expert_scores(df, ["f"], "e", ["us", "xx"], folds=2, rounds=2, depth=2)
    got = own.collect()
    assert set(experts) == {"us"} and len(got) == 90 and all((r["e"] is None) == (r["country"] == "fr") for r in got) and right(got, "e") > 35
    again = selftrain.leave_one_out(df, ["f"], settings.DEFAULTS, ["fr"], rounds=2, depth=2).collect()
    assert {r["country"] for r in again} == {"fr"} and right(again, "p") > 35
    rec = spark.createDataFrame([(a, 1, "p", ["t"], ["s"], "s", [5], f"n{a}") for a in range(30)] + [(100 * a + b, 2, "p", ["t"], ["s"], "s", [5], f"n{a}") for a in range(1, 30) for b in range(3)],
                                "id long, src int, pool string, nt array<string>, at array<string>, a_sorted string, nu array<long>, sorted string")
    first = df.filter("a > 0").select("a", "b", "f")
    rebuilt = groups.rebuild_last(first, df.select("a", "b", F.col("q").alias("p1")), rec, 2)
    assert len(rebuilt.columns) == 2 + 1 + 1 + 8 + 13 + 1 and rebuilt.count() == 87
    with pytest.raises(ValueError):
        groups.rebuild_last(first, df.select("a", "b", F.col("q").alias("p1")), rec, 2, ["f"])


def test_densities_and_best_options(spark):
    kept = spark.createDataFrame([("us", 1)] * 10 + [("us", 2)] * 45 + [("fr", 1)] * 10 + [("fr", 3)] * 40, "pool string, src int")
    gaps = sampling.density_gaps(kept, {"us": 4.5, "fr": 4.5}, least=5)
    assert set(gaps) == {"fr"} and gaps["fr"] == pytest.approx(1 - 4 / 4.5) and sampling.density_gaps(kept, {"us": 4.5, "fr": 4.5}) == {}
    with pytest.raises(ValueError):
        sampling.check_density(kept, {"fr": 4.5}, least=5)
    scores = {"soft": {"*": 0.9, "us": 0.8, "fr": 0.95}, "hard:0.1": {"*": 0.85, "us": 0.9}}
    assert evaluation.best_by_group(scores) == ("soft", {"fr": "soft", "us": "hard:0.1"})
    left = spark.createDataFrame([(1, "us"), (2, "fr")], "a long, country string")
    pair = lambda *ab: spark.createDataFrame(list(ab), "a long, b long")
    assert evaluation.tune_exclusivity(["x", "y"], {"x": pair((1, 5)), "y": pair((2, 6), (1, 7))}.get, left, pair((1, 5), (2, 6))) == ("x", {"fr": "y", "us": "x"})


def test_pools(spark):
    train, test = {"us": (2000, 8000), "india": (500, 2000)}, {"us": (1000, 4500), "france": (400, 1800)}
    extras = sampling.extra_pools(train, test)
    assert extras == [{"name": "us_fr", "from": "us", "like": "france"}]
    plan = {p.name: p for p in sampling.plan_pools(train, test, extras)}
    assert plan["us"].keep == pytest.approx(4500 / 8000) and plan["us"].drop == pytest.approx(1 - 4 / 4.5) and plan["india"].drop == 0.19
    left = spark.range(2000).select("id", F.lit(1).alias("src"), F.lit("us").alias("country"))
    right = spark.range(8000).select((F.col("id") + 10_000).alias("id"), (2 + F.col("id") % 2).cast("int").alias("src"), F.lit("us").alias("country"))
    truth = right.filter("id < 17000").select(((F.col("id") - 10_000) % 2000).alias("a"), F.col("id").alias("b"))
    got = sampling.sample_pools(left.unionByName(right), truth, sampling.plan_pools({"us": train["us"]}, test, extras)).cache()
    n = {(r["pool"], r["side"]): r["count"] for r in got.groupBy("pool", (F.col("src") == 1).alias("side")).count().collect()}
    for pool, density in (("us", 4.5), ("us_fr", 4.5)):
        assert n[pool, False] / n[pool, True] == pytest.approx(density, rel=0.1)
    owners = got.filter("src > 1").join(truth, F.col("id") == F.col("b")).join(got.filter("src = 1").select(F.col("id").alias("a"), F.col("pool").alias("p1")), "a")
    assert owners.filter("pool <> p1").count() == 0 and got.groupBy("id").count().filter("count > 1").count() == 0
    assert 0 < sampling.sample_share(left.unionByName(right), truth, 0.3, 0.2).count() < 5000 and sampling.sample_small(left.unionByName(right), truth, 100).filter("src = 1").count() < 200


def test_lexicon(spark):
    data = [("Shri Balaji Traders", "Elm Rd, Pune", "India", "श्री बालाजी ट्रेडर्स", "Elm Rd, पुणे", "India")] * 4 + [("Acme Center", "5 Big Lane, X", "US", "Acme Centre", "5 Bigg Lane, X", "US")] * 9
    df = spark.createDataFrame([(i, 100 + i, *r) for i, r in enumerate(data)], "a long, b long, name_a string, address_a string, country_a string, name_b string, address_b string, country_b string")
    found = lexicon.learn(df, least=4)
    assert found["name_indic"]["बालाजी"] == "balaji" and found["addr_indic"] == {"पुणे": "pune"}
    assert found["name_map"] == {"us": {"centre": "center"}} and found["addr_map"] == {"us": {"bigg": "big"}}
    chain = spark.createDataFrame([("s", ["ab"], ["ac"])] * 3 + [("s", ["ac"], ["ad"])] * 3, "scope string, ta array<string>, tb array<string>")
    assert rows(lexicon.swaps(chain, 2), "word", "target") == [("ac", "ab")]


# ---------------------------------------------------------------- evaluation, sources


def test_metric_and_errors(spark):
    left = spark.createDataFrame([(i, "us") for i in range(4)], "a long, country string")
    truth = spark.createDataFrame([(0, 10), (0, 11), (1, 12)], "a long, b long")
    kept = spark.createDataFrame([(0, 10, True), (0, 13, False), (1, 12, False), (2, 14, True)], "a long, b long, sel boolean")
    counts = evaluation.list_counts(left, kept.filter("sel").select("a", "b"), truth)
    want = {0: 1.25 / 1.5, 1: 0.0, 2: 0.0, 3: 1.0}
    assert {r["grp"]: r["f05"] for r in evaluation.macro_f05(counts, "country").collect()}["*"] == pytest.approx(sum(want.values()) / 4)
    raw = kept.select("a", "b").union(spark.createDataFrame([(0, 15)], "a long, b long"))
    errors = evaluation.error_types(raw, kept, truth)
    assert rows(errors, "a", "b", "error") == [(0, 11, "block_miss"), (1, 12, "dropped_true"), (2, 14, "singleton_fp")]
    cost = {r["error"]: r["f05_lost"] for r in evaluation.error_costs(counts, errors).collect()}
    assert cost["singleton_fp"] == pytest.approx(0.25) and cost["dropped_true"] == pytest.approx(0.25)
    best, top = evaluation.tune(lambda s: -abs(s["x"] - 2) - abs(s["y"] - 1), {"y": 0}, {"x": [0, 1, 2], "y": [0, 1]})
    assert best == {"x": 2, "y": 1} and top == 0
    assert evaluation.stratified(spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(50)], "i long, g string"), "g", 10, "i").groupBy("g").count().orderBy("g").collect()[0]["count"] == 3
    lists = evaluation.expected_lists(spark.createDataFrame([(1, 1, 0.9, True), (1, 2, 0.2, False)], "a long, b long, q double, sel boolean")).first()
    assert lists["expected"] == pytest.approx(brute([0.9, 0.2], 1))


def test_drift(spark):
    one = spark.createDataFrame([("us", float(i)) for i in range(10)], "country string, v double")
    two = spark.createDataFrame([("us", float(i + 5)) for i in range(10)] + [("fr", 1.0), ("fr", None)], "country string, v double")
    got = {r["country"]: r for r in evaluation.shift_report(one, two, ["v"]).collect()}
    assert got["us"]["ks"] == pytest.approx(0.5) and got["fr"]["test_null"] == 0.5 and got["fr"]["train_p"][2] == 4.5


def test_files(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a NA\t\tUS\nS1-2\tNA\t x \tnull\n')
    got = tables.read_source(spark, str(path), 1).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("S1-1", 1, '"a NA', "", "US"), ("S1-2", 1, "NA", " x ", "null")]
    left = spark.createDataFrame([("S1-1",), ("S1-2",)], "a string")
    chosen = spark.createDataFrame([("S1-1", "S2-5", 0.4, 0.5, True), ("S1-1", "S3-2", 0.9, 0.5, True), ("S1-1", "S2-9", 0.1, 0.1, False)], "a string, b string, p double, qe double, sel boolean")
    tables.write_outputs(left, chosen, str(tmp_path / "out"))
    matched = tables.read_tsv(spark, str(tmp_path / "out/matching_results.tsv"), tables.TRUTH)
    assert rows(matched, *tables.TRUTH.names) == [("S1-1", "S2-5,S3-2"), ("S1-2", "")]
    assert rows(tables.read_truth(spark, str(tmp_path / "out/matching_results.tsv")), "a", "b") == [("S1-1", "S2-5"), ("S1-1", "S3-2")]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    assert evaluation.validate_lists(matched, ids("S1-1", "S1-2"), ids("S2-5", "S3-2")).count() == 0
    bad = spark.createDataFrame([("S1-1", "S2-5,S2-5,S1-2"), ("S1-1", ""), ("S1-9", "S2-77")], "source1_entity_id string, matched_entity_ids string")
    found = {r["problem"] for r in evaluation.validate_lists(bad, ids("S1-1", "S1-2"), ids("S2-5"), matched).collect()}
    assert found == {"duplicate_row", "missing_source", "extra_source", "duplicate_match", "bad_prefix", "unknown_match", "not_candidate"}
    store = tables.Artifacts(spark, str(tmp_path / "new"), [str(tmp_path / "old")])
    tables.Artifacts(spark, str(tmp_path / "old")).save("t", left)
    assert store.exists("t") and not store.exists("u") and store.load("t").count() == 2
    with pytest.raises(FileNotFoundError):
        store.load("u")


# ---------------------------------------------------------------- settings, refits


def test_settings():
    from tessera.plans import settings

    got = settings.load("recall", {"seed": "7", "lam_grid": "[1.5]", "text_off": "ms"})
    assert (got["k1"], got["seed"], got["lam_grid"], got["text_off"]) == (150, 7, [1.5], "ms") and settings.profile_for(8, 64) == "recall"
    with pytest.raises(KeyError):
        settings.load("default", {"bogus": "1"})
    assert settings.guard(got, 0, 10, lambda: 399 * 60) and not settings.guard(got, 0, 10, lambda: 401 * 60)


def test_refits(spark):
    from tessera.operators import selftrain
    from tessera.plans import settings

    rnd = random.Random(4)
    data = [(a, 1000 * a + k, float(k == 0) + rnd.random() / 2, int(k == 0), 0.99 if k == 0 else 0.01, k == 0) for a in range(30) for k in range(3)]
    df = spark.createDataFrame(data, "a long, b long, f double, y int, q double, sel boolean")
    again = selftrain.refit(df.select("f", "y"), df.drop("y"), ["f"], settings.DEFAULTS, rounds=2, depth=2).collect()
    assert len(again) == 90 and sum((r["p"] > 0.5) == r["sel"] for r in again) > 80
    left = spark.range(32).select(F.col("id").alias("a"), (F.col("id") == 31).alias("hold"))
    features = df.groupBy("a").agg(F.max("q").alias("q1"), F.count("*").alias("n_cand"))
    p, _ = selftrain.has_match(features, df.filter("y = 1").select("a", "b"), left, ["q1", "n_cand"], folds=2, rounds=2, depth=2)
    got = {r["a"]: r["p_has"] for r in p.collect()}
    assert len(got) == 32 and got[31] == -1.0 and got[0] > 0.5
    chosen = df.filter("sel")
    assert not selftrain.drifted(chosen, chosen, left) and selftrain.drifted(chosen, chosen.limit(5), left)
    best, top = selftrain.tune_group(df.select("a", "b", "q"), left.select("a"), df.filter("y = 1").select("a", "b"), settings.DEFAULTS | {"delta_grid": [0.0], "lam_grid": [0.8], "min_p_grid": []})
    assert best["excl"] in ("hard:0.0", "soft") and top == pytest.approx(1.0)


def test_linkage_uses_the_settings(spark, tmp_path):
    import inspect

    from tessera.operators import blocking
    from tessera.plans import linkage, settings

    page = lambda i, host, title: (i, f"https://{host}/p{i}", f'<html lang="en"><title>{title}</title></html>')
    rows = [page(3 * i, "shop.example", "red garden lamps") for i in range(6)] + [page(3 * i + 1, "shop.example", "red garden lamps") for i in range(40)]
    rows += [page(300 + 3 * i + 1, f"other{i}.example", f"blue boats number{i}") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = blocking.candidates(linkage.encoded(spark, str(tmp_path)), linkage.HOW)
    assert got.filter("a = 15 AND b < 300").count() == 40
    run = {n: p.default for n, p in inspect.signature(linkage.run).parameters.items()}
    assert (run["folds"], run["k2"]) == (settings.DEFAULTS["n_folds"], settings.DEFAULTS["k2"])


def test_candidates_in_blocks(spark, monkeypatch):
    """Candidates are those of the join of every pair, over many small blocks, with copies, records without features and ties;
    no row of a pair is shuffled before it is among the best."""

    from tessera.operators import scoring

    monkeypatch.setattr(scoring, "CELLS", 50)
    rng, rows = random.Random(3), []
    words = [f"{c}{d}{e}" for c in "abc" for d in "abc" for e in "ab"]
    for i in range(160):
        name = rng.sample(words, rng.randint(0, 4)) if i % 8 else ["aaa", "bba"]
        rest, nu = sorted(set(rng.choices(words, k=rng.randint(0, 6)))), sorted(set(rng.choices("123456", k=rng.randint(0, 2))))
        rows.append((i, rng.choice([1, 2, 3]), rng.choice("xy"), " ".join(name), "".join(name), sorted(name), rest, nu))
    rec = spark.createDataFrame(rows, "id long, src int, pool string, core string, concat string, nt array<string>, at array<string>, nu array<string>").repartition(5)
    sizes = rec.groupBy("pool").agg(F.count_if(F.col("src") > 1).alias("n_right"))
    for how in (blocking.Blocking(k1=3, rev_k=2, prefix_m=9), blocking.Blocking(k1=2, rev_k=1, caps=None, prefix_m=None)):
        feats = blocking.features(rec)
        every = blocking.similar_pairs(blocking.vectors(feats, blocking.retrieval_weights(feats, sizes, how)), how.prefix_m)
        want = {tuple(r) for r in blocking.union_candidates(every, how.k1, how.rev_k).select("a", "b", "pool", "score", "fwd_rank").collect()}
        got = blocking.candidates(rec, how)
        assert {tuple(r) for r in got.select("a", "b", "pool", "score", "fwd_rank").collect()} == want and want
        assert "sum(" not in got._jdf.queryExecution().executedPlan().toString()
