"""Registered queries that SQL cannot express, against plain Python over the smallest tables."""

import math
from collections import Counter

import pytest

from tessera.operators import fellegi
from tessera.plans import catalog
from tessera.plans import documents as D

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    records = {r["id"]: r for r in D.records(spark, SMALL).collect()}
    return records, D.cands(spark, SMALL).collect()


def jaro_winkler(a: str, b: str) -> float:
    """By the definition: marks on both sides, half transpositions, a prefix that always counts."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    marked, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not marked[j] and b[j] == c), None)
        if j is not None:
            marked[j] = True
            left.append(c)
    right = [c for c, m in zip(b, marked, strict=True) if m]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def test_jaro_winkler_half(spark, sides):
    records, cands = sides
    got = {(r["a"], r["b"]): r for r in catalog.QUERIES["jaro_winkler_half"](spark, SMALL).collect()}
    assert set(got) == {(c["a"], c["b"]) for c in cands}
    best = lambda w, ws: max(jaro_winkler(w, o) for o in ws)
    for (a, b), r in list(got.items())[:60]:
        x, y = records[a], records[b]
        assert r["jw"] == pytest.approx(jaro_winkler(x["core"], y["core"]))
        if x["nt"] and y["nt"]:
            mean = lambda p, q: sum(best(w, q) for w in p) / len(p)
            assert r["monge_elkan"] == pytest.approx((mean(x["nt"], y["nt"]) + mean(y["nt"], x["nt"])) / 2)
        left, right = x["core"].split()[:40], y["core"].split()[:40]
        if left and right:
            share = sum(len(w) * s for w in left if (s := best(w, right)) >= 0.9) / sum(map(len, left))
            assert r["soft_a"] == pytest.approx(share)


def test_group_agreement(spark, sides):
    records, cands = sides
    got = {(r["a"], r["b"]): r for r in catalog.QUERIES["group_agreement"](spark, SMALL).collect()}
    assert len(got) == len(cands)
    n_pool = Counter(r["pool"] for r in records.values())
    df = {f: Counter((r["pool"], t) for r in records.values() for t in r[f]) for f in ("nt", "at")}
    idf = lambda f, pool, t: math.log((n_pool[pool] + 1) / (df[f][pool, t] + 1)) + 1

    def cosine(f, x, z):
        mass = lambda ts, pool: sum(idf(f, pool, t) ** 2 for t in ts)
        sa, sb = mass(x[f], x["pool"]), mass(z[f], z["pool"])
        return mass(set(x[f]) & set(z[f]), x["pool"]) / math.sqrt(sa * sb) if sa and sb else 0.0

    by: dict = {}
    for c in cands:
        by.setdefault(c["a"], []).append((-c["score"], c["b"]))
    for c in cands:
        ranked = [(b, -s) for s, b in sorted(by[c["a"]]) if -s >= 0.1]
        others = [(b, p) for b, p in ranked[:7] if b != c["b"]][:6]
        r = got[c["a"], c["b"]]
        assert r["g_n"] == len(others)
        if not others:
            assert r["g_name_max"] is None and r["g_cons_num"] is None
            continue
        x, total = records[c["b"]], sum(p for _, p in others)
        for name, f in (("name", "nt"), ("addr", "at")):
            values = [(cosine(f, x, records[b]), p) for b, p in others]
            assert r[f"g_{name}_max"] == pytest.approx(max(v for v, _ in values)) and r[f"g_{name}_wmean"] == pytest.approx(sum(v * p for v, p in values) / total)
        agree = sum(p for b, p in others if set(x["nu"]) & set(records[b]["nu"])) / total
        conflict = sum(p for b, p in others if x["nu"] and records[b]["nu"] and not set(x["nu"]) & set(records[b]["nu"])) / total
        assert r["g_num_agree"] == pytest.approx(agree) and r["g_num_conflict"] == pytest.approx(conflict)


def test_fs_em(spark):
    compared = fellegi.patterns(catalog._compared(spark, SMALL)).collect()
    start = fellegi.supervised(catalog._compared(spark, SMALL))
    names = list(fellegi.COMPARISONS)
    counts = Counter(tuple(r[f"lv_{n}"] for n in names) for r in compared)
    m, u = ({n: list(start[side][n]) for n in names} for side in "mu")
    lam = max(start["lam"], fellegi.LEAST)
    total, last = sum(counts.values()), -math.inf

    def scaled(v):
        v = [min(max(x / max(sum(v), 1e-300), fellegi.LEAST), 1 - fellegi.LEAST) for x in v]
        return [x / sum(v) for x in v]

    for _ in range(200):
        now, on = 0.0, {}
        for p, n in counts.items():
            yes = lam * math.prod(m[c][x] for c, x in zip(names, p, strict=True))
            no = (1 - lam) * math.prod(u[c][x] for c, x in zip(names, p, strict=True))
            now += n * math.log(yes + no) / total
            on[p] = n * yes / (yes + no)
        lam = min(max(sum(on.values()) / total, fellegi.LEAST), 1 - fellegi.LEAST)
        for k, c in enumerate(names):
            levels = range(fellegi.COMPARISONS[c])
            m[c] = scaled([sum(w for p, w in on.items() if p[k] == x) for x in levels])
            u[c] = scaled([sum(n - on[p] for p, n in counts.items() if p[k] == x) for x in levels])
        if abs(now - last) < 1e-7:
            break
        last = now
    fit = {"m": m, "u": u, "lam": lam}
    fit = start if fellegi.rejected(fit) else fit
    want = {(r["a"], r["b"]): sum(math.log(fit["m"][n][r[f"lv_{n}"]] / fit["u"][n][r[f"lv_{n}"]]) for n in names) for r in compared}
    got = {(r["a"], r["b"]): r["fs_llr"] for r in catalog.QUERIES["fs_em"](spark, SMALL).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_pair_features(spark):
    """Columns of pages as records that plain Python can say from the parsed records alone."""
    from tessera.plans import linkage

    records = {r["id"]: r for r in linkage.encoded(spark, SMALL).collect()}
    rows = catalog.QUERIES["pair_features"](spark, SMALL).collect()
    assert rows
    share = lambda p, q: len(set(p) & set(q)) / len(set(p) | set(q)) if set(p) | set(q) else None
    grams = lambda s: Counter(("^" + s + "$")[i : i + 3] for i in range(len(s)))
    dice = lambda p, q: 2 * (grams(p) & grams(q)).total() / (len(p) + len(q)) if p and q else 0.0
    for r in rows[:: max(1, len(rows) // 200)]:
        x, y = records[r["a"]], records[r["b"]]
        assert x["pool"] == y["pool"] and x["src"] == 1 and y["src"] == r["src_b"]
        assert r["jw_core"] == pytest.approx(jaro_winkler(x["core"], y["core"])) and r["jw_addr"] == pytest.approx(jaro_winkler(x["a_sorted"], y["a_sorted"]))
        assert r["tri_concat"] == pytest.approx(dice(x["concat"], y["concat"]))
        assert r["tri_addr"] == (pytest.approx(dice(x["a_sorted"], y["a_sorted"])) if x["a_sorted"] and y["a_sorted"] else None)
        for name, f in (("ntok_jacc", "nt"), ("phon_jacc", "phon"), ("atok_jacc", "at")):
            assert r[name] == (pytest.approx(share(x[f], y[f])) if share(x[f], y[f]) is not None else None)
        assert (r["num_shared"], r["num_a"], r["num_b"]) == (len(set(x["nu"]) & set(y["nu"])), len(x["nu"]), len(y["nu"])) and (r["ntok_a"], r["ntok_b"]) == (len(x["nt"]), len(y["nt"]))
        assert r["gw_a_only"] == len(set(x["gw"]) - set(y["gw"])) and r["name_freq_a"] == pytest.approx(math.log1p(x["name_freq"]))
