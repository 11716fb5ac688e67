"""Substring, line and near-duplicate operators against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import lines, minhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def corpus(seed: int, n: int = 120) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 12, 13, 14, 60, 200]))]
        text = "".join(w + rnd.choice([" ", "  ", "\n", "\t", "\n\n"]) for w in words)
        if rnd.random() < 0.3:
            at = rnd.randint(0, len(text))
            text = text[:at] + " " + passage + "\n" + text[at:]
        if rows and rnd.random() < 0.2:
            text = rnd.choice(rows)[1] or ""
        if rows and rnd.random() < 0.2:
            text = (rnd.choice(rows)[1] or "").replace("w1 ", "w2 ")
        rows.append((rnd.randint(-500, 2000) if rnd.random() < 0.9 else i, text))
    return list({r[0]: r for r in rows}.values())


def removed(rows, width):
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - width + 1):
            w = tuple(ws[k : k + width])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = {j for k in range(len(ws) - width + 1) if first[tuple(ws[k : k + width])] < i for j in range(k, k + width)}
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize(("seed", "width"), [(1, 13), (2, 13), (3, 7), (4, 9)])
def test_substrings(spark, seed, width):
    rows = [*corpus(seed), (5000, None), (5001, ""), (5002, " \n\t "), (5003, "x" * 70_000 + " " + "a b " * 5000)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5), width).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == removed(rows, width) and len(got) == len(rows)


def test_substrings_of_null_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(None, text), (None, text), (7, text), (7, text), (3, "short"), (9, text + " end")]
    got = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in got) == [(3, 0), (7, 0), (7, 0), (9, 20), (99, 20), (99, 20)]
    assert substring.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        substring.dedup_substrings(spark.createDataFrame([], SCHEMA), 6)


def without_lines(rows, size):
    seen, out = set(), []
    for i, t in sorted(rows):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - size + 1):
            w = tuple(ls[k : k + size])
            if any(WORD.search(x) for x in w):
                if w in seen:
                    gone |= set(range(k, k + size))
                seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines(spark, seed):
    rnd = random.Random(seed)
    pool = ["alpha", "beta", "", " ", "gamma é", "x" * 3000]
    rows = [(rnd.randint(-2000, 9000), "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for _ in range(150)]
    rows = [*dict(rows).items(), (90_000, None), (90_001, ""), (90_002, "\n\n\n\n"), (90_003, "same\n" * 8)]
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got] == without_lines(rows, 3)


def test_lines_keep_other_columns(spark):
    rows = [(2, "a\nb\nc", "x", 5, 1), (1, "a\nb\nc", "y", 5, 2), (None, "a\nb\nc\nd", None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, g string, n_chars long, n_removed int")
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert (got[1]["text"], got[2]["text"], got[None]["text"]) == ("a\nb\nc", "", "d") and got[2]["g"] == "x" and got[None]["n_removed"] == 3
    staged = {r["doc_id"]: r["n_chars"] for r in lines.stage(spark, df.drop("n_removed"), "").collect()}
    assert staged == {1: 5, 2: 0, None: 1}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def linked(rows, percent=75):
    sets = {}
    for i, t in rows:
        ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for k in s:
            holders[k].append(i)
    pairs = {(x, y) for h in holders.values() for x in h for y in h if x < y}
    for x, y in pairs:
        if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            a, b = root(x), root(y)
            label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_corpus(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 400))
    rows = []
    for size in (1, 1, 2, 3, 5, 40):
        base = [word() for _ in range(rnd.choice([4, 30, 120, 300]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 14))):
                own[rnd.randrange(len(own))] = word()
            rows.append(own)
    chain = [word() for _ in range(100)]  # each is near the next one only
    for k in range(12):
        rows.append([*chain[:], f"k{k}"])
        for j in range(2):
            chain[(k * 9 + j * 4) % 100] = word()
    shared = [word() for _ in range(40)]
    rows += [[*shared, *(word() for _ in range(40))] for _ in range(30)]
    rnd.shuffle(rows)
    out = [(i * 3 - 20, rnd.choice([" ", "\n"]).join(w.upper() if rnd.random() < 0.1 else w for w in r)) for i, r in enumerate(rows)]
    return [*out, (9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE two"), (9005, "one"), (9006, "É two"), (9007, "é two")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(spark, seed):
    rows = near_corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(rows) and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_large_group_of_half_similar_documents(spark):
    """A hub that all copies are near to, while most copies are not near each other; blocks smaller than the group."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        for k in range(5):
            own[(i * 7 + k * 37 + rnd.randint(0, 20)) % 200] = f"x{i}.{k}"
        rows.append((1000 - i, " ".join(own)))
    size, minhash.BLOCK = minhash.BLOCK, 32
    try:
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        minhash.BLOCK = size
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(rows)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (None, text), (4, text), (4, text), (2, text + " end"), (8, "other words that are no copy of these")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 99, r["component_id"] or 0, r["kept"]) for r in got) == [(2, 2, True), (4, 2, False), (4, 2, False), (8, 8, True), (99, 0, True), (99, 0, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.stage(spark, spark.createDataFrame(rows, SCHEMA).withColumn("label", F.lit(1)), "")
    assert kept.columns == ["doc_id", "text", "label"] and sorted(r["doc_id"] or 99 for r in kept.collect()) == [2, 8, 99, 99]
    with pytest.raises(ValueError):
        minhash.near_duplicates(empty, 50)


def test_the_index_meets_every_pair_within_its_distance():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (400, minhash.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(minhash.SYMBOLS, 2 * minhash.CHUNKS - 1, replace=False)] ^= 1
    assert (minhash.index_keys(a) == minhash.index_keys(b)).any(axis=1).all()


def test_the_bitmap_bound_never_rules_out_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, n // 7) + 1))
        other = np.concatenate([one[drop:], rng.integers(0, 1 << 63, drop // 2, dtype=np.uint64)])
        common = len(np.intersect1d(one, other))
        if 100 * common >= 75 * (len(one) + len(other) - common):
            bits = [np.frombuffer(minhash.bitmap(np.unique(s)), np.uint8) for s in (one, other)]
            assert minhash._may_link(bits[0], len(one), bits[1][None, :], np.array([len(other)])).all()
