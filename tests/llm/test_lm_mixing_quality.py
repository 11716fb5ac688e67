"""Scores, mixing and quality rules against plain Python."""

import math
import re
from collections import Counter

import pytest

from tessera.llm import lm, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scores(rows):
    docs = [WORD.findall(t or "") for _, t in rows]
    one, two = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:], strict=False))
    n = sum(one.values())
    out = []
    for (i, _), d in zip(rows, docs, strict=True):
        own1, own2 = Counter(d), Counter(zip(d, d[1:], strict=False))
        total, back = 0.0, 0
        for k, w in enumerate(d):
            if k and two[d[k - 1], w] - own2[d[k - 1], w] > 0:
                total += math.log((two[d[k - 1], w] - own2[d[k - 1], w]) / (one[d[k - 1]] - own1[d[k - 1]]))
            else:
                back += 1
                total += math.log(max(one[w] - own1[w], 1) / max(n - len(d), 1)) + (math.log(0.4) if k else 0)
        out.append((i, len(d), back, round(total, 8)))
    return sorted(out, key=str)


def test_scores(spark):
    rows = [(1, "a b c a b"), (2, "a b d"), (600, "b c  b\nc"), (None, "a b c"), (None, "z"), (7, None), (8, ""), (-4, " "), (2, "a b d"), (9, "the cat " * 3000)]
    got = lm.score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, counts int").repartition(3), order=2).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_backoff"], round(r["log_score"], 8)) for r in got), key=str) == scores(rows)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert alone["n_backoff"] == 2 and alone["log_score"] == pytest.approx(math.log(0.4))


@pytest.mark.parametrize("order", [3, 4])
def test_scores_of_more_words(spark, order):
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "x b c b"), (4, "a b z"), (5, None), (6, "q"), (700, "x b c d a b c d")]
    docs = {i: (t or "").split() for i, t in rows}
    n = {i: Counter(tuple(d[k - m : k + 1]) for m in range(order) for k in range(m, len(d))) for i, d in docs.items()}

    def one(i: int) -> tuple:
        others = sum((c for j, c in n.items() if j != i), Counter())
        size, total, back = max(sum(len(d) for j, d in docs.items() if j != i), 1), 0.0, 0
        for k, w in enumerate(docs[i]):
            longest = min(k, order - 1)
            m = next((m for m in range(longest, 0, -1) if others[tuple(docs[i][k - m : k + 1])]), 0)
            gram = tuple(docs[i][k - m : k + 1])
            total += math.log(others[gram] / others[gram[:-1]] if m else max(others[(w,)], 1) / size) + (longest - m) * math.log(0.4)
            back += m < order - 1
        return (i, len(docs[i]), back, round(total, 8))

    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_backoff"], round(r["log_score"], 8)) for r in got) == [one(i) for i, _ in rows]


DOCS = "doc_id long, text string, lang string, source string"


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 100), ("web", "de", "c", 100), ("books", "en", "d", 1000)], "domain string, language string, source string, tokens long")
    from pyspark.sql import functions as F

    plan = mixing.budgets(leaves, {"domain": {"web": 1, "books": 1}}, F.lit(200.0), 1)
    got = {r["source"]: r["budget"] for r in plan.collect()}
    assert got == {"a": 10, "b": 40, "c": 50, "d": 100}  # a's shortage of 15 stays with b
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, {}, F.lit(600.0), 1).collect()}
    assert got == {"a": 10, "b": 100, "c": 100, "d": 390}  # web is full, the rest is for books
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, {}, F.lit(1e9), 2).collect()}
    assert got == {"a": 20, "b": 200, "c": 200, "d": 2000}


def test_prefixes_and_epochs(spark):
    rows = [(i, "w " * (1 + i % 5), "en" if i % 3 else None, f"src{i % 4}" if i % 7 else None) for i in range(300)] + [(1, None, "en", "src1"), (None, "x y", "en", "src1"), (5, "w", "en", "src1"), (5, "w", "en", "src1")]
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", epoch int")
    all_tokens = sum(len((t or "").split()) for _, t, *_ in rows)
    for share, epochs in ((0.3, 1), (1.0, 1), (1.0, 3), (5.0, 2)):
        out = mixing.mix(df, mixing.WEIGHTS, share=share, max_epochs=epochs, seed=3).collect()
        again = mixing.mix(df.repartition(7), mixing.WEIGHTS, share=share, max_epochs=epochs, seed=3).collect()
        assert Counter(map(str, out)) == Counter(map(str, again))
        taken = sum(r["n_tokens"] for r in out)
        leaves = len({(r["domain"], r["lang"], r["source"]) for r in out})
        target = min(share, epochs) * all_tokens
        assert target - 1e-6 <= taken <= target + 5 * leaves
        each = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["epoch"]) for r in out)
        copies = Counter((i, t, a, s) for i, t, a, s in rows)
        assert all(n <= copies[k[:4]] for k, n in each.items()) and max(r["epoch"] for r in out) <= epochs
    assert mixing.mix(df.limit(0), mixing.WEIGHTS).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "en", "s")], DOCS), {}).count() == 0


def counts(text):
    ws = WORD.findall(text or "")
    windows = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    n = Counter(windows)
    covered = {j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 5)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(covered))


def test_quality_counts(spark):
    clean = "the cat of the house and a dog in that street was on it for to be with as are " * 3
    rows = [(1, "a b c d e f a b c d e g", "en"), (2, None, "en"), (3, "", None), (4, clean, "en"), (5, "x\ny\nx\n\n \n\n" + "é中😀 #*$ " * 30, "xx"), (6, "one two three four", "de"),
            (7, "a a a a a a a a a a a", "fr"), (7, "a a a a a a a a a a a", "fr"), (None, "|".join("ab") + "\x0b\x0c z", "es"), (8, "w%d " * 50 % tuple(range(50)) * 2, "en"), (9, " ".join(f"q{i}" for i in range(20_000)) + " q0 q1 q2 q3 q4", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, kept int")
    got = quality.judge(df).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(i), *counts(t)) for i, t, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(df.limit(0)).count() == 0


def test_divergence_finds_junk_among_clean_documents(spark):
    import random

    rnd = random.Random(2)
    common = quality.COMMON["en"]
    sentence = lambda: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 9))) for _ in range(200))
    rows = [(i, sentence(), "en") for i in range(60)] + [(100, " ".join(w + "###%" for w in sentence().split()), "en"), (101, " ".join("0123456789"[rnd.randint(0, 9) :] for _ in range(300)), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not got[100] and not got[101]
    plan = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fitted_limit_finds_broken_prose(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    common = quality.COMMON["en"]
    words = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 9))) for _ in range(n)]
    broken = lambda n: " | ".join(w for w in words(2 * n) if w not in common or rnd.random() < 0.15)
    rows = [(i, " ".join(words(rnd.randint(60, 400))), "en") for i in range(200)] + [(1000 + i, broken(110), "en") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    loose = tight = quality.judge(df)
    kept = {r["doc_id"] for r in tight.filter("kept").collect()}
    far = {r["doc_id"]: r["word_distance"] for r in loose.collect()}
    assert all(i in kept for i in range(200)) and not any(i >= 1000 for i in kept), [far[i] for i in range(1000, 1005)]
    labels = df.select("doc_id", F.when(F.col("doc_id") < 1000, 1).otherwise(0).alias("quality"))
    assert 0 <= quality.fit_base(loose, labels) <= quality.MAX_WORD_DISTANCE and quality.fit_base(loose, labels.limit(0)) == 0
