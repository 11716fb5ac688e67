"""Pair models: the cheap re-ranker, gradient-boosted trees with folds grouped by left record, blends of scores."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import rank_desc

DESIGN = ["jw", "ncos", "acos", "nsh", "ncf", "same", "diff", "score", "fr", "rr", "ga", "gb", "nb", "jw_acos", "ncos_acos", "score2"]


def fold_of(key: str | Column, k: int, seed: int) -> Column:
    """Fold of a left record, from a seeded hash: all its pairs share it."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def uniform(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, however rows are partitioned."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def holdout(left: DataFrame, share: float, seed: int, countries: Sequence[str] = ()) -> DataFrame:
    """Adds hold: a seeded share of the left records, and all of the named countries."""
    return left.withColumn("hold", (uniform("a", seed) < share) | F.col("country").isin(list(countries)))


def rerank_design() -> dict[str, Column]:
    """The re-ranker's sixteen inputs over the cheap columns; null counts as 0."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    jw, ncos, acos, score = c("jw_sorted"), c("ntok_cos"), c("atok_cos"), c("ret_score")
    flag = lambda x: x.cast("double")
    values = [jw, ncos, acos, F.least(c("num_shared"), F.lit(3.0)), c("num_conflict"), flag(c("state_cat") == 1), flag(c("state_cat") == 3), score,
              F.log1p(c("fwd_rank")), F.log1p(c("rev_rank")), c("gap_a"), c("gap_b"), F.log1p(c("n_cand_b")), jw * acos, ncos * acos, score * score]
    return dict(zip(DESIGN, values, strict=True))


class LogisticModel:
    """Standardised, L2-penalised logistic regression, fitted by Newton steps.

    Each step is one aggregation of the gradient and the Hessian (a few hundred sums), so only these reach the driver.
    """

    def __init__(self, columns: Sequence[str], mean: np.ndarray, sd: np.ndarray, weights: np.ndarray):
        self.columns, self.mean, self.sd, self.weights = list(columns), mean, sd, weights

    @classmethod
    def fit(cls, rows: DataFrame, columns: Sequence[str], y: str, l2: float = 1e-4, iterations: int = 30) -> LogisticModel:
        columns = list(columns)
        value = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
        stats = rows.agg(F.count("*").alias("n"), *(f(value(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        n = stats["n"]
        k = len(columns) + 1
        if not n:
            return cls(columns, np.zeros(k - 1), np.ones(k - 1), np.zeros(k))
        mean, sd = (np.array([stats[f"{s}{i}"] for i in range(k - 1)], float) for s in "ms")
        model = cls(columns, mean, sd + 1e-6, np.zeros(k))
        for _ in range(iterations):
            x = F.array(*((value(c) - float(m)) / float(s) for c, m, s in zip(columns, model.mean, model.sd, strict=True)), F.lit(1.0))
            step = rows.select(x.alias("x"), F.col(y).cast("double").alias("y"), model.probability().alias("p"))
            terms = [F.sum((F.col("p") - F.col("y")) * F.get("x", F.lit(i))).alias(f"g{i}") for i in range(k)]
            terms += [F.sum(F.col("p") * (1 - F.col("p")) * F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
            got = step.agg(*terms).first()
            gradient = np.array([got[f"g{i}"] for i in range(k)]) / n + l2 * model.weights
            hessian = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n + l2 * np.eye(k)
            move = np.linalg.solve(hessian, gradient)
            model.weights = model.weights - move
            if np.abs(move).max() < 1e-7:
                break
        return model

    def probability(self) -> Column:
        out = F.lit(float(self.weights[-1]))
        for c, m, s, w in zip(self.columns, self.mean, self.sd, self.weights, strict=False):
            out = out + float(w) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(m)) / float(s)
        return 1.0 / (1.0 + F.exp(-F.least(F.greatest(out, F.lit(-30.0)), F.lit(30.0))))


def rerank_keep(pairs: DataFrame, p: str, k2: int = 25) -> DataFrame:
    """The k2 best of each left record, and each right record's best."""
    rows = pairs.withColumn("_ra", rank_desc("a", p, "b")).withColumn("_rb", rank_desc("b", p, "a"))
    return rows.filter((F.col("_ra") <= k2) | (F.col("_rb") == 1)).drop("_ra", "_rb")


# ---------------------------------------------------------------- trees


def assembled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `features`: the columns with nulls as 0, and for each a flag that it was missing."""
    plain = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(columns)]
    flags = [F.col(f"`{c}`").isNull().cast("double").alias(f"_f{i}") for i, c in enumerate(columns)]
    names = [f"_v{i}" for i in range(len(columns))] + [f"_f{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows.select("*", *plain, *flags)).drop(*names)


def fit_trees(rows: DataFrame, columns: Sequence[str], y: str = "y", weight: str | None = None, rounds: int = 20, depth: int = 5, seed: int = 42):
    """Boosted trees on the columns. Spark's have no monotone constraints."""
    model = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1)
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(assembled(rows, columns).withColumn("_y", F.col(y).cast("double")))


def predict(model, rows: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    scored = model.transform(assembled(rows, columns))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def predict_mean(models: Sequence, rows: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Mean prediction of several models."""
    names = [f"_m{i}" for i in range(len(models))]
    for name, model in zip(names, models, strict=True):
        rows = predict(model, rows, columns, name)
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(models)
    return rows.withColumn(out, mean).drop(*names)


def cv_scores(
    rows: DataFrame, columns: Sequence[str], out: str, folds: int = 3, seed: int = 42, seeds: int = 1, max_left: int | None = None, final: bool = False, **params
) -> tuple[DataFrame, list]:
    """Adds out-of-fold scores and returns the models that score new rows. rows: a, y, hold. Folds are grouped by a.

    Each fold has `seeds` models, whose mean counts. Rows with hold get the mean of the fold models, or with final that of
    models of all other rows. max_left: about how many left records a fit takes, by a seeded hash of a; None takes all.
    """
    keyed = rows.withColumn("_fold", fold_of("a", folds, seed))
    open_rows = keyed.filter(~F.col("hold"))

    def fit(own: DataFrame, k: int) -> list:
        if max_left is not None:
            n = own.select("a").distinct().count()
            own = own.filter(uniform("a", seed + 7919 * (k + 1)) < min(1.0, max_left / max(n, 1)))
        return [fit_trees(own, columns, seed=seed + k + 1000 * i, **params) for i in range(seeds)]

    with ThreadPoolExecutor(folds) as pool:  # a fit is many small jobs, which leave room for each other
        of_fold = list(pool.map(lambda k: fit(open_rows.filter(F.col("_fold") != k), k), range(folds)))
    last = fit(open_rows, folds) if final else [m for own in of_fold for m in own]
    parts = [predict_mean(own, open_rows.filter(F.col("_fold") == k), columns, out) for k, own in enumerate(of_fold)]
    parts.append(predict_mean(last, keyed.filter("hold"), columns, out))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored.drop("_fold"), last


def expert_scores(rows: DataFrame, columns: Sequence[str], out: str, groups: Sequence[str], group: str = "country", **params) -> tuple[DataFrame, dict[str, list]]:
    """Adds the scores of each group's own models (null for other groups, and for groups without rows to fit on), and the models."""
    scored, experts = rows.filter(~F.col(group).isin(list(groups)) | F.col(group).isNull()).withColumn(out, F.lit(None).cast("double")), {}
    for name in groups:
        own = rows.filter(F.col(group) == name)
        if own.filter(~F.col("hold")).limit(1).count():
            part, experts[name] = cv_scores(own, columns, out, **params)
        else:
            part = own.withColumn(out, F.lit(None).cast("double"))
        scored = scored.unionByName(part)
    return scored, experts


def importance_ranks(model, columns: Sequence[str], wanted: Sequence[str]) -> dict[str, int]:
    """1-based ranks by importance, a column's flag counted with it."""
    raw = model.featureImportances.toArray()
    order = np.argsort(-(raw[: len(columns)] + raw[len(columns) :]), kind="stable")
    ranks = {columns[j]: r for r, j in enumerate(order, 1)}
    return {c: ranks[c] for c in wanted if c in ranks}


def simplex(k: int, steps: int) -> list[tuple[float, ...]]:
    """All weights of k models in steps of 1 / steps that sum to 1, in lexical order."""
    return [tuple(x / steps for x in w) for w in itertools.product(range(steps + 1), repeat=k) if sum(w) == steps]


def blend_weights(rows: DataFrame, scores: Sequence[str], y: str = "y", steps: int = 10) -> tuple[float, ...]:
    """Weights of least log loss. All grid points are sums of one aggregation."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    grid = simplex(len(scores), steps)
    target = F.col(y).cast("double")

    def loss(w: tuple[float, ...]) -> Column:
        q = sum((F.lit(x) * clip(c) for x, c in zip(w, scores, strict=True)), F.lit(0.0))
        return -F.avg(target * F.log(q) + (1 - target) * F.log(1 - q))

    got = rows.agg(*(loss(w).alias(f"l{i}") for i, w in enumerate(grid))).first()
    return grid[min(range(len(grid)), key=lambda i: (got[i] if got[i] is not None else float("inf"), i))]


def blended(rows: DataFrame, scores: Sequence[str], weights: Mapping[str, Sequence[float]], out: str, group: str = "country") -> DataFrame:
    """The weighted score of each group; groups without weights keep the first score."""
    value = F.col(scores[0])
    for name, w in weights.items():
        if len(w) != len(scores):
            raise ValueError(f"{name}: {len(w)} weights for {len(scores)} scores")
        value = F.when(F.col(group) == name, sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, scores, strict=True)), F.lit(0.0))).otherwise(value)
    return rows.withColumn(out, value)
