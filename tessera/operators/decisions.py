"""From calibrated probabilities to match lists: odds shift, one owner per record, expected-F0.5 selection, floors and gates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import let, total
from tessera.operators.windows import best_other, rank_desc

#: Least value of 1 - prod(1 - q) that a has-match probability is spread over.
LEAST_ANY = 0.05


def odds_shift(q: Column, lam: Column | float) -> Column:
    """The probability whose odds are lam times those of q."""
    lam = F.lit(float(lam)) if isinstance(lam, int | float) else lam
    return lam * q / (lam * q + 1.0 - q)


def hard_exclusive(q: str = "q", delta: float = 0.0) -> Column:
    """Each right record's best pair keeps q if it leads the next by delta; all others get 0. Needs columns a, b."""
    s = F.col(q)
    first = rank_desc("b", q, "a") == 1
    ranked = Window.partitionBy("b").orderBy(F.desc(s), F.asc("a")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runner_up = F.greatest(F.coalesce(F.nth_value(s, 2).over(ranked), F.lit(0.0)), F.lit(0.0))
    return F.when(first & (s - runner_up >= delta), s).otherwise(0.0)


def soft_exclusive(q: str = "q") -> Column:
    """Chance that b belongs to a, given it belongs to one left record at most."""
    p = F.least(F.greatest(F.col(q), F.lit(0.0)), F.lit(1 - 1e-6))
    odds = p / (1 - p)
    return odds / (1 + F.sum(odds).over(Window.partitionBy("b")))


def exclusive(option: str, q: str = "q") -> Column:
    """option: "soft" or "hard:<margin>"."""
    return soft_exclusive(q) if option == "soft" else hard_exclusive(q, float(option.partition(":")[2] or 0))


def exclusive_by(group: str, options: Mapping[str, str], default: str, q: str = "q") -> Column:
    """Each group's own option; records never belong to two groups."""
    out = exclusive(default, q)
    for name, option in options.items():
        out = F.when(F.col(group) == name, exclusive(option, q)).otherwise(out)
    return out


def match_counts(ps: Column) -> Column:
    """Poisson-binomial: the probabilities of 0, 1, .. n matches among independent ones with these probabilities."""
    one = F.array(F.lit(1.0))

    def step(acc: Column, p: Column) -> Column:
        stay = F.transform(F.array_append(acc, F.lit(0.0)), lambda v: v * (1 - p))
        move = F.transform(F.array_prepend(acc, F.lit(0.0)), lambda v: v * p)
        return F.zip_with(stay, move, lambda x, y: x + y)

    return F.aggregate(ps, one, step)


def expected_f05(ps: Column, k: Column) -> Column:
    """Expected F0.5 of choosing the first k of falling probabilities; for k = 0 the chance that there is no match."""

    def of(head: Column, tail: Column) -> Column:
        terms = F.transform(head, lambda x, i: total(F.transform(tail, lambda y, j: F.when(i > 0, x * y * 1.25 * i / (k + 0.25 * (i + j))).otherwise(0.0))))
        return total(terms)

    head, tail = match_counts(F.slice(ps, 1, k)), match_counts(F.slice(ps, k + 1, F.size(ps)))
    none = F.aggregate(ps, F.lit(1.0), lambda acc, p: acc * (1 - p))
    return F.when(k == 0, none).otherwise(let(head, lambda h: let(tail, lambda t: of(h, t))))


def best_prefix(ps: np.ndarray, p_has: float | None = None) -> int:
    """How many of the falling probabilities to choose for the largest expected F0.5."""
    n = len(ps)
    tails = [np.ones(1)]
    for p in ps[::-1]:
        last = tails[-1]
        tails.append(np.append(last * (1 - p), 0) + np.append(0, last * p))
    tails.reverse()  # tails[k]: matches among ps[k:]
    best, scale = float(tails[0][0]), 1.0
    if p_has is not None and p_has >= 0:
        best, scale = 1 - p_has, p_has / max(1 - best, LEAST_ANY)
    chosen, head = 0, np.ones(1)
    for k in range(1, n + 1):
        p = ps[k - 1]
        head = np.append(head * (1 - p), 0) + np.append(0, head * p)
        hits, rest = np.arange(1, k + 1)[:, None], np.arange(n - k + 1)[None, :]
        value = scale * float((head[1:, None] * tails[k][None, :] * 1.25 * hits / (k + 0.25 * (hits + rest))).sum())
        if value > best + 1e-15:
            best, chosen = value, k
    return chosen


def select(pairs: DataFrame, q: str = "q", min_p: float = 0.001, p_has: str | None = None) -> DataFrame:
    """Adds sel: whether the pair is in its left record's list of largest expected F0.5, among pairs with q from min_p on.
    p_has: column with the chance that a has a match at all (negative or null: unknown).

    A left record's candidates are few (the blocking keeps k1 at most and its reverse list), so a list is one row here.
    """
    lists = pairs.filter(F.col(q) >= min_p).groupBy("a").agg(
        F.array_sort(F.collect_list(F.struct((-F.col(q)).alias("m"), F.col("b").alias("b")))).alias("list"), (F.max(p_has) if p_has else F.lit(-1.0)).cast("double").alias("has")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [best_prefix(-np.array([x["m"] for x in row]), h) for row, h in zip(batch.column("list").to_pylist(), batch.column("has").to_pylist(), strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "list": batch.column("list"), "k": pa.array(counts, pa.int32())})

    schema = lists.select("a", "list", F.lit(0).alias("k")).schema
    chosen = lists.mapInArrow(run, schema).select("a", F.explode(F.slice("list", 1, F.col("k"))).alias("x")).select("a", F.col("x.b").alias("b"), F.lit(True).alias("sel"))
    return pairs.join(chosen, ["a", "b"], "left").withColumn("sel", F.coalesce("sel", F.lit(False)))


def decide(pairs: DataFrame, settings: Mapping, p_has: str | None = None, calibrate=None) -> DataFrame:
    """Adds qe (q after the odds shift and exclusivity) and sel. settings: excl, and maybe lam, min_p, has_match, gate.
    calibrate: maps a column of positive qe to its probability, as calibration.apply_isotonic does."""
    shifted = pairs.withColumn("_q", odds_shift(F.col("q"), settings.get("lam", 1.0)))
    out = shifted.withColumn("qe", exclusive(settings["excl"], "_q")).drop("_q")
    if calibrate is not None:
        out = out.withColumn("qe", F.when(F.col("qe") > 0, calibrate(F.col("qe"))).otherwise(F.col("qe")))
    out = select(out, "qe", settings.get("min_p", 0.001), p_has if settings.get("has_match") else None)
    gate = settings.get("gate", 0.0)
    if gate and p_has:
        out = out.withColumn("sel", F.col("sel") & ~((F.col(p_has) >= 0) & (F.col(p_has) < gate)))
    return out


def decide_groups(pairs: DataFrame, settings: Mapping[str, Mapping], group: str = "country", default: str = "*", unseen: Mapping[str, str] | None = None, p_has: str | None = None) -> DataFrame:
    """decide() with each group's own settings; a group without any uses those of the group that unseen names, else default's."""
    unseen = unseen or {}
    key = F.lit(default)
    for name in settings:
        key = F.when(F.col(group) == name, name).otherwise(key)
    for name, like in unseen.items():
        if name not in settings and like in settings:
            key = F.when(F.col(group) == name, like).otherwise(key)
    keyed = pairs.withColumn("_key", key)
    parts = [decide(keyed.filter(F.col("_key") == name), own, p_has) for name, own in settings.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_key")


def unseen_floor(pairs: DataFrame, seen: list[str], floor: float = 0.7, group: str = "country", q: str = "qe") -> DataFrame:
    """Chosen pairs of groups that training never saw stay only from the floor on."""
    return pairs.withColumn("sel", F.col("sel") & (F.col(group).isin(seen) | (F.col(q) >= floor)))


def has_match_features(pairs: DataFrame, records: DataFrame, q: str = "q", extra_max: tuple[str, ...] = (), extra_top: tuple[str, ...] = ()) -> DataFrame:
    """One row for each left record with candidates: its three best q, sums, counts, entropy and maxima, before exclusivity."""
    s = F.col(q).cast("double")
    w = Window.partitionBy("a")
    rows = pairs.withColumn("_r", rank_desc("a", q, "b")).withColumn("_share", s / F.sum(s).over(w))
    nth = lambda k: F.coalesce(F.max(F.when(F.col("_r") == k, s)), F.lit(0.0)).alias(f"q{k}")
    most = lambda c: F.coalesce(F.max(c), F.lit(-1.0)).alias(f"max_{c}")
    top = lambda c, name: F.max(F.when(F.col("_r") == 1, F.col(c))).alias(name)
    out = rows.groupBy("a").agg(
        nth(1), nth(2), nth(3), F.sum(s).alias("q_sum"), F.count_if(s > 0.5).alias("n_q05"), F.count_if(s > 0.1).alias("n_q01"), F.count("*").alias("n_cand"),
        F.coalesce(-F.sum(F.when(F.col("_share") > 0, F.col("_share") * F.log("_share"))), F.lit(0.0)).alias("q_entropy"),
        most("jw_sorted"), most("atok_cos"), most("num_shared"), top("name_freq_a", "name_freq_a"), top("ntok_a", "ntok_a"),
        *(F.max(c).alias(f"max_{c}") for c in extra_max), *(top(c, f"top_{c}") for c in extra_top),
    )
    empty = records.filter("src = 1").select(F.col("id").alias("a"), F.col("a_empty").alias("addr_empty_a"))
    return out.join(empty, "a", "left")


def prior_shift(histogram: list[tuple[float, float]], trained_at: float, tol: float = 1e-5, max_iter: int = 1000) -> tuple[float, float]:
    """(match rate, odds multiplier) of new pairs by EM, from (q, count) of their calibrated q and the rate of training."""
    q, n = (np.array(x, float) for x in zip(*histogram, strict=True))
    rate = trained_at
    for _ in range(max_iter):
        on, off = rate / trained_at * q, (1 - rate) / (1 - trained_at) * (1 - q)
        new = float((n * on / (on + off)).sum() / n.sum())
        done, rate = abs(new - rate) < tol, new
        if done:
            break
    return rate, (rate / trained_at) / ((1 - rate) / (1 - trained_at))


def runner_up(pairs: DataFrame, q: str = "q") -> DataFrame:
    """Adds runner_up: the best q of b's other pairs."""
    return pairs.withColumn("runner_up", best_other(F.col(q), "b", "a"))


def pseudo_labels(pairs: DataFrame, pos_q: float = 0.98, runner_q: float = 0.1, neg_q: float = 0.02, max_list: int = 6) -> DataFrame:
    """(a, b, label) of confident pairs: yes with q from pos_q on, a weak runner-up and a short list; no for such left records'
    other pairs up to neg_q. pairs: a, b, q, sel."""
    w = Window.partitionBy("a")
    rows = runner_up(pairs).withColumn("_n", F.count_if(F.col("sel")).over(w))
    rows = rows.withColumn("_pos", (F.col("q") >= pos_q) & (F.col("runner_up") <= runner_q) & (F.col("_n") <= max_list))
    rows = rows.withColumn("_any", F.max(F.col("_pos").cast("int")).over(w) == 1)
    label = F.when(F.col("_pos"), 1).when(F.col("_any") & (F.col("q") <= neg_q), 0)
    return rows.withColumn("label", label).filter("label IS NOT NULL").select("a", "b", "label")
