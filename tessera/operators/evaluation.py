"""Metric, run comparisons, error types, drift, and checks of the written lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.decisions import expected_f05
from tessera.operators.models import uniform
from tessera.operators.windows import rank_desc


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """1.25 TP / (predicted + 0.25 true); an empty list scores 1 if nothing is true, else 0."""
    return F.when(predicted == 0, (true == 0).cast("double")).otherwise(1.25 * tp / (predicted + 0.25 * true))


def list_counts(left: DataFrame, chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """a, tp, n_pred, n_true of every left record, those without candidates too. left: a and more; chosen, truth: a, b."""
    hit = chosen.join(truth, ["a", "b"], "left_semi")
    n = lambda df, name: df.groupBy("a").agg(F.count("*").alias(name))
    out = left.join(n(hit, "tp"), "a", "left").join(n(chosen, "n_pred"), "a", "left").join(n(truth, "n_true"), "a", "left")
    return out.na.fill(0, ["tp", "n_pred", "n_true"])


def macro_f05(counts: DataFrame, group: str | None = None) -> DataFrame:
    """(grp, n, f05): mean over left records, overall as '*' and by group."""
    scored = counts.withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    if group is None:
        return scored.agg(F.lit("*").alias("grp"), F.count("*").alias("n"), F.avg("f").alias("f05"))
    out = scored.rollup(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.avg("f").alias("f05"))
    return out.select(F.coalesce("grp", F.lit("*")).alias("grp"), "n", "f05")


def tune(score, base: Mapping, grid: Mapping[str, list], least_gain: float = 1e-6) -> tuple[dict, float]:
    """Coordinate descent: each setting's values in turn, kept if they raise score(settings). The first setting starts from its best value."""
    names = list(grid)
    start = [{**base, names[0]: v} for v in grid[names[0]]]
    values = [score(s) for s in start]
    best = max(range(len(start)), key=lambda i: (values[i], -i))
    settings, top = start[best], values[best]
    for name in names[1:]:
        for value in grid[name]:
            if value != settings.get(name):
                trial = {**settings, name: value}
                got = score(trial)
                if got > top + least_gain:
                    settings, top = trial, got
    return settings, top


def set_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """(a, n_only_one, n_only_other) of the left records whose lists differ."""
    both = one.select("a", "b", F.lit(1).alias("x")).join(other.select("a", "b", F.lit(1).alias("y")), ["a", "b"], "full_outer")
    out = both.groupBy("a").agg(F.count_if(F.col("y").isNull()).alias("n_only_one"), F.count_if(F.col("x").isNull()).alias("n_only_other"))
    return out.filter("n_only_one > 0 OR n_only_other > 0")


def variant_summary(left: DataFrame, main: DataFrame, variants: Mapping[str, DataFrame], group: str = "country") -> DataFrame:
    """(variant, country, matches_per_s1, empty_share, s1_differs_from_main) of each variant's lists."""
    out = None
    for name, chosen in variants.items():
        n = chosen.groupBy("a").agg(F.count("*").alias("n"))
        changed = set_differences(main, chosen).select("a", F.lit(1.0).alias("d"))
        rows = left.join(n, "a", "left").join(changed, "a", "left").na.fill(0)
        part = rows.groupBy(group).agg(F.avg("n").alias("matches_per_s1"), F.avg((F.col("n") == 0).cast("double")).alias("empty_share"), F.avg("d").alias("s1_differs_from_main"))
        part = part.select(F.lit(name).alias("variant"), group, "matches_per_s1", "empty_share", "s1_differs_from_main")
        out = part if out is None else out.unionByName(part)
    return out


def error_types(raw: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(a, b, error): true pairs that blocking or the re-ranking lost, true ones not chosen, false ones chosen for left records
    with and without true matches. raw: a, b; kept: a, b, sel."""
    named = lambda df, e: df.select("a", "b", F.lit(e).alias("error"))
    lost = truth.join(raw, ["a", "b"], "left_anti")
    cut = truth.join(raw, ["a", "b"], "left_semi").join(kept, ["a", "b"], "left_anti")
    dropped = kept.filter("NOT sel").join(truth, ["a", "b"], "left_semi")
    wrong = kept.filter("sel").join(truth, ["a", "b"], "left_anti")
    single = wrong.join(truth.select("a").distinct(), "a", "left_anti")
    false = wrong.join(truth.select("a").distinct(), "a", "left_semi")
    parts = [named(lost, "block_miss"), named(cut, "rerank_miss"), named(dropped, "dropped_true"), named(false, "false_match"), named(single, "singleton_fp")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def error_costs(counts: DataFrame, errors: DataFrame) -> DataFrame:
    """(error, n, f05_lost): what mending one type alone would add to the mean F0.5."""
    per = errors.groupBy("error", "a").agg(F.count("*").alias("k"))
    rows = counts.join(per, "a")
    missed = F.col("error").isin("block_miss", "rerank_miss", "dropped_true")
    fixed = F.when(missed, f05(F.col("tp") + F.col("k"), F.col("n_pred") + F.col("k"), F.col("n_true"))).otherwise(f05(F.col("tp"), F.col("n_pred") - F.col("k"), F.col("n_true")))
    gain = rows.groupBy("error").agg(F.sum("k").alias("n"), F.sum(fixed - f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("gain"))
    return gain.crossJoin(counts.agg(F.count("*").alias("all"))).select("error", "n", (F.col("gain") / F.col("all")).alias("f05_lost"))  # one row on the right


def error_frames(errors: DataFrame, pairs: DataFrame, records: DataFrame, q: str = "q") -> DataFrame:
    """Each error with what explains it: a, b, error, both names, q and rank_a of the pair (null if it was no candidate), and the
    left record's best candidate (top_b, top_q), which a missed match lost to. pairs: a, b and q; records: id, src, name."""
    named = lambda side, test: records.filter(test).select(F.col("id").alias(side), F.col("name").alias(f"name_{side}"))
    scored = pairs.select("a", "b", F.col(q).alias("q"), rank_desc("a", q, "b").alias("rank_a"))
    top = scored.filter("rank_a = 1").select("a", F.col("b").alias("top_b"), F.col("q").alias("top_q"))
    out = errors.join(scored, ["a", "b"], "left").join(named("a", "src = 1"), "a").join(named("b", "src > 1"), "b").join(top, "a", "left")
    return out.select("a", "b", "error", "name_a", "name_b", "q", "rank_a", "top_b", "top_q")


def best_by_group(scores: Mapping[str, Mapping[str, float]]) -> tuple[str, dict[str, str]]:
    """The option that is best over all ("*"), and each group's own best; of equal ones the first. scores: option -> group -> mean F0.5."""
    best = lambda g: max(scores, key=lambda o: scores[o].get(g, float("-inf")))
    return best("*"), {g: best(g) for g in sorted({g for own in scores.values() for g in own} - {"*"})}


def tune_exclusivity(options: list[str], lists_of, left: DataFrame, truth: DataFrame, group: str = "country") -> tuple[str, dict[str, str]]:
    """best_by_group of exclusivity options: one pass an option gives the mean F0.5 over all and of each group, as lists never cross
    groups. lists_of: option -> chosen pairs (a, b); left: a and group."""
    scores = {}
    for option in options:
        rows = macro_f05(list_counts(left, lists_of(option), truth), group).collect()  # a row for each group
        scores[option] = {r["grp"]: r["f05"] for r in rows}
    return best_by_group(scores)


def stratified(rows: DataFrame, group: str, k: int, key: str, seed: int = 0) -> DataFrame:
    """A sample of k rows, spread evenly over the groups; what small groups cannot fill goes to the larger ones. This is a sampling operator."""
    sizes = sorted((r["count"], r[group]) for r in rows.groupBy(group).count().collect())  # a row for each group
    quota, left = {}, k
    for i, (n, name) in enumerate(sizes):
        quota[name] = min(n, left // (len(sizes) - i))
        left -= quota[name]
    place = F.row_number().over(Window.partitionBy(group).orderBy(uniform(key, seed), key))
    limit = F.lit(0)
    for name, n in quota.items():
        limit = F.when(F.col(group) == name, n).otherwise(limit)
    return rows.withColumn("_r", place).filter(F.col("_r") <= limit).drop("_r")


def ks_statistic(one: DataFrame, other: DataFrame, value: str, group: str) -> DataFrame:
    """(group, ks): the largest distance of the two distributions; nulls and NaN don't count, groups must be in both."""
    tagged = one.select(group, F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(other.select(group, F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    steps = tagged.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(group, "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    run, every = Window.partitionBy(group).orderBy("v"), Window.partitionBy(group)
    share = lambda c: F.sum(c).over(run) / F.sum(c).over(every)
    rows = steps.withColumn("nx", F.sum("x").over(every)).withColumn("ny", F.sum("y").over(every)).withColumn("d", F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.abs(share("x") - share("y"))))
    return rows.groupBy(group).agg(F.max("d").alias("ks")).filter("ks IS NOT NULL")


def shift_report(train: DataFrame, test: DataFrame, values: list[str], group: str = "country") -> DataFrame:
    """(group, feature, five percentiles, null share of both, ks) for each group of test; groups that train lacks are compared with all of train."""
    known = [r[group] for r in train.select(group).distinct().collect()]  # a row for each group
    unseen = test.filter(~F.col(group).isin(known)).select(group).distinct()
    reference = train.unionByName(unseen.crossJoin(train.drop(group)).select(train.columns))  # few groups
    marks = [0.05, 0.25, 0.5, 0.75, 0.95]
    out = None
    for v in values:
        stats = lambda df, side, v=v: df.groupBy(group).agg(F.percentile(v, F.array(*map(F.lit, marks))).alias(f"{side}_p"), F.avg(F.col(v).isNull().cast("double")).alias(f"{side}_null"))
        part = stats(test, "test").join(stats(reference, "train"), group).join(ks_statistic(reference, test, v, group), group, "left").select(group, F.lit(v).alias("feature"), "train_p", "test_p", "train_null", "test_null", "ks")
        out = part if out is None else out.unionByName(part)
    return out


def paired_difference(one: DataFrame, other: DataFrame, value: str = "f") -> DataFrame:
    """(n, mean, se) of other - one over the left records that both have."""
    both = one.select("a", F.col(value).alias("x")).join(other.select("a", F.col(value).alias("y")), "a")
    d = F.col("y") - F.col("x")
    return both.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"))


def expected_lists(pairs: DataFrame, q: str = "q") -> DataFrame:
    """(a, k, expected): length and expected F0.5 of each left record's chosen list, without labels. pairs: a, b, q, sel."""
    lists = pairs.groupBy("a").agg(F.array_sort(F.collect_list(-F.col(q))).alias("m"), F.count_if("sel").alias("k"))
    ps = F.transform("m", lambda x: -x)
    return lists.select("a", F.col("k").cast("int").alias("k"), ps.alias("ps")).select("a", "k", expected_f05(F.col("ps"), F.col("k")).alias("expected"))


def validate_lists(lists: DataFrame, left: DataFrame, right: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(problem, id, detail) of written lists; no rows if all is well.

    lists and candidates: source1_entity_id and a comma-joined list; left, right: entity_id. Problems: duplicate_row,
    missing_source, extra_source, duplicate_match, bad_prefix, unknown_match, and the warning not_candidate.
    """
    ids = lists.columns[1]
    s = F.col("source1_entity_id")
    items = lists.select(s, F.explode(F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != "")).alias("b"))
    known = left.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    row = lambda df, problem, detail: df.select(F.lit(problem).alias("problem"), s.alias("id"), detail.cast("string").alias("detail"))
    parts = [
        row(lists.groupBy(s).count().filter("count > 1"), "duplicate_row", F.col("count")),
        row(known.join(lists, "source1_entity_id", "left_anti"), "missing_source", F.lit(None)),
        row(lists.select(s).distinct().join(known, "source1_entity_id", "left_anti"), "extra_source", F.lit(None)),
        row(items.groupBy(s, "b").count().filter("count > 1"), "duplicate_match", F.col("b")),
        row(items.filter(~F.rlike("b", F.lit("^S[23]-"))), "bad_prefix", F.col("b")),
    ]
    if right is not None:
        parts.append(row(items.join(right.select(F.col("entity_id").alias("b")), "b", "left_anti"), "unknown_match", F.col("b")))
    if candidates is not None:
        had = candidates.select(s, F.explode(F.split(candidates.columns[1], ",")).alias("b"))
        parts.append(row(items.join(had, ["source1_entity_id", "b"], "left_anti"), "not_candidate", F.col("b")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


