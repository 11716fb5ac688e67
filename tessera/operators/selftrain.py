"""Optional refits: the chance that a left record has a match at all, and self-training on confident pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import calibration, decisions, evaluation, models

#: Inputs of the has-match model: fixed values.
HAS_MATCH = ["q1", "q2", "q3", "q_sum", "n_q05", "n_q01", "n_cand", "q_entropy", "max_jw_sorted", "max_atok_cos", "max_num_shared", "name_freq_a", "addr_empty_a", "ntok_a"]


def has_match(features: DataFrame, truth: DataFrame, left: DataFrame, columns: Sequence[str] = tuple(HAS_MATCH), **params) -> tuple[DataFrame, list]:
    """(a, p_has) of every left record, -1 without candidates, and the fold models. features: decisions.has_match_features; left: a, hold."""
    if missing := set(columns) - set(features.columns):
        raise ValueError(f"has-match columns missing: {sorted(missing)}")
    y = truth.select("a").distinct().withColumn("y", F.lit(1))
    rows = features.join(left.select("a", "hold"), "a").join(y, "a", "left").na.fill(0, ["y"])
    scored, fitted = models.cv_scores(rows, list(columns), "p_has", **params)
    out = left.select("a").join(scored.select("a", "p_has"), "a", "left")
    return out.withColumn("p_has", F.coalesce("p_has", F.lit(-1.0))), fitted


def refit(labelled: DataFrame, target: DataFrame, columns: Sequence[str], settings: Mapping, out: str = "p", **params) -> DataFrame:
    """The target pairs rescored by a model of the labelled ones and of the target's confident pairs at a low weight.

    labelled: columns, y; target: a, b, q, sel and columns.
    """
    pseudo = decisions.pseudo_labels(target, settings["st_pos_q"], settings["st_runner_up_q"], settings["st_neg_q"], settings["st_max_list"])
    added = target.join(pseudo, ["a", "b"]).select(*(F.col(f"`{c}`") for c in columns), F.col("label").alias("y"), F.lit(float(settings["st_weight"])).alias("weight"))
    own = labelled.select(*(F.col(f"`{c}`") for c in columns), F.col("y").cast("int").alias("y"), F.lit(1.0).alias("weight"))
    model = models.fit_trees(own.unionByName(added), columns, weight="weight", **params)
    return models.predict(model, target, columns, out)


def drifted(main: DataFrame, after: DataFrame, left: DataFrame, limit: float = 0.15) -> bool:
    """Whether more than the limit of the left records change their lists."""
    changed, n = evaluation.set_differences(main, after).count(), left.count()
    return n > 0 and changed > limit * n


def tune_group(pairs: DataFrame, left: DataFrame, truth: DataFrame, settings: Mapping, p_has: str | None = None) -> tuple[dict, float]:
    """Decision settings of a group by coordinate descent on its mean F0.5: exclusivity, has-match, odds, a calibration after
    exclusivity, least q, gate. The calibration is in the settings as post_cal (knots), if it is worth it.

    Each trial is one pass over the pairs; keep them in a table.
    """

    def score(s: dict) -> float:
        chosen = decisions.decide(pairs, s, p_has, calibration_of(s)).filter("sel").select("a", "b")
        return evaluation.macro_f05(evaluation.list_counts(left, chosen, truth)).first()["f05"] or 0.0

    grid: dict = {"excl": [f"hard:{d}" for d in settings["delta_grid"]] + (["soft"] if settings["soft_excl"] else [])}
    if p_has:
        grid["has_match"] = [False, True]
    best, top = evaluation.tune(score, {"lam": 1.0, "min_p": settings["min_p"], "has_match": False, "gate": 0.0, "post_cal": None}, grid | {"lam": settings["lam_grid"]})
    if settings.get("post_cal", True):
        known = truth.select("a", "b", F.lit(1).alias("_y"))
        after = decisions.decide(pairs, best, p_has).filter("qe > 0").join(known, ["a", "b"], "left").select("qe", F.coalesce("_y", F.lit(0)).alias("_y"))
        if after.count() > settings.get("post_cal_least", 1000):
            trial = {**best, "post_cal": calibration.fit_isotonic(after, "qe", "_y")}
            got = score(trial)
            best, top = (trial, got) if got > top + 1e-6 else (best, top)
    rest = {"min_p": settings["min_p_grid"]} | ({"gate": settings["hm_gate_grid"]} if p_has else {})
    for name, values in rest.items():
        best, top = evaluation.tune(score, best, {name: [best[name], *values]})
    return best, top


def calibration_of(settings: Mapping):
    """The map of settings' post_cal for decisions.decide, or None."""
    knots = settings.get("post_cal")
    return (lambda q: calibration.apply_isotonic(q, knots)) if knots else None


def leave_one_out(labelled: DataFrame, columns: Sequence[str], settings: Mapping, countries: Sequence[str], out: str = "p", **params) -> DataFrame:
    """The labelled pairs of each named country rescored as if it had none: by a model of the other countries and its own confident
    pairs. How well self-training serves a country that training never saw. labelled: a, b, country, y, q, sel and columns."""
    scored = None
    for name in countries:
        own = labelled.filter(F.col("country") == name)
        part = refit(labelled.filter(F.col("country") != name), own, columns, settings, out, **params)
        scored = part if scored is None else scored.unionByName(part)
    return scored
