"""The whole run: records, candidates, re-ranking, comparison columns, stacked trees, calibration, decisions, lists.

Each step is a function of DataFrames; tables that several later steps read are kept as Parquet artifacts, so that a lost
executor costs one step and no lineage grows over the run. The `pages` table stands for business records: a page's title is
its name, its URL the address, its language the country; known matches are right pages with a left page's host.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocking, calibration, decisions, fellegi, groups, lexicon, models, pairs, records
from tessera.plans.settings import DEFAULTS
from tessera.sources.tables import Artifacts, joined_lists, shared_folder

HOW = blocking.Blocking(prefix_m=DEFAULTS["prefix_m"], k1=DEFAULTS["k1"], rev_k=DEFAULTS["rev_k"])
#: Countries of the languages in the tables; others stand for themselves.
COUNTRIES = {"en": "US", "fr": "France"}


def raw_pages(spark, sf_dir: str) -> DataFrame:
    """id, src, name, address, country, host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    lang = F.regexp_extract("html", '<html[^>]*lang="([a-zA-Z]+)', 1)
    country = lang
    for code, name in COUNTRIES.items():
        country = F.when(lang == code, name).otherwise(country)
    return pages.select(
        F.col("page_id").alias("id"), (1 + F.col("page_id") % 3).cast("int").alias("src"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("name"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[/?&=]+", ", ").alias("address"),
        country.alias("country"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"),
    )


def known(raw: DataFrame) -> DataFrame:
    """(a, b): right pages with a left page's host and country, each owned by the smallest one."""
    left = raw.filter("src = 1 AND host <> ''").groupBy("country", "host").agg(F.min("id").alias("a"))
    return raw.filter("src > 1").join(left, ["country", "host"]).select("a", F.col("id").alias("b"))


def encoded(spark, sf_dir: str) -> DataFrame:
    return records.encode(raw_pages(spark, sf_dir).drop("host"))


def learned(raw: DataFrame, truth: DataFrame) -> dict:
    """The lexicon of these matches; held-out left records must not be among them."""
    side = lambda c, test: raw.filter(test).select(F.col("id").alias(c), *(F.col(f).alias(f"{f}_{c}") for f in ("name", "address", "country")))
    rows = truth.select("a", "b").join(side("a", "src = 1"), "a").join(side("b", "src > 1"), "b")
    return lexicon.learn(rows, DEFAULTS["lex_min_count"], DEFAULTS["lex_pairs"])


def store(spark) -> Artifacts:
    """A new folder for the tables of a run, in the folder that the cluster shares."""
    return Artifacts(spark, f"{shared_folder(spark)}/linkage-{uuid.uuid4().hex}")


def features(spark, sf_dir: str) -> DataFrame:
    """All columns of each candidate but fs_llr."""
    keep = store(spark)
    rec = keep.save("records", encoded(spark, sf_dir))
    return pairs.full_features(keep.save("candidates", blocking.candidates(rec, HOW)), rec)


def run(spark, sf_dir: str, folds: int = DEFAULTS["n_folds"], rounds: int = 20, depth: int = 5, k2: int = DEFAULTS["k2"], hold: float = 0.1) -> DataFrame:
    """source1_entity_id and matched_entity_ids of every left record."""
    keep = store(spark)
    raw = raw_pages(spark, sf_dir)
    truth = known(raw).withColumn("y", F.lit(1))
    left = models.holdout(raw.filter("src = 1").select(F.col("id").alias("a"), records.country_key(F.col("country")).alias("country")), hold, 77)
    rec = keep.save("records", records.encode(raw.drop("host"), learned(raw, truth.join(left.filter("NOT hold"), "a", "left_semi"))))
    cands = keep.save("candidates", blocking.candidates(rec, HOW))

    cheap = pairs.cheap_features(cands, rec).join(truth, ["a", "b"], "left").na.fill(0, ["y"]).join(left, "a")
    cheap = keep.save("cheap", cheap.select("a", "b", "y", "hold", *(c.alias(n) for n, c in models.rerank_design().items())))
    ranker = models.LogisticModel.fit(cheap.filter("NOT hold"), models.DESIGN, "y", iterations=8)
    kept = models.rerank_keep(cheap.withColumn("p", ranker.probability()), "p", k2).select("a", "b", "p")
    kept = keep.save("kept", cands.join(kept.withColumnRenamed("p", "rr_p"), ["a", "b"]))

    full = pairs.full_features(kept.drop("rr_p"), rec).join(truth, ["a", "b"], "left").na.fill(0, ["y"]).join(left, "a")
    weights = fellegi.supervised(full.filter("NOT hold"))  # held-out records stay out of this fit too
    full = keep.save("features", fellegi.fs_llr(full, weights))
    params = {"rounds": rounds, "depth": depth}
    first, _ = models.cv_scores(full, pairs.COLUMNS, "p1", folds, **params)
    first = keep.save("first", first)
    more = groups.next_stage(first, rec, "p1", 1)
    columns = [*pairs.COLUMNS, *(c for c in more.columns if c not in first.columns), "p1"]
    second, _ = models.cv_scores(keep.save("second_input", more), columns, "p2", folds, **params)
    second = keep.save("second", second.select("a", "b", "y", "hold", "country", "p1", "p2"))

    seen = second.filter("NOT hold")
    weights2 = models.blend_weights(seen, ["p2", "p1"])
    blended = models.blended(second.withColumn("_all", F.lit("*")), ["p2", "p1"], {"*": weights2}, "pf", "_all").drop("_all")
    knots = calibration.fit_isotonic(blended.filter("NOT hold"), "pf", "y", bins=40)
    scored = keep.save("scored", blended.withColumn("q", calibration.apply_isotonic(F.col("pf"), knots)))
    chosen = decisions.decide(scored, {"excl": "soft", "min_p": 0.001}).filter("sel")
    return joined_lists(left, chosen, "qe", "matched_entity_ids")
