"""How a candidate agrees with the other likely matches of its left record, and the input columns of the next stage."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import similarity as sim
from tessera.operators.records import with_idf
from tessera.operators.windows import pair_context, rank_desc, source_context, twin_best

GROUP = ["g_n", "g_name_max", "g_name_wmean", "g_addr_max", "g_addr_wmean", "g_tri_wmean", "g_num_agree", "g_num_conflict", "g_cons_num"]
SOURCE = ["g_same_best", "g_other_best", "g_same_n", "g_other_n"]
#: Numbers of a record that vote.
VOTES = 8


def likely_pairs(pairs: DataFrame, p: str, least: float = 0.5, top: int = 6) -> DataFrame:
    """(a, b, other, p, turn): for each pair its left record's other candidates with p from `least` on, the best `top` of them."""
    ranked = pairs.filter(F.col(p) >= least).withColumn("_r", rank_desc("a", p, "b")).filter(F.col("_r") <= top + 1)
    others = ranked.select("a", F.col("b").alias("other"), F.col(p).alias("p"), F.col("_r").alias("turn"))
    both = pairs.select("a", "b").join(others, "a").filter("b <> other")
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("turn"))
    return both.withColumn("_k", place).filter(F.col("_k") <= top).drop("_k")


def _vote(own: list[int], mine: list[int], rest: list) -> float | None:
    """1 if b has the number with most votes, the left record's weighing 1 and likely records' their p; first seen wins ties."""
    if not mine or (not own and not any(len(r["nu"]) for r in rest)):
        return None
    votes: Counter = Counter()
    for x in own[:VOTES]:
        votes[x] += 1.0
    for r in rest:
        for x in list(r["nu"])[:VOTES]:
            votes[x] += r["p"]
    return float(votes.most_common(1)[0][0] in mine) if votes else None


@F.pandas_udf(T.DoubleType())
def consensus(own: pd.Series, mine: pd.Series, rest: pd.Series) -> pd.Series:
    return pd.Series([_vote(list(a), list(b), list(r)) for a, b, r in zip(own, mine, rest, strict=True)], dtype="float64")


def group_agreement(pairs: DataFrame, records: DataFrame, p: str, least: float = 0.5, top: int = 6, suffix: str = "") -> DataFrame:
    """Adds the nine GROUP columns; all but g_n are null for a pair without likely others."""
    full = with_idf(with_idf(records, "nt", "nt_idf"), "at", "at_idf").select("id", "src", F.struct("nt_idf", "at_idf", "a_sorted", "nu").alias("Y"))
    right = full.filter("src > 1").drop("src")
    rows = likely_pairs(pairs, p, least, top)
    rows = rows.join(right.select(F.col("id").alias("b"), F.col("Y").alias("X")), "b").join(right.select(F.col("id").alias("other"), F.col("Y").alias("Z")), "other")
    cos = lambda f: (lambda s: sim.cosine(s["ss"], s["sa"], s["sb"]))(sim.set_stats(F.col(f"X.{f}"), F.col(f"Z.{f}")))
    nums = sim.number_stats(F.col("X.nu"), F.col("Z.nu"))
    has_text = (F.col("X.a_sorted") != "") & (F.col("Z.a_sorted") != "")
    rows = rows.select(
        "a", "b", "p", "turn", cos("nt_idf").alias("name"), cos("at_idf").alias("addr"), F.when(has_text, sim.tri_dice(F.col("X.a_sorted"), F.col("Z.a_sorted"))).alias("tri"),
        (nums["shared"] > 0).alias("agree"), (nums["conflict"] > 0).alias("conflict"), F.col("Z.nu").alias("nu"),
    )
    mean = lambda c: F.sum(F.col("p") * c) / F.sum("p")
    of = rows.groupBy("a", "b").agg(
        F.count("*").alias("g_n"), F.max("name").alias("g_name_max"), mean(F.col("name")).alias("g_name_wmean"), F.max("addr").alias("g_addr_max"), mean(F.col("addr")).alias("g_addr_wmean"),
        (F.sum(F.col("p") * F.col("tri")) / F.sum(F.when(F.col("tri").isNotNull(), F.col("p")))).alias("g_tri_wmean"),
        mean(F.col("agree").cast("double")).alias("g_num_agree"), mean(F.col("conflict").cast("double")).alias("g_num_conflict"),
        F.array_sort(F.collect_list(F.struct("turn", "p", "nu"))).alias("_rest"),
    )
    left = records.filter("src = 1").select(F.col("id").alias("a"), F.col("nu").alias("_own"))
    mine = records.filter("src > 1").select(F.col("id").alias("b"), F.col("nu").alias("_mine"))
    of = of.join(left, "a").join(mine, "b").withColumn("g_cons_num", consensus("_own", "_mine", "_rest"))
    made = of.select("a", "b", *GROUP)
    out = pairs.join(made, ["a", "b"], "left").withColumn("g_n", F.coalesce("g_n", F.lit(0)))
    return out.withColumnsRenamed({g: g + suffix for g in GROUP}) if suffix else out


def next_stage(pairs: DataFrame, records: DataFrame, p: str, level: int) -> DataFrame:
    """The pair columns with what stage `level` knows: nine context, nine group, four source columns and the twin's score.
    pairs: a, b, p and earlier columns."""
    suffix = "" if level == 1 else f"@{level}"
    right = records.filter("src > 1").select(F.col("id").alias("b"), F.col("src"), F.struct("pool", F.when(F.col("sorted") != "", F.col("sorted")).alias("sorted")).alias("_n"))
    right = right.withColumn("name", F.when(F.col("_n.sorted").isNotNull(), F.to_json("_n"))).drop("_n")
    rows = pair_context(pairs, p, f"p{level}")
    rows = group_agreement(rows, records, p, suffix=suffix)
    rows = source_context(rows.join(right, "b"), p, suffix)
    return twin_best(rows, p, f"g_twin{level}").drop("src", "name")


def rebuild_last(first: DataFrame, scores: DataFrame, records: DataFrame, stages: int, columns: list[str] | None = None) -> DataFrame:
    """The last stage's input again, from the first stage's columns and the saved scores p1, .., of the stages before. first: a, b and
    columns; scores: a, b, p1, ..; columns: the names that training had, if they are to be checked."""
    rows = first
    for level in range(1, stages):
        rows = next_stage(rows.join(scores.select("a", "b", f"p{level}"), ["a", "b"]), records, f"p{level}", level)
    if columns is not None and set(columns) != set(rows.columns) - {"a", "b"}:
        raise ValueError(f"rebuilt columns differ from training's: {sorted(set(columns) ^ (set(rows.columns) - {'a', 'b'}))}")
    return rows
