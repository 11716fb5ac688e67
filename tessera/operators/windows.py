"""Ranks and group values that a pair table needs again and again; ties always go to the smaller id of the other side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_desc(group: str, score: Column | str, other: str) -> Column:
    """1-based rank within the group, by falling score."""
    return F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(other)))


def top_two(score: Column, group: str, other: str) -> tuple[Column, Column]:
    """The largest and second largest score of the group (duplicates of the largest count as second); null if there is none."""
    ranked = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc(other)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(score, 1).over(ranked), F.nth_value(score, 2).over(ranked)


def best_other(score: Column, group: str, other: str) -> Column:
    """The best score of the group's other rows, at least 0: the second for the rows at the top, the top for the rest."""
    first, second = top_two(score, group, other)
    return F.greatest(F.when(score >= first, F.coalesce(second, F.lit(0.0))).otherwise(first), F.lit(0.0))


def pair_context(pairs: DataFrame, p: str, name: str = "p") -> DataFrame:
    """Adds nine columns on how a pair's score p compares with those of its two records' other pairs."""
    s = F.col(p).cast("double")
    a, b = Window.partitionBy("a"), Window.partitionBy("b")
    other_b = best_other(s, "b", "a")
    return pairs.select(
        "*",
        *([] if name == p else [s.alias(name)]),
        rank_desc("a", s, "b").alias(f"{name}_rank_a"),
        best_other(s, "a", "b").alias(f"{name}_other_a"),
        F.sum(s).over(a).alias(f"{name}_sum_a"),
        F.sum(F.when(s > 0.5, 1).otherwise(0)).over(a).alias(f"{name}_c05_a"),
        rank_desc("b", s, "a").alias(f"{name}_rank_b"),
        other_b.alias(f"{name}_other_b"),
        (s - other_b).alias(f"{name}_margin_b"),
        F.count("*").over(b).alias(f"{name}_n_b"),
    )


def source_context(pairs: DataFrame, p: str, suffix: str = "") -> DataFrame:
    """Adds the best score and the count from 0.5 on among a's other candidates of the same source and of the other one.

    pairs: a, b, src (2 or 3) and p.
    """
    s = F.col(p).cast("double")
    per = pairs.groupBy("a").agg(*(F.coalesce(F.max(F.when(F.col("src") == k, s)), F.lit(0.0)).alias(f"_best{k}") for k in (2, 3)), *(F.count_if((F.col("src") == k) & (s >= 0.5)).alias(f"_n{k}") for k in (2, 3)))
    own = Window.partitionBy("a", "src").orderBy(F.desc(s), F.asc("b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.nth_value("b", 1).over(own), F.nth_value(s, 2).over(own)
    best_same = F.when(F.col("b") == first, F.coalesce(second, F.lit(0.0))).otherwise(F.nth_value(s, 1).over(own))
    n_same = F.when(F.col("src") == 2, F.col("_n2")).otherwise(F.col("_n3")) - F.when(s >= 0.5, 1).otherwise(0)
    out = pairs.withColumn("_same", best_same).join(per, "a")
    return out.select(
        *pairs.columns,
        F.greatest("_same", F.lit(0.0)).alias(f"g_same_best{suffix}"),
        F.greatest(F.when(F.col("src") == 2, F.col("_best3")).otherwise(F.col("_best2")), F.lit(0.0)).alias(f"g_other_best{suffix}"),
        n_same.alias(f"g_same_n{suffix}"),
        F.when(F.col("src") == 2, F.col("_n3")).otherwise(F.col("_n2")).alias(f"g_other_n{suffix}"),
    )


def twin_best(pairs: DataFrame, p: str, out: str = "g_twin1") -> DataFrame:
    """Adds the best score of a's other candidates with b's very name and source, 0 if b has no name. pairs: a, b, src, name (null: none), p."""
    s = F.col(p).cast("double")
    keyed = pairs.withColumn("_twins", F.struct("a", "name", "src"))
    best = best_other(s, "_twins", "b")
    return keyed.withColumn(out, F.when(F.col("name").isNull() | (F.col("name") == ""), 0.0).otherwise(best)).drop("_twins")


def candidate_structure(pairs: DataFrame, records: DataFrame, same: float = 0.95) -> DataFrame:
    """Adds six columns on who else carries a pair's names. pairs: a, b, jw_sorted, atok_cos, num_shared, addr_empty_b."""
    names = records.filter("sorted <> ''").select("id", "src", "pool", "sorted")
    carriers = names.filter("src > 1").groupBy("pool", "sorted").agg(F.count("*").alias("n"))
    counted = names.join(carriers, ["pool", "sorted"], "left").select("id", "src", F.coalesce("n", F.lit(0)).alias("n"))
    left = counted.filter("src = 1").select(F.col("id").alias("a"), F.col("n").alias("_na"))
    right = counted.filter("src > 1").select(F.col("id").alias("b"), F.col("n").alias("_nb"))
    alike = (F.coalesce("jw_sorted", F.lit(0.0)) >= same).cast("int")
    bare = alike * (F.col("addr_empty_b") > 0).cast("int")
    score = F.coalesce("jw_sorted", F.lit(0.0)) + 0.5 * F.coalesce("atok_cos", F.lit(0.0)) + 0.25 * (F.col("num_shared") > 0).cast("int")
    a, b = Window.partitionBy("a"), Window.partitionBy("b")
    return pairs.join(left, "a", "left").join(right, "b", "left").select(
        *pairs.columns,
        F.log1p(F.coalesce("_na", F.lit(0))).alias("nm_rec_cnt_a"),
        F.log1p(F.greatest(F.coalesce("_nb", F.lit(0)) - 1, F.lit(0))).alias("nm_rec_cnt_b"),
        (F.sum(alike).over(a) - alike).alias("a_same_name_cands"),
        (F.sum(bare).over(a) - bare).alias("a_same_name_noaddr"),
        (F.sum(alike).over(b) - alike).alias("b_name_claimants"),
        rank_desc("b", score, "a").alias("b_name_rank"),
    )


def top_row(pairs: DataFrame, p: str) -> DataFrame:
    """Each a's best candidate: a, b, p."""
    return pairs.groupBy("a").agg(F.max_by("b", F.struct(F.col(p), -F.col("b"))).alias("b"), F.max(p).alias(p))
