"""Candidate pairs by a weighted similarity join inside each pool.

Every record is a sparse vector of rare features; pairs that share features meet in an equi-join on (pool, feature), and the
sum of products of their normalised weights is a cosine. Features that too many right records hold are left out, and only
each left record's heaviest ones are probed: these two limits bound the join. The best of every left record and of every
right record become candidates; both cuts are row_number windows, which Spark also applies before its shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.similarity import trigrams
from tessera.operators.scoring import best_pairs
from tessera.operators.windows import rank_desc

TYPES = ("ntok", "tri", "atok", "num", "numx", "nnum", "span")


@dataclass(frozen=True)
class Blocking:
    """Limits and weights by feature type. caps: right records that may hold a feature (None: any number); prefix_m: features
    probed (None: all). Without both limits every pair that shares a feature is scored, by its whole cosine."""

    caps: dict | None = field(default_factory=lambda: {"ntok": 20000, "tri": 5000, "atok": 20000, "num": 20000, "numx": 5000, "nnum": 5000, "span": 2000})
    weights: dict = field(default_factory=lambda: {"ntok": 1.0, "tri": 0.35, "atok": 0.8, "num": 0.8, "numx": 1.0, "nnum": 1.0, "span": 1.0})
    prefix_m: int | None = 48
    k1: int = 100
    rev_k: int = 5


def _of_type(table: dict, default: float = 0.0) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(F.col("type") == name, F.lit(float(value))).otherwise(out)
    return out


def _typed(records: DataFrame) -> dict[str, Column]:
    """The features of each type as an array of strings, distinct: name tokens, trigrams of the glued name, address tokens, numbers,
    numbers with address and with name tokens (the first three numbers, ten and six tokens), glued spans of the first six name words."""
    numbers = F.slice("nu", 1, 3)
    crossed = lambda tokens, n: F.flatten(F.transform(numbers, lambda x: F.transform(F.slice(tokens, 1, n), lambda t: F.concat_ws("|", x.cast("string"), t))))
    words = F.slice(F.filter(F.split("core", " "), lambda w: w != ""), 1, 6)

    def spans(ws: Column) -> Column:
        from_each = lambda i: F.transform(F.sequence(i, F.size(ws)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(ws, i, j - i + 1), "").alias("s")))
        every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ws)), from_each))
        kept = F.filter(every, lambda x: (x["j"] > x["i"]) | (F.size(ws) == 1))
        return F.when(F.size(ws) > 0, F.transform(kept, lambda x: x["s"])).otherwise(F.array().cast("array<string>"))

    # tokens and numbers are sets already; strings are made distinct by hashing, structs would be compared pair by pair
    return {
        "ntok": F.col("nt"), "tri": F.array_distinct(trigrams(F.col("concat"))), "atok": F.col("at"), "num": F.transform("nu", lambda v: v.cast("string")),
        "numx": crossed("at", 10), "nnum": crossed("nt", 6), "span": F.array_distinct(spans(words)),
    }


def features(records: DataFrame) -> DataFrame:
    """(id, src, pool, type, feature), distinct, of the seven types of _typed."""
    typed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("feature")))
    rows = records.select("id", "src", "pool", F.explode(F.concat(*(typed(*x) for x in _typed(records).items()))).alias("f"))
    return rows.select("id", "src", "pool", "f.type", "f.feature")


def keyed(records: DataFrame) -> DataFrame:
    """id, src, pool, keys, counts: each record's features as feature_key has them, in the order of type and feature, and how many
    there are of each type. Records of no pool or side are left out."""
    typed = sorted(_typed(records).items())
    rows = records.filter("pool IS NOT NULL AND src IS NOT NULL").select("id", "src", "pool", *(F.coalesce(F.array_sort(values), F.array().cast("array<string>")).alias(kind) for kind, values in typed))
    number = lambda kind: F.transform(kind, lambda v: F.xxhash64("pool", F.lit(kind), v))
    return rows.select("id", "src", "pool", F.concat(*(number(kind) for kind, _ in typed)).alias("keys"), F.array(*(F.size(kind) for kind, _ in typed)).alias("counts"))


def retrieval_weights(feats: DataFrame, sizes: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """(pool, type, feature, df, w): type weight * ln((right records + 1) / df), df over right records; too common ones are left out."""
    df = feats.filter("src > 1").groupBy("pool", "type", "feature").agg(F.count("*").alias("df"))
    kept = df if how.caps is None else df.filter(F.col("df") <= _of_type(how.caps))
    w = _of_type(how.weights) * F.log((F.col("n_right") + 1) / F.col("df"))
    return kept.join(sizes, "pool").select("pool", "type", "feature", "df", w.alias("w")).filter("w <> 0")


def feature_key() -> Column:
    """A feature of a pool as one number, which sorts and shuffles faster than three strings; 64 bits, so that none collide by chance."""
    return F.xxhash64("pool", "type", "feature")


def vectors(feats: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, src, pool, type, feature, key, v): weights normalised to length 1 over the features that carry one."""
    rows = feats.withColumn("key", feature_key()).join(weights.select(feature_key().alias("key"), "w"), "key")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id", "src")))
    return rows.select("id", "src", "pool", "type", "feature", "key", (F.col("w") / norm).alias("v"))


def similar_pairs(vecs: DataFrame, prefix_m: int | None = 48) -> DataFrame:
    """(a, b, pool, score) of all left and right records that share a probed feature. The left vector is cut to its prefix_m
    heaviest features after it was normalised; None probes them all, so that the scores are whole cosines."""
    left = vecs.filter("src = 1")
    if prefix_m is not None:
        heaviest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("v"), "type", "feature"))
        left = left.withColumn("_r", heaviest).filter(F.col("_r") <= prefix_m)
    left = left.select(F.col("id").alias("a"), "pool", "key", F.col("v").alias("va"))
    right = vecs.filter("src > 1").select(F.col("id").alias("b"), "key", F.col("v").alias("vb"))
    joined = left.join(right, "key")
    return joined.groupBy("pool", "a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("score")).select("a", "b", "pool", F.round("score", 9).alias("score"))


def top_forward(pairs: DataFrame, k: int) -> DataFrame:
    """The k best right records of each left one, with fwd_rank."""
    return pairs.withColumn("fwd_rank", rank_desc("a", "score", "b")).filter(F.col("fwd_rank") <= k)


def top_reverse(pairs: DataFrame, k: int) -> DataFrame:
    """The k best left records of each right one, from all scores."""
    return pairs.withColumn("rank", rank_desc("b", "score", "a")).filter(F.col("rank") <= k)


def union_candidates(pairs: DataFrame, k1: int, rev_k: int) -> DataFrame:
    """Both lists without duplicates; pairs that only the reverse list has get fwd_rank k1 + 1."""
    forward = top_forward(pairs, k1)
    reverse = top_reverse(pairs, rev_k).drop("rank").withColumn("fwd_rank", F.lit(k1 + 1))
    both = forward.unionByName(reverse).groupBy("a", "b").agg(F.first("pool").alias("pool"), F.max("score").alias("score"), F.min("fwd_rank").alias("fwd_rank"))
    return both


def retrieval_context(cands: DataFrame) -> DataFrame:
    """Adds rev_rank, gap_a, gap_b and n_cand_b (ranks and counts up to 32767)."""
    a, b = Window.partitionBy("a"), Window.partitionBy("b")
    return cands.select(
        "*",
        F.least(rank_desc("b", "score", "a"), F.lit(32767)).alias("rev_rank"),
        (F.max("score").over(a) - F.col("score")).alias("gap_a"),
        (F.max("score").over(b) - F.col("score")).alias("gap_b"),
        F.least(F.count("*").over(b), F.lit(32767)).alias("n_cand_b"),
    )


def candidates(records: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """a, b, pool, score, fwd_rank, rev_rank, gap_a, gap_b, n_cand_b. Pairs never leave a pool. The same as retrieval_context of
    union_candidates of similar_pairs, but scores are added up in blocks (scoring.best_pairs) instead of a row for each pair."""
    sizes = records.groupBy("pool").agg(F.count_if(F.col("src") > 1).alias("n_right"))
    if records.groupBy("id").agg(F.count("*").alias("n")).filter("id IS NULL OR n > 1").limit(1).count():  # rows of one id are one vector
        feats = features(records)
        vecs = vectors(feats, retrieval_weights(feats, sizes, how))
        return retrieval_context(union_candidates(similar_pairs(vecs, how.prefix_m), how.k1, how.rev_k))
    kinds = sorted(TYPES)
    caps = None if how.caps is None else [float(how.caps.get(t, 0)) for t in kinds]
    best = best_pairs(keyed(records), sizes.filter("n_right > 0"), [float(how.weights.get(t, 0)) for t in kinds], caps, how.prefix_m, how.k1, how.rev_k)
    forward = F.when(F.col("side") == 0, F.col("rank")).otherwise(how.k1 + 1)
    return retrieval_context(best.groupBy("a", "b").agg(F.first("pool").alias("pool"), F.max("score").alias("score"), F.min(forward).alias("fwd_rank")))


def recall_report(cands: DataFrame, truth: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, n_true, n_found, recall), overall as '*'. truth: a, b; groups: a, grp."""
    found = truth.join(cands.select("a", "b").distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left").join(groups, "a")
    out = found.rollup("grp").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return out.select(F.coalesce("grp", F.lit("*")).alias("grp"), "n_true", "n_found", (F.col("n_found") / F.col("n_true")).alias("recall"))
