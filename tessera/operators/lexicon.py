"""Lexicons mined from known matches: Indic words in Latin, and words that one source writes for another's."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.functions.addresses import parse_address
from tessera.functions.names import parse_name
from tessera.operators.records import ON, country_key


def sample_pairs(pairs: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """At most about `limit` pairs, by a seeded hash of both ids: the same ones however the data are partitioned. A sampling operator."""
    n = pairs.count()
    if n <= limit:
        return pairs
    return pairs.filter(F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 30)) < int(limit / n * (1 << 30)))


def _picked(counts: DataFrame, least: int, share: float) -> DataFrame:
    """(word, target): each word's most frequent target, if the word is seen `least` times and the target has the share. Ties go to the smaller target."""
    every = Window.partitionBy("word")
    best = F.row_number().over(every.orderBy(F.desc("n"), "target"))
    rows = counts.withColumn("total", F.sum("n").over(every)).withColumn("_r", best)
    return rows.filter((F.col("_r") == 1) & (F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select("word", "target")


def indic_name_words(pairs: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(word, target) from names with equally many words on both sides. pairs: name_a, name_b."""
    latin = F.filter(F.split(F.regexp_replace(F.replace(text.ascii_fold("name_a"), F.lit("."), F.lit("")), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    rows = pairs.filter(text.is_indic(F.col("name_b"))).select(latin.alias("x"), F.filter(F.split("name_b", r"\s+"), lambda w: w != "").alias("y"))
    zipped = rows.filter(F.size("x") == F.size("y")).select(F.explode(F.arrays_zip("x", "y")).alias("z"))
    counts = zipped.filter(text.is_indic(F.col("z.y"))).groupBy(F.col("z.y").alias("word"), F.col("z.x").alias("target")).agg(F.count("*").alias("n"))
    return _picked(counts, least, share)


def component_key(component: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(component), "[^a-z0-9]+", " "))


def indic_components(pairs: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """(word, target): an Indic address component and the left components that occur with it and are not on the right. pairs: address_a, address_b."""
    rows = pairs.filter(text.is_indic(F.col("address_b"))).select(F.transform(F.split("address_b", ","), lambda c: F.trim(c)).alias("cb"), F.transform(F.split(text.ascii_fold("address_a"), ","), component_key).alias("ca"))
    latin = F.transform(F.filter("cb", lambda c: ~text.is_indic(c)), component_key)
    rows = rows.select("cb", F.filter(F.array_distinct(F.array_except("ca", latin)), lambda c: c != "").alias("targets"))
    alone = F.filter("cb", lambda c: text.is_indic(c) & ~F.rlike(c, F.lit("[A-Za-z]")))
    counts = rows.select(F.explode(alone).alias("word"), "targets").select("word", F.explode("targets").alias("target")).groupBy("word", "target").agg(F.count("*").alias("n"))
    return _picked(counts, least, share)


def swaps(tokens: DataFrame, least: int, share: float = 0.5, same_letter: bool = True) -> DataFrame:
    """(scope, word, target): pairs of token sets that differ in exactly one word on each side, counted per scope; the word is the
    right one's. tokens: scope, ta, tb. Targets that are themselves rewritten in the scope are left out."""
    one = tokens.select("scope", F.array_except("tb", "ta").alias("x"), F.array_except("ta", "tb").alias("y")).filter((F.size("x") == 1) & (F.size("y") == 1))
    one = one.select("scope", F.get("x", F.lit(0)).alias("word"), F.get("y", F.lit(0)).alias("target"))
    plain = F.rlike("word", F.lit("^[a-z]+$")) & F.rlike("target", F.lit("^[a-z]+$"))
    if same_letter:
        plain &= F.substring("word", 1, 1) == F.substring("target", 1, 1)
    counts = one.groupBy("scope", "word", "target").agg(F.count_if(plain).alias("n"), F.count("*").alias("k"))
    rows = counts.withColumn("total", F.sum("k").over(Window.partitionBy("scope", "word")))
    kept = rows.filter((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))
    # of two targets with half of the cases each, one is enough
    first = F.row_number().over(Window.partitionBy("scope", "word").orderBy(F.desc("n"), "target"))
    kept = kept.withColumn("_r", first).filter(F.col("_r") == 1).select("scope", "word", "target")
    return kept.join(kept.select("scope", F.col("word").alias("target")), ["scope", "target"], "left_anti").select("scope", "word", "target")


def learn(pairs: DataFrame, least: int = 40, limit: int = 400_000, on: frozenset[str] = ON) -> Mapping:
    """The lexicon of known matches, as parse_name and parse_address take it. pairs: a, b, name_a, address_a, country_a, name_b, address_b, country_b.

    The dictionaries are small by their thresholds: each entry needs `least` pairs (Indic words three).
    """
    known = sample_pairs(pairs, limit)
    flat = lambda df: {r["word"]: r["target"] for r in df.collect()}
    lexicon: dict = {"name_indic": flat(indic_name_words(known)), "addr_indic": flat(indic_components(known)), "name_map": {}, "addr_map": {}}
    scoped = "lex_country" in on
    scope = country_key(F.col("country_a")) if scoped else F.lit("*")
    parsed = known.select(
        scope.alias("scope"),
        *(parse_name(F.col(f"name_{s}"), F.col(f"country_{s}"), lexicon, on)["tokens"].alias(f"n{s}") for s in "ab"),
        *(parse_address(F.col(f"address_{s}"), F.col(f"country_{s}"), lexicon, on)["tokens"].alias(f"d{s}") for s in "ab"),
    )
    for key, cols, n, letter in (("name_map", ("na", "nb"), least, True), ("addr_map", ("da", "db"), 2 * least, scoped)):
        found = swaps(parsed.select("scope", F.col(cols[0]).alias("ta"), F.col(cols[1]).alias("tb")), n, same_letter=letter)
        for r in found.collect():
            lexicon[key].setdefault(r["scope"], {})[r["word"]] = r["target"]
    return lexicon
