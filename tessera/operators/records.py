"""Raw records to comparable ones: parsing, state fill, rarity weights, name frequencies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.addresses import parse_address
from tessera.functions.names import FIXES, parse_name

ON = frozenset(FIXES)


def country_key(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))


def encode(raw: DataFrame, lexicon: Mapping | None = None, on: frozenset[str] = ON) -> DataFrame:
    """Parsed records of rows id, src (1 left, 2 and 3 right), name, address, country and maybe pool (else the country)."""
    pool = F.col("pool") if "pool" in raw.columns else country_key(F.col("country"))
    rows = raw.select(
        "id", "src", country_key(F.col("country")).alias("country"), pool.alias("pool"),
        parse_name(F.col("name"), F.col("country"), lexicon, on).alias("n"), parse_address(F.col("address"), F.col("country"), lexicon, on).alias("d"),
    )
    none = lambda c: F.when(c != "", c)
    out = rows.select(
        "id", "src", "country", "pool",
        F.col("n.core").alias("core"), F.col("n.sorted").alias("sorted"), F.col("n.concat").alias("concat"), F.col("n.alt").alias("alt"),
        none(F.col("n.legal")).alias("legal"), F.col("n.tokens").alias("nt"), F.col("n.phon").alias("phon"), F.col("n.is_domain").alias("is_domain"),
        F.col("n.is_indic").alias("is_indic"), F.col("n.nums").alias("nn"), F.col("n.gw").alias("gw"), F.col("n.ini").alias("ini"), F.col("n.sib").alias("sib"),
        F.col("n.churn").alias("churn"), F.col("d.tokens").alias("at"), F.col("d.sorted").alias("a_sorted"), F.col("d.nums").alias("nu"), none(F.col("d.state")).alias("state"),
        F.col("d.masked").alias("masked"), F.col("d.empty").alias("a_empty"), F.col("d.digits").alias("adig"),
    )
    if "state_fill" in on:
        out = fill_states(out, state_words(out))
    return name_frequency(out)


def state_words(records: DataFrame, least: int = 20, share: float = 0.95) -> DataFrame:
    """(country, word, state): words that at least `least` left records with a state hold, `share` of them with this one."""
    seen = records.filter("src = 1 AND state IS NOT NULL").select("country", "state", F.explode("at").alias("word"))
    each = seen.groupBy("country", "word", "state").agg(F.count("*").alias("n"))
    every = each.groupBy("country", "word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "state")).alias("top"))
    kept = every.filter((F.col("total") >= least) & (F.col("top.n") >= share * F.col("total")))
    return kept.select("country", "word", F.col("top.state").alias("state"))


def fill_states(records: DataFrame, table: DataFrame) -> DataFrame:
    """Records without a state get the one that their words imply, if it is exactly one."""
    words = records.filter("state IS NULL").select("id", "src", "country", F.explode("at").alias("word"))
    implied = words.join(table, ["country", "word"]).groupBy("id", "src").agg(F.min("state").alias("lo"), F.max("state").alias("hi"))
    implied = implied.filter("lo = hi").select("id", "src", F.col("lo").alias("implied"))
    return records.join(implied, ["id", "src"], "left").withColumn("state", F.coalesce("state", "implied")).drop("implied")


def name_frequency(records: DataFrame) -> DataFrame:
    """Adds name_freq: left records of the pool with the same sorted name; the empty name counts like any other."""
    left = records.filter("src = 1").groupBy("pool", "sorted").agg(F.count("*").alias("name_freq"))
    return records.join(left, ["pool", "sorted"], "left").withColumn("name_freq", F.coalesce("name_freq", F.lit(0).cast("long")))


def model_idf(records: DataFrame, tokens: str) -> DataFrame:
    """(pool, token, df, idf): ln((N + 1) / (df + 1)) + 1 over all records of the pool, left and right."""
    sizes = records.groupBy("pool").agg(F.count("*").alias("n"))
    df = records.select("pool", F.explode(tokens).alias("token")).groupBy("pool", "token").agg(F.count("*").alias("df"))
    return df.join(sizes, "pool").select("pool", "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def with_idf(records: DataFrame, tokens: str, out: str) -> DataFrame:
    """Adds column `out`: array of struct(token, idf), sorted by token."""
    pairs = records.select("id", "src", "pool", F.explode(tokens).alias("token")).join(model_idf(records, tokens), ["pool", "token"])
    lists = pairs.groupBy("id", "src").agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias(out))
    empty = F.array().cast("array<struct<token:string,idf:double>>")
    return records.join(lists, ["id", "src"], "left").withColumn(out, F.coalesce(F.col(out), empty))
