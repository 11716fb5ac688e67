"""Tab-separated sources and sinks, and Parquet artifacts with fallback folders."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Fields verbatim: no quotes, no missing values, an empty field is the empty string."""
    rows = spark.read.csv(path, sep="\t", quote="", escape="", header=True, schema=schema, nullValue="\x00", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in schema))


def read_source(spark: SparkSession, path: str, src: int) -> DataFrame:
    """id, src, name, address, country of a source file."""
    rows = read_tsv(spark, path, SOURCE)
    return rows.select(F.col("entity_id").alias("id"), F.lit(src).alias("src"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(a, b), one row for each known match."""
    return explode_lists(read_tsv(spark, path, TRUTH))


def explode_lists(lists: DataFrame) -> DataFrame:
    """(a, b) of rows with an id and a comma-joined list; an empty list has no rows."""
    first, second = lists.columns[:2]
    return lists.select(F.col(first).alias("a"), F.explode(F.filter(F.split(F.coalesce(second, F.lit("")), ","), lambda x: x != "")).alias("b"))


def joined_lists(left: DataFrame, chosen: DataFrame, score: str, name: str) -> DataFrame:
    """source1_entity_id and a comma-joined list for every left record, empty ones too, by falling score, then id. left: a; chosen: a, b, score."""
    lists = chosen.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("b").cast("string").alias("b")))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["b"]), ",")
    return left.select("a").join(lists, "a", "left").select(F.col("a").cast("string").alias("source1_entity_id"), F.coalesce(text, F.lit("")).alias(name))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def write_outputs(left: DataFrame, kept: DataFrame, folder: str, rank: str = "p", q: str = "qe") -> None:
    """candidate_pairs and matching_results. kept: a, b, sel and both scores."""
    write_tsv(joined_lists(left, kept, rank, "candidate_entity_ids"), f"{folder}/candidate_pairs.tsv")
    write_tsv(joined_lists(left, kept.filter("sel"), q, "matched_entity_ids"), f"{folder}/matching_results.tsv")


class Artifacts:
    """Named Parquet tables in a folder, read from the first of several folders that has them."""

    def __init__(self, spark: SparkSession, folder: str, fallbacks: Sequence[str] = ()):
        self.spark, self.folder, self.folders = spark, folder, [folder, *fallbacks]

    def save(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def load(self, name: str) -> DataFrame:
        for folder in self.folders:
            try:
                return self.spark.read.parquet(f"{folder}/{name}")
            except AnalysisException as missing:
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
        raise FileNotFoundError(f"{name} in none of {self.folders}")

    def exists(self, name: str) -> bool:
        try:
            self.load(name)
        except FileNotFoundError:
            return False
        return True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new one only on a local master without any, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own
