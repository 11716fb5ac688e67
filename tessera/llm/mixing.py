"""Mixing sources to target weights by hierarchical budgets.

Leaves are the sources of the tree domain > language > source. A node's budget is split among its children by weight; no
child gets more than its subtree can give (its tokens times max_epochs), and what one cannot use goes to its siblings in
proportion to their weights. Since a node's own budget never exceeds what its subtree can give, a shortage moves up only
once the siblings are full. Each level is one window over sorted capacity-to-weight ratios, so no loop runs on the driver.

A leaf passes through its documents in a seeded order, anew in every epoch, and takes documents while the tokens before
them are below its budget. The place of a document in that order is found in two steps, by sums over equal parts (bins) of
the order and then inside the one part where the budget ends, so that a huge leaf is never sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm import _exchange as ex
from tessera.llm import bpe

LEVELS = ("domain", "language", "source")
#: Rows that a bin and a salted part of a leaf are meant to hold.
BIN_ROWS, PART_ROWS = 1000, 50_000

#: Domains of the source numbers in `documents`, and weights; a node that is not named has weight 1.
WEIGHTS = {
    "domain": {"web": 6.0, "books": 3.0, "code": 1.0},
    "language": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {"src0": 2.0, "src1": 3.0},
}


def domain_of(source: Column) -> Column:
    """The domain that the tables' source names stand for: by number, in thirds; other names are web."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS int)")
    return F.when(n % 3 == 1, "books").when(n % 3 == 2, "code").otherwise("web")


def split_budget(nodes: DataFrame, parents: list[str], own: str) -> DataFrame:
    """Adds column `own`: the part of each parent's `budget` that a child gets. nodes: parents, name, weight, capacity, budget.

    With ratios r = capacity / weight in rising order, children are filled up while filling all later ones to the same
    ratio stays within the budget; the others share the rest by weight.
    """
    w = Window.partitionBy(*parents).orderBy("ratio", own)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumn("ratio", F.col("capacity") / F.col("weight"))
    nodes = nodes.withColumn("_given", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("_weights", F.sum("weight").over(after))
    nodes = nodes.withColumn("_level", (F.col("budget") - F.col("_given")) / F.col("_weights"))
    full = F.col("ratio") <= F.col("_level")
    level = F.min(F.when(~full, F.struct(F.col("ratio"), F.col(own), F.col("_level").alias("level")))).over(Window.partitionBy(*parents))["level"]
    share = F.when(full | level.isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("weight") * level))
    return nodes.withColumn("part", share).drop("ratio", "_given", "_weights", "_level", "budget").withColumnRenamed("part", "budget")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: Column, max_epochs: int) -> DataFrame:
    """domain, language, source, tokens, budget of every leaf. leaves: domain, language, source, tokens."""

    def weight(level: str) -> Column:
        out = F.lit(1.0)
        for name, value in sorted(weights.get(level, {}).items()):
            out = F.when(F.col(level) == name, F.lit(float(value))).otherwise(out)
        return out

    capacity = F.sum("tokens").cast("double") * max_epochs
    tree = leaves.groupBy("domain").agg(capacity.alias("capacity"), F.sum("tokens").alias("tokens"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    tree = tree.withColumn("root", F.lit(0)).withColumn("weight", weight("domain"))
    room = F.sum("capacity").over(Window.partitionBy("root"))
    tree = tree.withColumn("budget", F.least(F.coalesce(total, all_tokens.cast("double")), room))
    tree = split_budget(tree, ["root"], "domain").select("domain", "budget")
    for i in (1, 2):
        own, parents = LEVELS[i], list(LEVELS[:i])
        below = leaves.groupBy(*LEVELS[: i + 1]).agg(capacity.alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", weight(own))
        tree = split_budget(below.join(tree.select(*parents, "budget"), parents), parents, own).select(*parents, own, "tokens", "budget")
    return tree


def count_tokens(text: Column) -> Column:
    """Words of a text, as its tokens; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, float]],
    total_tokens: int | None = None,
    share: float | None = None,
    max_epochs: int = 1,
    seed: int = 0,
    columns: list[str] | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """The chosen rows of docs (or columns of it), once for each epoch that takes them, with domain, n_tokens, epoch and
    tokens_before (in the leaf, over all epochs).

    docs: doc_id long, text, lang, source strings, and domain if there is one (else domain_of(source)). The budget is
    total_tokens, or share of all tokens, or all tokens; tokens counts a row's (words if not given). Null languages, sources and domains are leaves of their own,
    named ''. Documents without words are taken like others and cost nothing; nothing is taken of a leaf with no tokens.
    Documents with equal ids are ordered by their texts' digests, equal rows by chance. Null ids sort as ''. Input
    columns of the made names are replaced, others may have any name; an empty table gives an empty result.
    """
    made = ["domain", "n_tokens", "epoch", "epoch_start"]
    keep = [c for c in (columns or docs.columns) if c not in made]
    domain = F.col("domain").cast("string") if "domain" in docs.columns else domain_of(F.col("source"))
    named = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"),
        *(F.coalesce(c, F.lit("")).alias(n) for c, n in ((domain, "_domain"), (F.col("lang").cast("string"), "_language"), (F.col("source").cast("string"), "_source"))),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("_tie"),
        (count_tokens(F.col("text").cast("string")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))).alias("n_tokens"),
    ).withColumnsRenamed({"_domain": "domain", "_language": "language", "_source": "source"})
    named = ex.materialise(named, "mixing")
    leaf = list(LEVELS)

    leaves = ex.materialise(named.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves", small=True)
    most = leaves.agg(F.coalesce(F.max("rows"), F.lit(1))).first()[0]  # one number
    digits, salts = max(1, math.ceil(math.log(max(1, most / BIN_ROWS), 16))), -(-most // PART_ROWS)
    total = F.lit(None).cast("double") if total_tokens is None else F.lit(float(total_tokens))
    if total_tokens is None and share is not None:
        total = F.lit(float(share)) * F.sum("tokens").over(Window.partitionBy(F.lit(0))).cast("double")
    plan = ex.materialise(budgets(leaves, weights, total, max_epochs), "budgets").withColumn("budget", F.round("budget", 6))

    # Whole epochs take every document; the epoch in which the budget ends takes a prefix.
    plan = plan.filter("tokens > 0").withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    whole = F.least(F.col("whole"), F.lit(max_epochs)).cast("int")
    plan = plan.select(*leaf, "tokens", whole.alias("whole"), "rest")
    # One row a leaf against the documents: salted, as one leaf may hold a third of them.
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = named.withColumn("salt", F.pmod(F.xxhash64("_id", "_tie"), F.lit(salts)).cast("int")).join(salted, [*leaf, "salt"])
    digest = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("_id")).cast("binary"))

    # Whole epochs: places are known up to the order, which does not matter for taking; tokens_before is the epoch's.
    full = rows.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole")))).withColumn("tokens_before", (F.col("epoch") - 1) * F.col("tokens"))
    part = rows.filter("rest > 0").withColumn("epoch", F.col("whole") + 1).withColumn("key", digest(F.col("whole") + 1)).withColumn("bin", F.substring("key", 1, digits))
    bins = part.groupBy(*leaf, "bin").agg(F.sum("n_tokens").alias("in_bin"))
    ahead = F.coalesce(F.sum("in_bin").over(Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    bins = bins.withColumn("ahead", ahead).join(plan.select(*leaf, "rest"), leaf)
    bins = bins.filter("ahead < rest").select(*leaf, "bin", "ahead", (F.col("ahead") + F.col("in_bin") < F.col("rest")).alias("inside"))
    near = part.drop("salt").join(bins, [*leaf, "bin"])
    order = Window.partitionBy(*leaf, "bin").orderBy("key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = near.filter("NOT inside").withColumn("_in", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")))
    edge = edge.filter(F.col("ahead") + F.col("_in") < F.col("rest"))
    out = ["_row", "domain", "n_tokens", "epoch", "tokens_before"]
    start = F.col("whole") * F.col("tokens")
    taken = full.select(*out).unionByName(near.filter("inside").withColumn("tokens_before", start).select(*out)).unionByName(edge.withColumn("tokens_before", start).select(*out))
    return taken.select(*(F.col("_row").getField(c).alias(c) for c in keep), "domain", "n_tokens", F.col("epoch").cast("long").alias("epoch"), F.col("tokens_before").cast("long").alias("epoch_start"))


#: Share of the pipeline's tokens that the mix takes.
PIPELINE_SHARE = 0.9


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: nine tenths of all byte-level BPE tokens, mixed to WEIGHTS, each document at most once, with the columns of docs.

    Nulls, empty and long texts, ties, repeated rows and empty tables: as in mix. A column `domain` is used as in mix; a
    column that has the name of a made one comes through unchanged, like all others.
    """
    import public_tokenizers

    given = [c for c in ("doc_id", "text", "lang", "source", "domain") if c in docs.columns]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), *given)
    counted = bpe.with_counts(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), "_bpe")
    out = mix(counted, WEIGHTS, share=PIPELINE_SHARE, max_epochs=1, seed=11, columns=["_all"], tokens=F.col("_bpe"))
    return out.select(*(F.col("_all").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch, epoch_start of the documents that up to three epochs take, mixed to WEIGHTS."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, WEIGHTS, share=1.0, max_epochs=3, seed=11, columns=["doc_id", "lang", "source"])


def _sql(share: float, epochs: int, seed: int, leaf_share: str = "") -> str:
    def weight(level: str, col: str) -> str:
        return "(CASE " + " ".join(f"WHEN {col} = '{n}' THEN {v}" for n, v in WEIGHTS[level].items()) + " ELSE 1.0 END)::DOUBLE"

    def level(name: str, nodes: str, part: str, own: str) -> str:
        return f"""
{name}_a AS (SELECT *, capacity / weight AS ratio FROM {nodes}),
{name}_b AS (SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY {part} ORDER BY ratio, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (PARTITION BY {part} ORDER BY ratio, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {name}_a),
{name}_c AS (SELECT *, max(CASE WHEN ratio > lev THEN lev END) OVER (PARTITION BY {part}) AS flat FROM {name}_b),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN ratio <= lev OR flat IS NULL THEN capacity ELSE least(capacity, weight * flat) END AS budget FROM {name}_c)"""

    return rf"""
WITH docs AS (
  SELECT doc_id, lang, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens,
    CASE TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'web' END AS domain FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
d0 AS (SELECT domain, sum(tokens)::DOUBLE * {epochs} AS capacity, {weight("domain", "domain")} AS weight, (least({share}, {epochs}) * (SELECT sum(tokens) FROM leaves))::DOUBLE AS budget FROM leaves GROUP BY domain),
{level("d", "d0", "1", "domain")},
l0 AS (SELECT l.domain, lang, sum(tokens)::DOUBLE * {epochs} AS capacity, {weight("language", "lang")} AS weight, min(d.budget) AS budget FROM leaves l JOIN d ON d.domain = l.domain GROUP BY l.domain, lang),
{level("l", "l0", "domain", "lang")},
s0 AS (SELECT v.domain, v.lang, v.source, tokens, tokens::DOUBLE * {epochs} AS capacity, {weight("source", "v.source")} AS weight, l.budget FROM leaves v JOIN l ON l.domain = v.domain AND l.lang = v.lang),
{level("s", "s0", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, tokens, round(budget, 6) AS budget FROM s WHERE tokens > 0),
passes AS (
  SELECT d.*, p.tokens, p.budget, e.epoch, (e.epoch - 1) * p.tokens AS epoch_start,
    (e.epoch - 1) * p.tokens + coalesce(sum(d.n_tokens) OVER (PARTITION BY p.domain, p.lang, p.source, e.epoch ORDER BY md5('{seed}:' || e.epoch || ':' || d.doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN plan p ON p.domain = d.domain AND p.lang = d.lang AND p.source = d.source CROSS JOIN (SELECT unnest(range(1, {epochs} + 1)) AS epoch) e
)
SELECT doc_id, lang, source, domain, n_tokens, epoch, epoch_start::BIGINT AS epoch_start FROM passes WHERE before < budget OR epoch * tokens <= budget
"""


SQL = _sql(1.0, 3, 11)
