"""Training pools shaped like the test data: pool sizes and right records per left record.

All draws are seeded hashes of ids, so that membership does not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.models import uniform


@dataclass(frozen=True)
class Pool:
    """A pool: its country, the share of the country's left records that it takes, the share of those that it drops."""

    name: str
    country: str
    keep: float
    drop: float


def counts_by_country(records: DataFrame) -> dict[str, tuple[int, int]]:
    """country -> (left records, right records). records: country, src; other columns are not read."""
    return {r["country"]: (r["left"], r["right"]) for r in country_counts(records).collect()}  # a row for each country


def country_counts(records: DataFrame) -> DataFrame:
    """country, left, right: numbers of records."""
    return records.groupBy("country").agg(F.count_if(F.col("src") == 1).alias("left"), F.count_if(F.col("src") > 1).alias("right"))


def density_gaps(kept: DataFrame, wanted: Mapping[str, float], limit: float = 0.02, least: int = 20_000) -> dict[str, float]:
    """Pools whose right records per left record are further than limit from what is wanted, with the gap; pools of fewer than
    `least` left records are not judged, as chance alone takes them that far. kept: pool, src."""
    rows = kept.groupBy("pool").agg(F.count_if(F.col("src") == 1).alias("left"), F.count_if(F.col("src") > 1).alias("right")).collect()  # a row for each pool
    gaps = {r["pool"]: abs(r["right"] / r["left"] / wanted[r["pool"]] - 1) for r in rows if r["left"] >= least and r["pool"] in wanted}
    return {pool: gap for pool, gap in gaps.items() if gap > limit}


def check_density(kept: DataFrame, wanted: Mapping[str, float], **how) -> None:
    """An error if density_gaps finds any."""
    if gaps := density_gaps(kept, wanted, **how):
        raise ValueError(f"pools are not as dense as wanted: {gaps}")


def extra_pools(train: Mapping[str, tuple[int, int]], test: Mapping[str, tuple[int, int]], cap: float = 1.0) -> list[dict]:
    """One extra pool for each test country that training lacks, cut from the country with most left records to spare."""
    usable = sorted(c for c, (n, m) in train.items() if n and m)
    unseen = sorted(c for c, (n, _) in test.items() if n and not train.get(c, (0, 0))[0])

    def spare(c: str) -> float:
        n, m = train[c]
        return (1 - min(1.0, cap * test[c][1] / m)) * n if test.get(c, (0, 0))[0] else 0.0

    donor = max(usable, key=spare, default=None)
    if donor is None or not unseen or spare(donor) <= 0:
        return []
    out: list[dict] = []
    for u in unseen:
        k = 2
        while (name := f"{donor}_{u[:k]}") in {p["name"] for p in out} | set(usable) and k <= len(u) + 1:
            k += 1
        out.append({"name": name, "from": donor, "like": u})
    return out


def plan_pools(train: Mapping[str, tuple[int, int]], test: Mapping[str, tuple[int, int]], extras: Sequence[Mapping] = (), cap: float = 1.0, drop: float = 0.19) -> list[Pool]:
    """Each country's own pool and the extra ones. keep = min(1, cap * test size / train size); drop makes the density that of test.
    Shares of one country above 1 are scaled down together; a country without test records keeps cap and drops `drop`."""
    out = []
    for country in sorted(train):
        n, m = train[country]
        if not (n and m and test.get(country, (0, 0))[0]):
            out.append(Pool(country, country, min(1.0, cap), drop))
            continue
        rows = []
        for name, like in [(country, country), *((e["name"], e["like"]) for e in extras if e["from"] == country)]:
            n_test, m_test = test[like]
            rows.append((name, min(1.0, cap * m_test / m), max(0.0, 1 - (m / n) / (m_test / n_test))))
        scale = max(1.0, sum(k for _, k, _ in rows))
        out += [Pool(name, country, k / scale, d) for name, k, d in rows]
    return out


def sample_pools(records: DataFrame, truth: DataFrame, pools: Sequence[Pool], seed: int = 42) -> DataFrame:
    """The kept records with their pool. records: id, src, country; truth: a, b, where b has one owner.

    A left record's draw decides its pool; its matches follow it, other right records draw on their own. Dropped left
    records leave their matches as distractors; the matches of unused ones are gone.
    """
    names = [p.name for p in pools]
    if len(set(names)) != len(names):
        raise ValueError(f"pool names collide: {names}")

    def pool_of(u, what: str):
        out, low = F.lit(None).cast("string" if what == "name" else "double"), {}
        for p in pools:
            lo = low.get(p.country, 0.0)
            low[p.country] = lo + p.keep
            out = F.when((F.col("country") == p.country) & (u >= lo) & (u < lo + p.keep), F.lit(getattr(p, what))).otherwise(out)
        return out

    u1 = uniform("id", seed + 2)
    left = records.filter("src = 1").withColumn("pool", pool_of(u1, "name")).withColumn("_d", pool_of(u1, "drop")).filter("pool IS NOT NULL")
    kept = left.filter(uniform("id", seed + 1) >= F.col("_d")).drop("_d")
    owners = truth.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("a"))
    right = records.filter("src > 1").join(owners, "id", "left")
    follow = right.filter("a IS NOT NULL").join(left.select(F.col("id").alias("a"), "pool"), "a").drop("a")
    free = right.filter("a IS NULL").drop("a").withColumn("pool", pool_of(uniform("id", seed + 3), "name")).filter("pool IS NOT NULL")
    return kept.unionByName(follow).unionByName(free)


def sample_share(records: DataFrame, truth: DataFrame, keep: float, drop: float, seed: int = 42) -> DataFrame:
    """A share of the left records with their matches and of the other right records; then some left records are dropped, their matches stay."""
    left = records.filter("src = 1").filter(uniform("id", seed + 2) < keep)
    owned = truth.join(left.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("_o", F.lit(True))
    right = records.filter("src > 1").join(owned, "id", "left").filter(F.col("_o").isNotNull() | (uniform("id", seed + 3) < keep)).drop("_o")
    return left.filter(uniform("id", seed + 1) >= drop).unionByName(right)


def sample_small(records: DataFrame, truth: DataFrame, n_left: int, distractors: float = 0.25, seed: int = 42) -> DataFrame:
    """n_left left records (about), their matches, and a share of the rest of the right ones relative to those kept."""
    total = records.filter("src = 1").count()
    share = min(1.0, n_left / max(total, 1))
    left = records.filter("src = 1").filter(uniform("id", seed) < share)
    owned = truth.join(left.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("_o", F.lit(True))
    right = records.filter("src > 1").join(owned, "id", "left").filter(F.col("_o").isNotNull() | (uniform("id", seed + 3) < share * distractors)).drop("_o")
    return left.unionByName(right)
