"""Isotonic calibration: quantile bins aggregated by Spark, pool-adjacent-violators over the bins on the driver."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool_adjacent(y: list[float], w: list[float]) -> list[float]:
    """The rising sequence nearest to y in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, q, n = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * q) / (last[1] + q)
            last[1] += q
            last[2] += n
    return [v for v, _, n in blocks for _ in range(int(n))]


def fit_isotonic(rows: DataFrame, p: str = "p", y: str = "y", bins: int = 4000) -> tuple[list[float], list[float]]:
    """Knots (x, y) of a rising map from scores to match rates, over quantile bins of the scores; empty for no rows."""
    edges = rows.agg(F.percentile(p, F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("e")).first()["e"]
    if not edges or edges[0] is None:
        return [], []
    edges = sorted(set(edges))
    bin_of = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(p))) if len(edges) <= 64 else _bisect(edges, F.col(p))
    got = rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y")).orderBy("bin").collect()  # at most bins + 1 rows
    return [r["p"] for r in got], pool_adjacent([r["y"] for r in got], [r["n"] for r in got])


def _bisect(edges: list[float], value: Column) -> Column:
    """How many of the sorted edges are at most the value, by halving."""
    table = F.array(*map(F.lit, edges))
    lo_hi = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        return F.when(acc["lo"] >= acc["hi"], acc).when(F.get(table, mid) <= value, lo_hi(mid + 1, acc["hi"])).otherwise(lo_hi(acc["lo"], mid))

    steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1))
    return F.aggregate(steps, lo_hi(F.lit(0), F.lit(len(edges))), halve, lambda acc: acc["lo"])


def apply_isotonic(value: Column, knots: tuple[list[float], list[float]]) -> Column:
    """Linear interpolation between the knots, flat beyond the first and the last."""
    xs, ys = knots
    if not xs:
        return value
    keep = [i for i in range(len(xs)) if i == 0 or xs[i] > xs[i - 1]]
    xs, ys = [float(xs[i]) for i in keep], [float(ys[i]) for i in keep]
    k = _bisect(xs, value)
    x, y = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    x0, x1, y0, y1 = F.get(x, k - 1), F.get(x, k), F.get(y, k - 1), F.get(y, k)
    return F.when(k == 0, ys[0]).when(k == len(xs), ys[-1]).otherwise(y0 + (y1 - y0) * (value - x0) / (x1 - x0))


def fit_by_group(rows: DataFrame, group: str = "country", least: int = 1_000_000, **args) -> dict[str, tuple]:
    """A map for each group with `least` rows, and "*" over all."""
    sizes = rows.groupBy(group).count().filter(F.col("count") >= least).collect()  # a row for each group
    return {"*": fit_isotonic(rows, **args)} | {r[group]: fit_isotonic(rows.filter(F.col(group) == r[group]), **args) for r in sizes}


def calibrated(value: Column, maps: Mapping[str, tuple], group: str = "country", unseen: Mapping[str, str] | None = None) -> Column:
    """Each group's own map, else that of the group that unseen names, else "*"."""
    out = apply_isotonic(value, maps["*"])
    for name, knots in maps.items():
        if name != "*":
            out = F.when(F.col(group) == name, apply_isotonic(value, knots)).otherwise(out)
    for name, like in (unseen or {}).items():
        if name not in maps and like in maps:
            out = F.when(F.col(group) == name, apply_isotonic(value, maps[like])).otherwise(out)
    return out
