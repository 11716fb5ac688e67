"""Similarity of two strings, token sets or number sets.

Column functions are built-ins throughout; Jaro-Winkler and what rests on it are Arrow UDFs, as Spark has no such built-in.
Missing is null: a comparison that means nothing (both sets empty, say) is null, not zero, where a model should see that.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import let, total

# ---------------------------------------------------------------- strings


def jaro_winkler(a: str, b: str, floored: bool = False) -> float:
    """Jaro-Winkler similarity. The prefix counts always and half transpositions stay halves; floored: transpositions are
    rounded down, the prefix counts only above a Jaro similarity of 0.7 and is added with one rounding, as SQL engines do it:
    otherwise the last bit differs, and with it thresholds and rounded values."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)  # the next place to try is the last
    left, taken = [], []
    for i, c in enumerate(a):
        free = places.get(c)
        if not free:
            continue
        while free and free[-1] < i - reach:
            free.pop()
        if free and free[-1] <= i + reach:
            left.append(c)
            taken.append(free.pop())
    if not left:
        return 0.0
    m = len(left)
    half = sum(c != b[j] for c, j in zip(left, sorted(taken), strict=True))
    swaps = half // 2 if floored else half / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    if floored:
        return math.fma(0.1 * prefix, 1 - jaro, jaro) if jaro > 0.7 else jaro
    return jaro + 0.1 * prefix * (1 - jaro)


def _scalar(f: Callable[..., float | None]):
    """An Arrow UDF of a function of one row's values; a null argument gives null."""

    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*(c.array for c in columns), strict=True)
        return pd.Series([None if any(v is None or v is pd.NA or (isinstance(v, float) and v != v) for v in row) else f(*row) for row in rows], dtype="float64")

    return run


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scalar(jaro_winkler)(a, b)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_floored(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scalar(lambda x, y: jaro_winkler(x, y, floored=True))(a, b)


def jaro_winkler_column(a: Column, b: Column, convention: str = "half") -> Column:
    """convention "half" (see jaro_winkler) or "floored", which is that of common SQL engines."""
    return {"half": jaro_winkler_udf, "floored": jaro_winkler_floored}[convention](a, b)


def lev_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are equal, one empty string shares nothing."""
    longest = F.greatest(F.length(a), F.length(b))
    # the distance takes time with the product of the lengths, so equal strings go first
    return F.when((longest == 0) | (a == b), 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common prefix / shorter length; 0 if one is empty. By bisection, so long strings cost little."""
    shorter = F.least(F.length(a), F.length(b))
    halves = F.sequence(F.lit(1), F.lit(31))
    bounds = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
        same = F.substr(a, F.lit(1), mid) == F.substr(b, F.lit(1), mid)
        return F.when(acc["lo"] >= acc["hi"], acc).when(same, bounds(mid, acc["hi"])).otherwise(bounds(acc["lo"], mid - 1))

    common = F.aggregate(halves, bounds(F.lit(0), shorter), halve, lambda acc: acc["lo"])
    return F.when(shorter > 0, common / shorter).otherwise(0.0)


def trigrams(s: Column) -> Column:
    """One gram for each character, with ^ before the first and $ after the last."""
    # by an array of the characters: a substring of a long string is counted out from its beginning each time
    gram = lambda cs, i: F.concat(F.get(cs, i), F.get(cs, i + 1), F.get(cs, i + 2))
    grams = let(F.split(F.concat(F.lit("^"), s, F.lit("$")), ""), lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - 3), lambda i: gram(cs, i)))
    return F.when(F.length(s) > 0, grams).otherwise(F.array().cast("array<string>"))


def numbered_trigrams(s: Column) -> Column:
    """The trigrams, each with the number of its occurrence, so that multisets can be intersected as sets: ab, ab -> ab1, ab2."""
    # sorted grams as one string, cut into runs of the same gram by a regex, and each run numbered again
    runs = F.regexp_extract_all(F.concat(F.array_join(F.sort_array(trigrams(s)), "\x01"), F.lit("\x01")), F.lit("(?s)(...\\x01)\\1*"), F.lit(0))
    of_run = lambda r: F.transform(F.sequence(F.lit(1), (F.length(r) / 4).cast("int")), lambda k: F.concat(F.substring(r, 1, 3), k.cast("string")))
    return F.flatten(F.transform(runs, of_run))


def dice_of_grams(a: Column, b: Column) -> Column:
    """2 * shared / all of two arrays of numbered trigrams; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def tri_dice(a: Column, b: Column) -> Column:
    """dice_of_grams of two strings; where a record is in many pairs, numbered_trigrams is better made once a record."""
    return dice_of_grams(numbered_trigrams(a), numbered_trigrams(b))


# ---------------------------------------------------------------- sets


def jaccard(a: Column, b: Column) -> Column:
    """Shared / all elements; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def set_stats(a: Column, b: Column) -> Column:
    """struct of shared, ss, sa, sb, most of two arrays of struct(token, idf): counts, sums of squared weights of the shared
    tokens and of either side, the largest shared weight (0 if none). A token must have one idf.

    Tokens are intersected as strings that carry their idf: strings are hashed, structs would be compared pair by pair.
    """
    text = lambda x: F.transform(x, lambda t: F.concat(t["idf"].cast("string"), F.lit(" "), t["token"]))
    weights = F.transform(F.array_intersect(text(a), text(b)), lambda s: F.substring_index(s, " ", 1).cast("double"))
    square = lambda x: total(F.transform(x, lambda w: w * w))
    own = lambda x: square(F.transform(x, lambda t: t["idf"]))
    return let(weights, lambda w: F.struct(
        F.size(w).alias("shared"), square(w).alias("ss"), own(a).alias("sa"), own(b).alias("sb"), F.coalesce(F.array_max(w), F.lit(0.0)).alias("most"),
    ))


def cosine(ss: Column, sa: Column, sb: Column) -> Column:
    return F.when((sa > 0) & (sb > 0), ss / F.sqrt(sa * sb)).otherwise(0.0)


def unmatched(ss: Column, s: Column) -> Column:
    """Share of a side's mass that the other lacks; null if it has none."""
    return F.when(s > 0, (s - ss) / s)


def category(a: Column, b: Column) -> Column:
    """0 both missing, 1 same, 2 one missing, 3 different; null is missing."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull() | b.isNull(), 2).when(a == b, 1).otherwise(3)


def acronym(initials_a: Column, core_a: Column, initials_b: Column, core_b: Column) -> Column:
    """Whether one side's initials, two at least, are the other's name without spaces."""
    one = lambda ini, core: (F.length(ini) >= 2) & (ini == F.replace(core, F.lit(" "), F.lit("")))
    return one(initials_a, core_b) | one(initials_b, core_a)


# ---------------------------------------------------------------- numbers


def fuzzy_numbers(x: Column, y: Column) -> Column:
    """Whether one of two different numbers from 10 on begins or ends the other's digits (as a number: 05 is 5). Numbers or digit
    strings without leading zeros."""
    a, b = x.cast("string"), y.cast("string")
    lo, hi = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != b) & (F.length(lo) >= 2) & (F.startswith(hi, lo) | F.endswith(hi, lo))


def near_number(x: Column, y: Column) -> Column:
    """Equal length, two digits at least, one digit different or two neighbours swapped."""
    a, b = x.cast("string"), y.cast("string")
    places = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))

    def swapped(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        return (F.size(p) == 2) & (F.get(p, F.lit(1)) == first + 1) & (F.reverse(F.substr(a, first, F.lit(2))) == F.substr(b, first, F.lit(2)))

    return (F.length(a) == F.length(b)) & (F.length(a) >= 2) & let(places, lambda p: (F.size(p) == 1) | swapped(p))


def one_deleted(x: Column, y: Column) -> Column:
    """Lengths differ by one, the shorter has two digits at least, and deleting one digit makes them equal."""
    a, b = x.cast("string"), y.cast("string")
    return (F.abs(F.length(a) - F.length(b)) == 1) & (F.least(F.length(a), F.length(b)) >= 2) & (F.levenshtein(a, b) == 1)


def any_pair(a: Column, b: Column, test: Callable[[Column, Column], Column], digits: int = 1) -> Column:
    """Whether some pair of different numbers of so many digits at least passes the test; null if a side has none."""
    long = lambda x: F.length(x.cast("string")) >= digits
    found = F.exists(F.filter(a, long), lambda x: F.exists(F.filter(b, long), lambda y: (x != y) & test(x, y)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), found)


def number_stats(a: Column, b: Column) -> Column:
    """struct of shared, n_a, n_b, conflict (both have some and share none) and fuzzy (a number of one side begins or ends
    a different one of the other)."""
    fuzzy = F.coalesce(any_pair(a, b, fuzzy_numbers, 2), F.lit(False))
    return F.struct(
        shared(a, b).alias("shared"), F.size(a).alias("n_a"), F.size(b).alias("n_b"),
        ((F.size(a) > 0) & (F.size(b) > 0) & (shared(a, b) == 0)).cast("int").alias("conflict"), fuzzy.cast("int").alias("fuzzy"),
    )


# ---------------------------------------------------------------- words against words


def _best(word: str, others: list[str]) -> float:
    return 1.0 if word in others else max((jaro_winkler(word, o) for o in others), default=0.0)


def monge_elkan(a: list[str], b: list[str]) -> float | None:
    """Mean over both directions of the words' best Jaro-Winkler similarities."""
    if not len(a) or not len(b):
        return None
    a, b = list(a), list(b)
    return (float(np.mean([_best(x, b) for x in a])) + float(np.mean([_best(y, a) for y in b]))) / 2


def domain_cover(stem: str, core: str) -> float | None:
    """Best share of a domain's stem that the other name's words (whole) or their initials (half) cover from left to right."""
    words = core.split()[:32]
    if not stem or len(stem) > 80 or not words:
        return None
    best = [0.0] + [-1.0] * len(stem)
    initials = {w[0] for w in words}
    for i, c in enumerate(stem):
        best[i + 1] = max(best[i + 1], best[i] + (0.5 if c in initials else 0.0))
        for w in words:
            if stem.startswith(w, i):
                best[i + len(w)] = max(best[i + len(w)], best[i] + len(w))
    return best[-1] / len(stem)


def soft_share(a: str, b: str) -> float | None:
    """Share of a's characters in words that b has, or nearly has (Jaro-Winkler from 0.9 on counts as much); first 40 words."""
    left, right = a.split()[:40], b.split()[:40]
    if not left or not right:
        return None
    scores = [(len(w), _best(w, right)) for w in left]
    return sum(n * s for n, s in scores if s >= 0.9) / sum(n for n, _ in scores)


def soft_idf(a: list, b: list) -> float | None:
    """Share of the words' idf that the other side has or nearly has (from 0.88 on), mean of both directions."""
    if not len(a) or not len(b):
        return None

    def one(left, right) -> float:
        others = [t["token"] for t in right]
        scores = [(t["idf"], _best(t["token"], others)) for t in left]
        weight = sum(w for w, _ in scores)
        return sum(w * s for w, s in scores if s >= 0.88) / weight if weight > 0 else 0.0

    return (one(a, b) + one(b, a)) / 2


@F.pandas_udf(T.DoubleType())
def monge_elkan_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else monge_elkan(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def domain_cover_udf(stem: pd.Series, core: pd.Series) -> pd.Series:
    return _scalar(domain_cover)(stem, core)


@F.pandas_udf(T.DoubleType())
def soft_share_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scalar(soft_share)(a, b)


@F.pandas_udf(T.DoubleType())
def soft_idf_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else soft_idf(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")
