"""Small helpers on columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once; a plain column would be computed anew wherever a lambda mentions it."""
    return F.transform(F.array(value), body).getItem(0)


def literal_map(pairs: Mapping[str, str]) -> Column:
    """A constant map<string, string>; an empty one for no pairs."""
    if not pairs:
        return F.from_json(F.lit("{}"), "map<string,string>")
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def lookup(pairs: Mapping[str, str], key: Column) -> Column:
    """pairs[key], null if absent."""
    return F.try_element_at(literal_map(pairs), key)


def among(words, value: Column) -> Column:
    return value.isin(list(words))


def replace_each(value: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, value)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
