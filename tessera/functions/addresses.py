"""Addresses parsed as unordered components."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import tables, text
from tessera.functions.columns import among, let, literal_map, lookup
from tessera.functions.names import FIXES, scoped_swaps


def _state_of(component: Column, country: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, states in tables.state_table().items():
        out = F.when(country == name, lookup(states, component)).otherwise(out)
    return out


def parse_address(raw: Column, country: Column, lexicon: Mapping | None = None, on: frozenset[str] = frozenset(FIXES)) -> Column:
    """struct of sorted, tokens, nums, state, masked, empty, digits.

    A component that names a state of the country is taken out, the first one counts. Words with digits give their digit
    runs as numbers and are no tokens. lexicon: addr_indic (component -> Latin component) and addr_map (country or "*" ->
    word -> word). A null or blank address is empty.
    """
    lexicon = lexicon or {}
    raw = F.coalesce(raw, F.lit(""))
    key = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    french, indian = key == "france", key == "india"
    placed = among(tables.PLACE_COUNTRIES, key) if "place_words" in on else F.lit(False)
    if indic := lexicon.get("addr_indic"):
        swapped = F.array_join(F.transform(F.split(raw, ","), lambda c: F.coalesce(lookup(indic, F.trim(c)), c)), ",")
        raw_in = F.when(text.is_indic(raw), swapped).otherwise(raw)
    else:
        raw_in = raw
    swaps = scoped_swaps(lexicon.get("addr_map", {}), key)

    def component(c: Column) -> Column:
        tidy = lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
        plain = tidy(c)
        return F.when(placed, tidy(F.regexp_replace(plain, r"\bcity corporation\b", " "))).otherwise(plain)

    def words(clean: Column) -> Column:
        """The tokens of a component; numbers and dropped words are null."""

        def token(ws: Column, w: Column, i: Column) -> Column:
            following = F.coalesce(F.get(ws, i + 1), F.lit(""))
            saint = (french if "fr_saint" in on else F.lit(False)) | ((i == 0) & (F.size(ws) > 1))
            named = (
                F.when(w == "st", F.when(saint, "saint").otherwise("street"))
                .when(w == "ste", F.when(F.rlike(following, F.lit("^[0-9]")), "suite").otherwise("sainte"))
                .when((w == "r") & F.rlike(following, F.lit("^[a-z]+$")), "rue")
                .otherwise(w)
            )
            suffix = among(tables.FRENCH_SUFFIX, w) & french if "fr_bis" in on else F.lit(False)
            gone = F.rlike(w, F.lit("[0-9]")) | suffix | (among(tables.PLACE_DROP, w) & placed)
            mapped = let(F.coalesce(F.try_element_at(literal_map(tables.ADDRESS_WORDS), named), named), lambda m: F.coalesce(F.try_element_at(swaps, m), m))
            return F.when(~gone, let(mapped, lambda m: F.when(~among(tables.ADDRESS_DROP, m), m)))

        return let(F.split(clean, " "), lambda ws: F.transform(ws, lambda w, i: token(ws, w, i)))

    def of_folded(s: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(s, tables.PO_BOX, " , "), tables.CARE_OF, " ")
        if "india_floor" in on:
            clean = F.when(indian, F.regexp_replace(F.regexp_replace(clean, tables.OLD_NUMBER, " "), tables.FLOOR, " ")).otherwise(clean)
        parts = F.filter(F.transform(F.split(clean, ","), lambda c: component(F.replace(c, F.lit("."), F.lit(" ")))), lambda c: c != "")
        named = F.transform(parts, lambda c: F.struct(c.alias("text"), _state_of(c, key).alias("state")))
        return let(named, lambda cs: of_components(s, cs))

    def of_components(s: Column, parts: Column) -> Column:
        rest = F.transform(F.filter(parts, lambda c: c["state"].isNull()), lambda c: c["text"])
        state = F.coalesce(F.get(F.filter(parts, lambda c: c["state"].isNotNull()), F.lit(0))["state"], F.lit(""))
        return let(rest, lambda r: fields(s, r, state))

    def fields(s: Column, rest: Column, state: Column) -> Column:
        tokens = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(rest, words)))))
        runs = F.flatten(F.transform(rest, lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))))
        numbers = F.transform(runs, lambda d: F.regexp_extract(d, "([0-9]{1,12})$", 1).cast("long"))
        glued = F.array_join(runs, "")
        return let(tokens, lambda t: F.struct(
            F.array_join(t, " ").alias("sorted"),
            t.alias("tokens"),
            F.array_sort(F.array_distinct(numbers)).alias("nums"),
            state.alias("state"),
            F.contains(s, F.lit("#")).cast("int").alias("masked"),
            (F.trim(raw) == "").cast("int").alias("empty"),
            F.regexp_extract(glued, "([0-9]{0,24})$", 1).alias("digits"),
        ))

    return let(text.ascii_fold(raw_in), of_folded)
