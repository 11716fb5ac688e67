"""Names parsed into comparable fields, with built-in functions after the folding to ASCII."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import tables, text
from tessera.functions.columns import among, let, literal_map, lookup

#: Fixes that can be switched off by name.
FIXES = ("lex_country", "fr_saint", "fr_bis", "edge_digits", "name_noise_nums", "ms", "place_words", "india_floor", "state_fill")


def fixes(off: Iterable[str] | str = ()) -> frozenset[str]:
    """The fixes left on; "all" switches all off. An unknown name is an error."""
    off = [off] if isinstance(off, str) else list(off)
    names = [n.strip() for part in off for n in part.split(",") if n.strip()]
    if names == ["all"]:
        return frozenset()
    if unknown := set(names) - set(FIXES):
        raise KeyError(f"unknown fixes: {sorted(unknown)}; known: {FIXES}")
    return frozenset(FIXES) - set(names)


def scoped_swaps(swaps: Mapping[str, Mapping[str, str]] | Mapping[str, str], country: Column) -> Column:
    """The learned swaps (map column) for a country: its own, or those of "*"; flat ones hold everywhere."""
    if all(isinstance(v, str) for v in swaps.values()):
        swaps = {"*": swaps} if swaps else {}
    out = literal_map(swaps.get("*", {}))
    for name, own in swaps.items():
        if name != "*" and own:
            out = F.when(F.lower(F.trim(country)) == name, literal_map(own)).otherwise(out)
    return out


def _edge_trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(tables.EDGE_STRIP))


def words_of(value: Column, swaps: Column, on: frozenset[str] = frozenset(FIXES)) -> Column:
    """struct(domain, words): the stem of a URL or hashtag if that is all there is, else the words after mending and swaps."""

    def tokens(p: Column) -> Column:
        plain = F.replace(F.replace(text.inner_digits(p), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
        raw = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")
        if "edge_digits" in on:
            mixed = lambda w: ~F.rlike(w, F.lit("^(?:[a-z]+|[0-9]+)$"))
            raw = F.transform(raw, lambda w: F.when(mixed(w), text.edge_digits(w)).otherwise(w))
        mapped = F.transform(raw, lambda w: F.coalesce(F.try_element_at(swaps, w), w))
        return let(mapped, lambda ws: F.filter(ws, lambda w, i: (i == 0) | (w != F.get(ws, i - 1))))

    def parsed(p: Column) -> Column:
        stem = F.regexp_replace(F.concat(F.regexp_extract(p, tables.DOMAIN, 1), F.regexp_extract(p, tables.HASHTAG, 1)), "-", "")
        return F.struct((stem != "").alias("domain"), F.when(stem != "", F.array(stem)).otherwise(tokens(p)).alias("words"))

    return let(_edge_trimmed(value), parsed)


def _core(parsed: Column) -> Column:
    dropped = [*tables.LEGAL, *tables.NAME_DROP]
    return F.when(parsed["domain"], parsed["words"]).otherwise(F.filter(parsed["words"], lambda w: ~among(dropped, w)))


def _legal(parsed: Column) -> Column:
    forms = F.array_compact(F.transform(parsed["words"], lambda w: lookup(tables.LEGAL, w)))
    split = F.filter(F.split(F.array_join(forms, " "), " "), lambda w: w != "")
    return F.when(parsed["domain"], F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(split)))


def split_legal(words: Column) -> Column:
    """struct of core (without legal forms and stop words) and legal (the legal forms, sorted) of a name's words."""
    parsed = F.struct(F.lit(False).alias("domain"), words.alias("words"))
    return let(parsed, lambda p: F.struct(_core(p).alias("core"), _legal(p).alias("legal")))


def _full(parsed: Column) -> Column:
    return F.when(parsed["domain"], parsed["words"]).otherwise(F.filter(parsed["words"], lambda w: ~among(tables.NAME_DROP, w) | among(tables.LEGAL, w)))


def parse_name(raw: Column, country: Column, lexicon: Mapping | None = None, on: frozenset[str] = frozenset(FIXES)) -> Column:
    """struct of core, sorted, concat, alt, legal, tokens, phon, is_domain, is_indic, nums, gw, ini, sib, churn.

    lexicon: name_indic (word -> Latin word) and name_map (country or "*" -> word -> word), as operators.lexicon learns
    them. The part after an alias mark is the name, the part before it is alt; of parts parted by | the first counts.
    A null name is empty.
    """
    lexicon = lexicon or {}
    raw = F.coalesce(raw, F.lit(""))
    if indic := lexicon.get("name_indic"):
        swapped = F.array_join(F.transform(F.filter(F.split(raw, r"\s+"), lambda w: w != ""), lambda w: F.coalesce(lookup(indic, w), w)), " ")
        raw_in = F.when(text.is_indic(raw), swapped).otherwise(raw)
    else:
        raw_in = raw
    swaps = scoped_swaps(lexicon.get("name_map", {}), country)

    def of_folded(s: Column) -> Column:
        first = F.coalesce(F.get(F.filter(F.split(s, r"\|"), lambda p: F.trim(p) != ""), F.lit(0)), F.lit(""))
        one = F.when(F.contains(s, F.lit("|")), first).otherwise(s)
        clean = text.strip_noise(F.regexp_replace(one, tables.PLACE_NOTE, " "), "ms" in on, "name_noise_nums" in on)
        return let(clean, of_clean)

    def of_clean(s: Column) -> Column:
        return let(F.split(s, tables.ALIAS, 2), lambda parts: of_parts(s, parts))

    def of_parts(s: Column, parts: Column) -> Column:
        renamed = (F.size(parts) == 2) & (F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))) != "")
        name = F.when(renamed, F.get(parts, F.lit(1))).otherwise(s)
        alias = F.when(renamed, F.get(parts, F.lit(0))).otherwise(F.lit(""))
        both = F.struct(words_of(name, swaps, on).alias("name"), words_of(alias, swaps, on).alias("alias"))
        return let(both, lambda b: of_words(b["name"], b["alias"]))

    def of_words(name: Column, alias: Column) -> Column:
        own = F.struct(_core(name).alias("core"), _legal(name).alias("legal"), _full(name).alias("full"))
        return let(own, lambda o: of_core(o, name["domain"], _core(alias)))

    def of_core(o: Column, domain: Column, alt: Column) -> Column:
        core = F.when(F.size(o["core"]) > 0, o["core"]).when(F.size(o["legal"]) > 0, o["legal"]).otherwise(o["full"])
        return let(core, lambda c: let(F.array_sort(F.array_distinct(c)), lambda u: fields(o, domain, alt, c, u)))

    def fields(o: Column, domain: Column, alt: Column, core: Column, unique: Column) -> Column:
        digits = lambda w: F.rlike(w, F.lit("^[0-9]+$"))
        number = lambda w: F.regexp_extract(w, "([0-9]{1,12})$", 1).cast("long")
        return F.struct(
            F.array_join(core, " ").alias("core"),
            F.array_join(unique, " ").alias("sorted"),
            F.array_join(F.when(F.size(o["full"]) > 0, o["full"]).otherwise(core), "").alias("concat"),
            F.array_join(alt, " ").alias("alt"),
            F.array_join(o["legal"], " ").alias("legal"),
            unique.alias("tokens"),
            F.array_sort(F.array_distinct(F.transform(F.filter(unique, lambda w: ~digits(w)), text.phonetic_key))).alias("phon"),
            domain.cast("int").alias("is_domain"),
            text.is_indic(raw).cast("int").alias("is_indic"),
            F.array_sort(F.array_distinct(F.transform(F.filter(unique, digits), number))).alias("nums"),
            text.word_classes(unique, tables.GROUP_WORDS).alias("gw"),
            F.array_join(F.transform(core, lambda w: F.substring(w, 1, 1)), "").alias("ini"),
            text.word_classes(unique, tables.SIBLING_WORDS).alias("sib"),
            text.word_classes(unique, tables.CHURN_WORDS).alias("churn"),
        )

    return let(text.ascii_fold(raw_in), of_folded)
