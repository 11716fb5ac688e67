"""Quality rules: distribution divergence from language references, with DataFrame functions alone.

Two histograms of a document, of character classes and of its language's common words, are compared by the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) with the language's reference: the sums over all documents that
pass the base rules, so that repetitive junk has no say in it. Guards on the length keep short texts from being judged by
chance. Base counts and rules come first.

Everything about one text is computed inside its row by array functions: no row per word leaves it. What crosses the
network is one row of sums per language and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _exchange as ex

_WS = r"[\x20\x09-\x0D]"
#: Character classes; what no class has is the last one, beyond ASCII.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": _WS, "stop": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@=+_~^/\\\[\]{}`]"}
#: Twenty of the most common words of each language known here.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that it was for on be with as are this by at from or".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
    "fr": "le la de et les des en un une du que qui dans est pour par sur au avec ce".split(),
}
N_COMMON = 20
_PUNCTUATION = ".,;:!?"
WINDOW = 5
#: Limits of the distances beyond what sampling alone gives (sampling_slack). The one of words is fit_base of sf0.1's labels, whose
#: sample is bounded; the one of classes has room for texts of unlike kinds (lists, quotes, numbers).
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.2, 0.8
MAX_WORD_DISTANCE = 0.1


def sampling_slack(cells: int) -> float:
    """s such that n draws from a distribution over so many cells lie about s / sqrt(n) from it: 8 ln(2) n times the divergence
    has a mean of cells - 1."""
    return math.sqrt((cells - 1) / (8 * math.log(2)))


WORD_SLACK = round(sampling_slack(N_COMMON + 1), 2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once (a plain column would be computed anew wherever a lambda mentions it)."""
    return F.transform(F.array(value), body).getItem(0)


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the text."""

    def cover(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(k > 0, same(k, -1)).otherwise(False) | same(k, 1))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(_let(order, places), start, step, lambda a: a["n"])

    def of(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW))))
        found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(cover(h)))
        return F.when(F.size(ws) >= WINDOW, found).otherwise(F.lit(0))

    return _let(words, of)


def _left(text: Column, pattern: str) -> Column:
    """text without the characters of a class."""
    return F.regexp_replace(text, F.lit(pattern + "+"), F.lit(""))


def _common(framed: Column, language: Column) -> Column:
    """How often each common word of the language stands in a framed text (each word between two line ends of its own)."""
    frames = {n: [f"\n{w}\n" for w in ws] for n, ws in COMMON.items()}

    def count(i: int) -> Column:
        word = F.lit(None).cast("string")
        for name, own in frames.items():
            word = F.when(language == name, F.lit(own[i])).otherwise(word)
        n = F.octet_length(framed) - F.octet_length(F.replace(framed, word, F.lit("")))
        return F.coalesce((n / F.octet_length(word)).cast("long"), F.lit(0).cast("long"))

    return F.array(*(count(i) for i in range(N_COMMON)))


def features(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A struct _row of docs' columns (or some of them) and a struct _q of counts of each text; a null text counts as empty."""
    keep = docs.columns if columns is None else columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang").cast("string")
    first = docs.select(
        (F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)).alias("_row"),
        F.when(lang.isin(list(COMMON)), lang).otherwise(F.lit("")).alias("language"),
        text.alias("text"),
        _left(text, CLASSES["lower"]).alias("rest"),
    )
    # each class is counted on what the classes before it left over, which gets shorter and shorter
    step = first.select("_row", "language", "text", F.length("text").alias("length"), F.length("rest").alias("n_lower"), _left(F.col("rest"), CLASSES["space"]).alias("rest"))
    step = step.withColumns({"n_space": F.length("rest"), "rest": _left(F.col("rest"), CLASSES["upper"])})
    step = step.withColumns({"n_upper": F.length("rest"), "rest": _left(F.col("rest"), CLASSES["digit"])})
    marks = [F.regexp_count("rest", F.lit(p)).cast("long") for p in (CLASSES["stop"], CLASSES["symbol"], "[#*$%&|<>]")]
    words = F.filter(F.split("text", _WS + "+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    framed = F.concat(F.lit("\n"), F.regexp_replace(F.lower(F.concat("text", F.lit("\n"))), F.lit(f"[{_PUNCTUATION}]*{_WS}+"), F.lit("\n\n")))
    second = step.select(
        "_row", "language", "length", "n_lower", "n_space", "n_upper", F.length("rest").alias("n_digit"), F.array(*marks).alias("marks"),
        _let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        _let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _repeat_words(ws).cast("long").alias("repeated"))).alias("words"),
        _let(framed, lambda t: _common(t, F.col("language"))).alias("common"),
    )
    n = {"lower": F.col("length") - F.col("n_lower"), "space": F.col("n_lower") - F.col("n_space"), "upper": F.col("n_space") - F.col("n_upper"),
         "digit": F.col("n_upper") - F.col("n_digit"), "stop": F.get("marks", F.lit(0)), "symbol": F.get("marks", F.lit(1))}
    beyond = F.col("n_digit") - F.get("marks", F.lit(0)) - F.get("marks", F.lit(1))
    named = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.struct(
        "language",
        F.col("words.n").alias("n_words"),
        (F.col("length") - n["space"]).cast("long").alias("word_chars"),
        F.get("marks", F.lit(2)).alias("n_symbols"),
        "n_dup_lines",
        F.col("words.repeated").alias("n_repeat_words"),
        F.array(*(n[c].cast("long") for c in CLASSES), beyond.cast("long")).alias("classes"),
        F.concat("common", F.array(F.col("words.n") - named)).alias("common"),
        ((F.col("words.n") < 10) | (100 * F.col("words.repeated") > 20 * F.col("words.n"))).alias("base_failed"),
    )
    return second.select("_row", q.alias("_q"))


def references(counted: DataFrame) -> DataFrame:
    """(language, ref_classes, ref_common): sums of the histograms over all documents that pass the base rules; at most one
    row per known language and one for the rest."""
    sums = [F.sum(F.element_at("_q.classes", i + 1)) for i in range(len(CLASSES) + 1)]
    more = [F.sum(F.element_at("_q.common", i + 1)) for i in range(N_COMMON + 1)]
    sound = counted.filter("NOT _q.base_failed").groupBy(F.col("_q.language").alias("language"))
    return sound.agg(F.array(*sums).alias("ref_classes"), F.array(*more).alias("ref_common"))


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / F.greatest(total(a), F.lit(1)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    term = lambda x, y: part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2
    divergence = F.aggregate(F.zip_with(share(counts), share(reference), term), F.lit(0.0), lambda s, x: s + x)
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(0.0))


MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]


def judge(
    docs: DataFrame,
    columns: list[str] | None = None,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    class_slack: float = CLASS_SLACK,
    max_word_distance: float = MAX_WORD_DISTANCE,
    word_slack: float = WORD_SLACK,
    min_chars: int = 200,
    min_words: int = 50,
) -> DataFrame:
    """docs (or some columns of it) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed and kept.

    docs: text string, lang string, others ignored. Words are runs outside 0x20 and 0x09-0x0D. base_failed: fewer than 10
    words, or more than a fifth of the words in five-word windows that occur twice or more in the text. kept is false if
    base_failed, if the text has min_chars characters in words and its class_distance is above max_class_distance plus
    class_slack / sqrt(n_words), or if it has min_words words, its language is known and its word_distance is above
    max_word_distance plus word_slack / sqrt(n_words): the fewer words, the further chance alone takes a clean text. A null
    or empty text has no words and fails. A null or unknown language is compared with all such documents, by classes
    alone. Where no document of a language passes the base rules, distances are 0. Distances are rounded to 9 digits.
    Repeated rows stay and are judged alike; input columns of the names above are replaced, others may have any name; an
    empty table gives an empty result. A text of any length is held whole by one task.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in MADE]
    counted = ex.materialise(features(docs, columns), "quality")
    # At most one row for each language in COMMON and one for the rest.
    both = counted.join(F.broadcast(references(counted)), F.col("_q.language") == F.col("language"), "left")
    q = F.col("_q")
    class_distance = F.round(_distance(q["classes"], F.col("ref_classes")), 9)
    word_distance = F.round(F.when(q["language"] != "", _distance(q["common"], F.col("ref_common"))).otherwise(F.lit(0.0)), 9)
    judged = both.select("_row", "_q", class_distance.alias("_class"), word_distance.alias("_word"))
    root = F.sqrt(F.greatest(q["n_words"], F.lit(1)))
    far = (q["word_chars"] >= min_chars) & (F.col("_class") > max_class_distance + class_slack / root)
    far = far | ((q["n_words"] >= min_words) & (F.col("_word") > max_word_distance + word_slack / root))
    made = [*(q[n].alias(n) for n in MADE[:5]), F.col("_class").alias("class_distance"), F.col("_word").alias("word_distance"), q["base_failed"].alias("base_failed")]
    return judged.select(*(F.col("_row").getField(c).alias(c) for c in columns), *made, (~q["base_failed"] & ~far).alias("kept"))


def fit_base(judged: DataFrame, labels: DataFrame, sample: int = 5000, min_words: int = 50) -> float:
    """How far clean text goes beyond WORD_SLACK / sqrt(n_words), rounded up to hundredths: the largest excess of word_distance
    among the sample documents of quality 1 that have min_words words and the smallest md5 of doc_id. 0 if there are none."""
    clean = labels.filter("quality = 1").select("doc_id").distinct()
    rows = judged.filter((F.col("n_words") >= min_words) & ~F.col("base_failed")).join(clean, "doc_id")
    rows = rows.select(F.md5(F.col("doc_id").cast("string")).alias("_order"), (F.col("word_distance") - WORD_SLACK / F.sqrt("n_words")).alias("excess"))
    most = rows.orderBy("_order").limit(sample).agg(F.max("excess")).first()[0]  # one number
    return math.ceil(100 * max(most or 0.0, 0.0)) / 100


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with the columns of docs.

    Nulls, empty and long texts, ties, repeated rows and empty tables: as in judge. A column that has the name of a made one
    comes through unchanged, like all others.
    """
    columns = docs.columns
    judged = judge(docs.withColumn("_all", F.struct(*(F.col(f"`{c}`") for c in columns))), ["_all"])
    return judged.filter("kept").select(*(F.col("_all").getField(c).alias(c) for c in columns))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts, distances, base_failed and kept of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


def _sql() -> str:
    common = " ".join(f"WHEN lang = '{n}' THEN [{', '.join(repr(w) for w in ws)}]" for n, ws in COMMON.items())
    quoted = lambda p: p.replace("'", "''")
    counts = ", ".join(f"length(text) - length(regexp_replace(text, '{quoted(p)}', '', 'g'))" for p in CLASSES.values())

    def distance(p: str, q: str) -> str:
        share = lambda a: f"list_transform({a}, lambda x: x / greatest(list_sum({a}), 1))"
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) / 2 ELSE 0 END"
        terms = f"list_transform(list_zip({share(p)}, {share(q)}), lambda z: {part.format('z[1]')} + {part.format('z[2]')})"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum({terms}), 0)) ELSE 0.0 END"

    sums = lambda a, n: "[" + ", ".join(f"sum({a}[{i + 1}])" for i in range(n)) + "]"
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(repr(n) for n in COMMON)}) THEN lang ELSE '' END AS lang FROM documents
),
base AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws, [{counts}] AS c6,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CASE {common} ELSE [] END AS common
  FROM docs
),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM wins) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
short AS (SELECT *, list_transform(ws, lambda w: rtrim(lower(w), '.,;:!?')) AS ss FROM base),
hist AS (
  SELECT s.doc_id, lang, len(ws) AS n_words, length(text) - c6[4] AS word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    list_append(c6, length(text) - list_sum(c6)) AS classes,
    CASE WHEN lang = '' THEN list_transform(range(20), lambda i: 0) ELSE list_transform(common, lambda c: len(list_filter(ss, lambda w: w = c))) END AS c20
  FROM short s LEFT JOIN covered c ON c.doc_id = s.doc_id
),
full_hist AS (SELECT *, list_append(c20, n_words - list_sum(c20)) AS words FROM hist),
refs AS (SELECT lang, {sums("classes", 7)} AS rc, {sums("words", 21)} AS rw FROM full_hist WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) GROUP BY lang),
far AS (
  SELECT h.*, round(coalesce({distance("classes", "rc")}, 0.0), 9) AS class_distance, CASE WHEN h.lang = '' THEN 0.0 ELSE round(coalesce({distance("words", "rw")}, 0.0), 9) END AS word_distance,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM full_hist h LEFT JOIN refs r ON r.lang = h.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed,
  NOT base_failed AND NOT (word_chars >= 200 AND class_distance > {MAX_CLASS_DISTANCE} + {CLASS_SLACK} / sqrt(n_words) OR n_words >= 50 AND word_distance > {MAX_WORD_DISTANCE} + {WORD_SLACK} / sqrt(n_words)) AS kept
FROM far
"""


SQL = _sql()
