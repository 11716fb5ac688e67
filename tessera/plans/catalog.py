"""Registered queries over the tables, and the DuckDB SQL that says the same where SQL can."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import addresses, names, tables, text
from tessera.operators import blocking, calibration, decisions, evaluation, fellegi, groups, models, sampling, windows
from tessera.operators import lexicon as lex
from tessera.operators import records as rec
from tessera.plans import documents as D
from tessera.plans import linkage
from tessera.sources import tables as source

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        @functools.wraps(f)
        def run(spark, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


# ---------------------------------------------------------------- rarity, blocking, candidates


@query(D.sql(*D.BASE, select="SELECT a, b, score FROM fwd WHERE fwd_rank = 1"))
def best_match(spark, d):
    """Each left record's best right record by weighted cosine."""
    return D.cands(spark, d).filter("fwd_rank = 1").select("a", "b", "score")


@query(D.sql(D.RECORDS, select="""
SELECT r.pool, token, r.df, round(ln((n.n + 1)::DOUBLE / (df + 1)) + 1, 9) AS idf
FROM (SELECT pool, token, count(*) AS df FROM (SELECT pool, unnest(nt) AS token FROM recs) GROUP BY ALL) r JOIN (SELECT pool, count(*) AS n FROM recs GROUP BY pool) n ON n.pool = r.pool"""))
def token_idf(spark, d):
    return rec.model_idf(D.records(spark, d), "nt").withColumn("idf", F.round("idf", 9))


@query(D.sql(D.RECORDS, select="SELECT id, src, pool, name, len(nt) AS n_name, len(adr) AS n_address, len(nu) AS n_numbers, array_to_string(nt, ' ') AS sorted, count(*) FILTER (src = 1) OVER (PARTITION BY pool, array_to_string(nt, ' ')) AS name_freq FROM recs"))
def record_fields(spark, d):
    """Token and number sets of each record, and how many left records share its sorted name."""
    rows = rec.name_frequency(D.records(spark, d))
    return rows.select("id", "src", "pool", "name", F.size("nt").cast("long").alias("n_name"), F.size("at").cast("long").alias("n_address"), F.size("nu").cast("long").alias("n_numbers"), "sorted", "name_freq")


@query(D.sql(D.RECORDS, D.FEATURES, select="SELECT pool, type, feature, df, round(w, 9) AS w FROM weights WHERE w <> 0"))
def retrieval_weight(spark, d):
    rows = D.records(spark, d)
    sizes = rows.groupBy("pool").agg(F.count_if(F.col("src") > 1).alias("n_right"))
    return blocking.retrieval_weights(blocking.features(rows), sizes, D.HOW).withColumn("w", F.round("w", 9))


@query(D.sql(D.RECORDS, D.FEATURES, select="SELECT id, count(*) AS n_features, round(sum(v), 6) AS total, round(max(v), 9) AS heaviest FROM vecs GROUP BY id"))
def vector_norms(spark, d):
    rows = D.records(spark, d)
    sizes = rows.groupBy("pool").agg(F.count_if(F.col("src") > 1).alias("n_right"))
    feats = blocking.features(rows)
    vecs = blocking.vectors(feats, blocking.retrieval_weights(feats, sizes, D.HOW))
    return vecs.groupBy("id").agg(F.count("*").alias("n_features"), F.round(F.sum("v"), 6).alias("total"), F.round(F.max("v"), 9).alias("heaviest"))


def _similar(spark, d):
    rows = D.records(spark, d)
    sizes = rows.groupBy("pool").agg(F.count_if(F.col("src") > 1).alias("n_right"))
    feats = blocking.features(rows)
    return blocking.similar_pairs(blocking.vectors(feats, blocking.retrieval_weights(feats, sizes, D.HOW)), 48)


@query(D.sql(*D.BASE, select="SELECT a, b, pool, score, fwd_rank FROM fwd"))
def topk_forward(spark, d):
    return blocking.top_forward(_similar(spark, d), D.HOW.k1).withColumn("fwd_rank", F.col("fwd_rank").cast("long"))


@query(D.sql(*D.BASE, select="SELECT a, b, pool, score, rank FROM rev"))
def topk_reverse(spark, d):
    return blocking.top_reverse(_similar(spark, d), D.HOW.rev_k).withColumn("rank", F.col("rank").cast("long"))


@query(D.sql(*D.BASE, select="SELECT a, b, score, fwd_rank::BIGINT AS fwd_rank, rev_rank, round(gap_a, 9) AS gap_a, round(gap_b, 9) AS gap_b, n_cand_b FROM cands"))
def block_union(spark, d):
    rows = D.cands(spark, d)
    return rows.select("a", "b", "score", F.col("fwd_rank").cast("long").alias("fwd_rank"), F.col("rev_rank").cast("long").alias("rev_rank"), F.round("gap_a", 9).alias("gap_a"), F.round("gap_b", 9).alias("gap_b"), F.col("n_cand_b").cast("long").alias("n_cand_b"))


@query(D.sql(D.RECORDS, D.TRUTH, D.FEATURES, D.PAIRS, select="""
SELECT coalesce(r.pool, '*') AS grp, count(*) AS n_true, count(c.a) AS n_found, count(c.a)::DOUBLE / count(*) AS recall
FROM truth t LEFT JOIN cands c ON c.a = t.a AND c.b = t.b JOIN recs r ON r.id = t.a GROUP BY ROLLUP (r.pool)"""))
def recall_rollup(spark, d):
    left = D.records(spark, d).filter("src = 1").select(F.col("id").alias("a"), F.col("pool").alias("grp"))
    return blocking.recall_report(D.cands(spark, d), D.truth(spark, d), left)


# ---------------------------------------------------------------- similarities of candidates



@query(D.sql(*D.FULL, select="SELECT a, b, round(CASE WHEN greatest(length(L.core), length(R.core)) = 0 THEN 1 WHEN least(length(L.core), length(R.core)) = 0 THEN 0 ELSE 1 - levenshtein(L.core, R.core)::DOUBLE / greatest(length(L.core), length(R.core)) END, 9) AS ratio FROM pairs"))
def lev_ratio(spark, d):
    rows = D.dealt(D.pairs(spark, d).select("a", "b", F.col("L.core").alias("x"), F.col("R.core").alias("y")))
    return rows.select("a", "b", F.round(sim.lev_ratio(F.col("x"), F.col("y")), 9).alias("ratio"))


@query(D.sql(*D.FULL, select="""
SELECT a, b, round(CASE WHEN least(length(L.core), length(R.core)) = 0 THEN 0 ELSE
  coalesce(list_min(list_filter(range(1, least(length(L.core), length(R.core)) + 1), lambda i: L.core[i] <> R.core[i])) - 1, least(length(L.core), length(R.core)))::DOUBLE / least(length(L.core), length(R.core)) END, 9) AS ratio FROM pairs"""))
def prefix_ratio(spark, d):
    return D.pairs(spark, d).select("a", "b", F.round(sim.prefix_ratio(F.col("L.core"), F.col("R.core")), 9).alias("ratio"))


@query(D.sql(*D.FULL, select="SELECT a, b, round(jaro_winkler_similarity(L.core, R.core), 9) AS jw FROM pairs"))
def jaro_winkler_floored(spark, d):
    return D.pairs(spark, d).select("a", "b", F.round(sim.jaro_winkler_column(F.col("L.core"), F.col("R.core"), "floored"), 9).alias("jw"))


@query()
def jaro_winkler_half(spark, d):
    """Jaro-Winkler with half transpositions; Monge-Elkan and soft address shares with it."""
    core = (F.col("L.core"), F.col("R.core"))
    return D.pairs(spark, d).select("a", "b", sim.jaro_winkler_column(*core).alias("jw"), sim.monge_elkan_udf("L.nt", "R.nt").alias("monge_elkan"), sim.soft_share_udf(*core).alias("soft_a"), sim.soft_share_udf(*reversed(core)).alias("soft_b"), sim.domain_cover_udf(F.get("L.nt", F.lit(0)), core[1]).alias("cover"))


@query(D.sql(*D.FULL, select="""
SELECT a, b, len(list_intersect(L.adr, R.adr)) AS shared, CASE WHEN len(L.adr) + len(R.adr) > 0 THEN round(len(list_intersect(L.adr, R.adr))::DOUBLE / (len(L.adr) + len(R.adr) - len(list_intersect(L.adr, R.adr))), 9) END AS jaccard FROM pairs"""))
def jaccard_tokens(spark, d):
    union = F.col("n_a") + F.col("n_b") - F.col("n_shared")
    return D.overlaps(spark, d).select("a", "b", F.col("n_shared").cast("long").alias("shared"), F.round(F.when(union > 0, F.col("n_shared") / union), 9).alias("jaccard"))


@query(D.sql(*D.FULL, """
idf AS (SELECT r.pool, token, ln((n.n + 1)::DOUBLE / (df + 1)) + 1 AS w FROM (SELECT pool, token, count(*) AS df FROM (SELECT pool, unnest(nt) AS token FROM recs) GROUP BY ALL) r JOIN (SELECT pool, count(*) AS n FROM recs GROUP BY pool) n ON n.pool = r.pool),
own AS (SELECT id, u.token, w FROM (SELECT id, pool, unnest(nt) AS token FROM recs) u JOIN idf i ON i.pool = u.pool AND i.token = u.token),
mass AS (SELECT id, sum(w * w) AS s FROM own GROUP BY id),
both_have AS (SELECT a, b, sum(x.w * x.w) AS ss, max(x.w) AS most, count(*) AS n FROM cands JOIN own x ON x.id = a JOIN own z ON z.id = b AND z.token = x.token GROUP BY a, b)""",
    select="""SELECT c.a, c.b, coalesce(n, 0) AS shared, round(CASE WHEN x.s > 0 AND z.s > 0 THEN coalesce(ss, 0) / sqrt(x.s * z.s) ELSE 0 END, 8) AS cosine,
  CASE WHEN x.s > 0 THEN round((x.s - coalesce(ss, 0)) / x.s, 8) + 0.0 END AS unmatched_a, round(coalesce(most, 0), 8) AS most
FROM cands c LEFT JOIN both_have t ON t.a = c.a AND t.b = c.b LEFT JOIN mass x ON x.id = c.a LEFT JOIN mass z ON z.id = c.b"""))  # fmt: skip
def idf_cosine(spark, d):
    rows = rec.with_idf(D.records(spark, d), "nt", "x")
    left, right = rows.select(F.col("id").alias("a"), F.col("x").alias("xa")), rows.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    both = D.cands(spark, d).select("a", "b").join(left, "a").join(right, "b").withColumn("s", sim.set_stats(F.col("xa"), F.col("xb")))
    s = F.col("s")
    return both.select("a", "b", s["shared"].cast("long").alias("shared"), F.round(sim.cosine(s["ss"], s["sa"], s["sb"]), 8).alias("cosine"), (F.round(sim.unmatched(s["ss"], s["sa"]), 8) + 0.0).alias("unmatched_a"), F.round(s["most"], 8).alias("most"))


@query(D.sql(*D.FULL, """
grams AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(concat) + 1), lambda i: substr('^' || concat || '$', i, 3))) AS g FROM recs) GROUP BY ALL),
shared AS (SELECT a, b, sum(least(x.n, z.n)) AS k FROM cands JOIN grams x ON x.id = a JOIN grams z ON z.id = b AND z.g = x.g GROUP BY a, b)""",
    select="SELECT p.a, p.b, round(CASE WHEN least(length(L.concat), length(R.concat)) = 0 THEN 0 ELSE 2.0 * coalesce(k, 0) / (length(L.concat) + length(R.concat)) END, 9) AS dice FROM pairs p LEFT JOIN shared s ON s.a = p.a AND s.b = p.b"))
def tri_dice(spark, d):
    grams = D.written(spark, d, "grams", lambda: D.records(spark, d).repartition("id").select("id", sim.numbered_trigrams(F.col("concat")).alias("g")))
    side = lambda c: grams.select(F.col("id").alias(c), F.col("g").alias(f"g{c}"))
    both = D.cands(spark, d).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.round(sim.dice_of_grams(F.col("ga"), F.col("gb")), 9).alias("dice"))


_NUMBER_PAIRS = """
SELECT a, b, len(list_intersect(L.nu, R.nu)) AS shared, CASE WHEN len(L.nu) > 0 AND len(R.nu) > 0 AND len(list_intersect(L.nu, R.nu)) = 0 THEN 1 ELSE 0 END AS conflict,
  CASE WHEN len(list_filter(flatten(list_transform(L.nu, lambda x: list_transform(R.nu, lambda y: x <> y AND least(length(x), length(y)) >= 2
    AND (starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x))))), lambda t: t)) > 0 THEN 1 ELSE 0 END AS fuzzy
FROM pairs"""


@query(D.sql(*D.FULL, select=_NUMBER_PAIRS))
def num_stats(spark, d):
    rows = D.pairs(spark, d).withColumn("s", sim.number_stats(F.col("L.nu"), F.col("R.nu")))
    return rows.select("a", "b", F.col("s.shared").cast("long").alias("shared"), F.col("s.conflict").alias("conflict"), F.col("s.fuzzy").alias("fuzzy"))


@query(r"""
WITH n AS (SELECT p_partkey AS x, (p_partkey * 7 + p_size) AS y FROM part),
t AS (SELECT x, y, x::VARCHAR AS s, y::VARCHAR AS t FROM n),
k AS (SELECT *, list_filter(range(1, length(s) + 1), lambda i: s[i] <> t[i]) AS diff FROM t)
SELECT x, y, length(s) = length(t) AND length(s) >= 2 AND (len(diff) = 1 OR (len(diff) = 2 AND diff[2] = diff[1] + 1 AND s[diff[1]] = t[diff[2]] AND s[diff[2]] = t[diff[1]])) AS near,
  abs(length(s) - length(t)) = 1 AND least(length(s), length(t)) >= 2 AND levenshtein(s, t) = 1 AS deleted FROM k""")
def num_near(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("x"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("y"))
    return rows.select("x", "y", sim.near_number(F.col("x"), F.col("y")).alias("near"), sim.one_deleted(F.col("x"), F.col("y")).alias("deleted"))


@query(D.sql(*D.FULL, select="SELECT a, b, CASE WHEN L.state IS NULL AND R.state IS NULL THEN 0 WHEN L.state IS NULL OR R.state IS NULL THEN 2 WHEN L.state = R.state THEN 1 ELSE 3 END AS category, array_to_string(list_transform(L.words, lambda w: w[1]), '') = R.concat AND len(L.words) >= 2 OR array_to_string(list_transform(R.words, lambda w: w[1]), '') = L.concat AND len(R.words) >= 2 AS acronym FROM pairs"))
def categories(spark, d):
    ini = lambda s: F.array_join(F.transform(F.filter(F.split(f"{s}.core", " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    return D.pairs(spark, d).select("a", "b", sim.category(F.col("L.state"), F.col("R.state")).alias("category"), sim.acronym(ini("L"), F.col("L.core"), ini("R"), F.col("R.core")).alias("acronym"))


# ---------------------------------------------------------------- text


_REPLACES = "".join("replace(" for _ in tables.PHONETIC) + "w" + "".join(f", '{a}', '{b}')" for a, b in tables.PHONETIC)


@query(D.sql(D.RECORDS, select=f"""
SELECT w AS word, array_to_string(list_transform(list_filter(range(1, len(cs) + 1), lambda i: i = 1 OR cs[i] <> cs[i - 1]), lambda i: cs[i]), '') AS key
FROM (SELECT w, list_concat([CASE WHEN s[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'a' ELSE s[1] END], string_split(translate(s[2:], 'aeiouh', ''), '')) AS cs
  FROM (SELECT w, {_REPLACES} AS s FROM (SELECT DISTINCT unnest(list_concat(nt, adr)) AS w FROM recs)))"""))
def phonetic_key(spark, d):
    words = D.records(spark, d).select(F.explode(F.concat("nt", "at")).alias("word")).distinct()
    return words.select("word", text.phonetic_key(F.col("word")).alias("key"))


def _mixed_words(spark, d):
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9@$]+"), F.lit(0))).alias("word"))
    return words.filter(F.rlike("word", F.lit("[0-9@$]"))).distinct()


_MIXED = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9@$]+')) AS w FROM documents) WHERE regexp_matches(w, '[0-9@$]')"
_CASES = lambda table, x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {x} END"


@query(f"SELECT w AS word, array_to_string(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN i > 1 AND i < length(w) AND regexp_matches(w[i - 1], '^[a-z]$') AND regexp_matches(w[i + 1], '^[a-z]$') THEN {_CASES(tables.INNER_DIGIT, 'w[i]')} ELSE w[i] END), '') AS mended FROM ({_MIXED})")
def homoglyphs(spark, d):
    return _mixed_words(spark, d).select("word", text.inner_digits(F.col("word")).alias("mended"))


@query(f"""
WITH s AS (SELECT w, regexp_matches(w[1], '[0-9]') AND length(w) > 1 AS p, CASE WHEN length(w) > 1 AND regexp_matches(w[1], '[0-9]') THEN w[2:] ELSE w END AS c FROM ({_MIXED})),
t AS (SELECT w, p, length(c) > 1 AND regexp_matches(c[-1], '[0-9]') AS q, CASE WHEN length(c) > 1 AND regexp_matches(c[-1], '[0-9]') THEN c[:-2] ELSE c END AS core FROM s),
u AS (SELECT *, (CASE WHEN p THEN {_CASES(tables.EDGE_DIGIT, 'w[1]')} ELSE '' END) || core || (CASE WHEN q THEN {_CASES(tables.EDGE_DIGIT, 'w[-1]')} ELSE '' END) AS m FROM t)
SELECT w AS word, CASE WHEN (p OR q) AND regexp_matches(core, '^[a-z]+$') AND NOT regexp_matches(w, '^[0-9]+(st|nd|rd|th|er|ere|eme|e|re|ieme)$')
  AND (length(core) >= 3 OR m IN ({", ".join(repr(x) for x in tables.LEGAL)})) THEN m ELSE w END AS mended FROM u""")
def edge_digit_fix(spark, d):
    return _mixed_words(spark, d).select("word", text.edge_digits(F.col("word")).alias("mended"))


_SPECIALS = "".join("replace(" for _ in tables.SPECIAL_LETTERS) + "text" + "".join(f", '{a}', '{b}')" for a, b in tables.SPECIAL_LETTERS.items())


@query(f"SELECT doc_id, regexp_replace(lower(strip_accents({_SPECIALS})), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents")
def ascii_fold(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.ascii_fold("text").alias("folded"))


@query(D.sql(D.RECORDS, select=f"SELECT id, array_to_string(list_filter(words, lambda w: w NOT IN ({', '.join(repr(w) for w in [*tables.LEGAL, *tables.NAME_DROP])})), ' ') AS core, len(list_filter(words, lambda w: w IN ({', '.join(repr(w) for w in tables.LEGAL)}))) AS n_legal FROM recs"))
def legal_split(spark, d):
    """Names without legal forms and stop words."""
    words = F.filter(F.split("core", " "), lambda w: w != "")
    forms = F.size(F.filter(words, lambda w: F.array_contains(F.array(*map(F.lit, tables.LEGAL)), w))).cast("long")
    return D.records(spark, d).select("id", F.array_join(names.split_legal(words)["core"], " ").alias("core"), forms.alias("n_legal"))


def _customers(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


@query("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || ' services' WHEN 1 THEN 'new ' || lower(c_mktsegment) WHEN 2 THEN lower(c_mktsegment) ELSE lower(c_mktsegment) || ' group' END AS core,
  CASE c_custkey % 4 WHEN 0 THEN 'ltd pvt' WHEN 1 THEN 'inc' ELSE '' END AS legal, CASE c_custkey % 4 WHEN 1 THEN 'old ' || lower(c_mktsegment) ELSE '' END AS alt,
  CASE c_custkey % 4 WHEN 2 THEN 1 ELSE 0 END AS is_domain, CASE c_custkey % 4 WHEN 0 THEN 'service' ELSE '' END AS churn, CASE c_custkey % 4 WHEN 3 THEN 'group' ELSE '' END AS gw FROM customer""")
def parsed_names(spark, d):
    """Names of four dirty kinds through the name parser: with legal forms and a record number, renamed, a domain, with a second part."""
    n, s = F.col("id") % 4, F.col("segment")
    raw = F.when(n == 0, F.concat(F.lit("M/s. The "), s, F.lit(" 5ervices Pvt. Ltd. (ID: "), F.col("id").cast("string"), F.lit(")")))
    raw = raw.when(n == 1, F.concat(F.lit("Old "), s, F.lit(" a/k/a New "), s, F.lit(" Incorporated")))
    raw = raw.when(n == 2, F.concat(F.lit("www."), F.lower(s), F.lit(".com"))).otherwise(F.concat(s, F.lit(" Groupe | "), s, F.lit(" Elsewhere")))
    p = _customers(spark, d).select("id", names.parse_name(raw, F.lit("US")).alias("p"))
    joined = lambda c: F.array_join(f"p.{c}", " ").alias(c)
    return p.select("id", F.regexp_replace("p.core", "groupe$", "group").alias("core"), "p.legal", "p.alt", "p.is_domain", joined("churn"), joined("gw"))


_STATES = ", ".join(f"('{code}', '{full}')" for code, full in tables.US_STATES.items())


@query(f"""
WITH states(code, full_name) AS (VALUES {_STATES}), numbered AS (SELECT *, row_number() OVER (ORDER BY code) - 1 AS i FROM states)
SELECT c_custkey AS id, 'apartment elm main road street' AS tokens, array_to_string(list_sort(list_distinct([c_custkey, c_nationkey::BIGINT])), ' ') AS nums, full_name AS state, 0 AS a_empty
FROM customer JOIN numbered ON i = c_custkey % {len(tables.US_STATES)}""")
def parsed_addresses(spark, d):
    """Addresses with abbreviations, numbers, a post box, a care-of mark and a state code through the address parser."""
    codes = F.array(*map(F.lit, sorted(tables.US_STATES)))
    raw = F.concat(F.col("id").cast("string"), F.lit(" Main St, Apt "), F.col("nation").cast("string"), F.lit(", c/o Elm Rd, P.O. Box 77, "), F.upper(F.get(codes, (F.col("id") % len(tables.US_STATES)).cast("int"))))
    p = _customers(spark, d).select("id", addresses.parse_address(raw, F.lit("US")).alias("p"))
    return p.select("id", F.array_join("p.tokens", " ").alias("tokens"), F.array_join(F.transform("p.nums", lambda x: x.cast("string")), " ").alias("nums"), "p.state", F.col("p.empty").cast("int").alias("a_empty"))


@query()
def parsed_records(spark, d):
    """Every page, with its title as a name and its URL as an address, through the name and address parsers."""
    return linkage.encoded(spark, d).select("id", "src", "pool", "core", "sorted", "concat", "alt", "legal", "phon", "ini", "a_sorted", "nu", "state", "a_empty", "adig", "name_freq")


# ---------------------------------------------------------------- lexicon and states


@query(D.sql(D.RECORDS, """
seen AS (SELECT pool AS country, state, unnest(adr) AS word FROM recs WHERE src = 1 AND state IS NOT NULL),
each_one AS (SELECT *, sum(n) OVER (PARTITION BY country, word) AS total FROM (SELECT country, word, state, count(*) AS n FROM seen GROUP BY country, word, state)),
states AS (SELECT country, word, state FROM each_one WHERE total >= 2 AND n >= 0.95 * total),
implied AS (SELECT r.id, min(s.state) AS lo, max(s.state) AS hi FROM (SELECT id, pool, unnest(adr) AS word FROM recs WHERE state IS NULL) r JOIN states s ON s.country = r.pool AND s.word = r.word GROUP BY r.id)""",
    select="SELECT r.id, coalesce(r.state, CASE WHEN lo = hi THEN lo END) AS state FROM recs r LEFT JOIN implied i ON i.id = r.id"))
def state_fill(spark, d):
    rows = D.records(spark, d).withColumn("country", F.col("pool"))
    return rec.fill_states(rows, rec.state_words(rows, least=2)).select("id", "state")


@query("""
WITH tokens AS (
  SELECT c_nationkey::VARCHAR AS scope, CASE c_custkey % 4 WHEN 0 THEN ['one', lower(c_mktsegment)] WHEN 1 THEN ['one', 'abz'] WHEN 2 THEN ['abq'] ELSE ['one', 'two', 'three'] END AS ta,
    CASE c_custkey % 4 WHEN 0 THEN ['one', lower(c_mktsegment[1:3]) || 'x'] WHEN 1 THEN ['one', 'abc'] WHEN 2 THEN ['abz'] ELSE ['one'] END AS tb FROM customer
),
one AS (SELECT scope, list_filter(tb, lambda x: NOT list_contains(ta, x)) AS x, list_filter(ta, lambda x: NOT list_contains(tb, x)) AS y FROM tokens),
single AS (SELECT scope, x[1] AS word, y[1] AS target FROM one WHERE len(x) = 1 AND len(y) = 1),
counted AS (SELECT scope, word, target, count(*) FILTER (word[1] = target[1]) AS n, count(*) AS k FROM single GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, sum(k) OVER (PARTITION BY scope, word) AS total FROM counted) WHERE n >= 2 AND n >= 0.5 * total),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, word ORDER BY n DESC, target) AS f FROM kept) WHERE f = 1)
SELECT k.scope, k.word, k.target FROM firsts k WHERE NOT EXISTS (SELECT 1 FROM firsts o WHERE o.scope = k.scope AND o.word = k.target)""")
def lexicon_swaps(spark, d):
    """Swaps of words mined per scope from token sets with planted swaps, and a chain (abc -> abz -> abq) of which only the end stays."""
    n = F.col("id") % 4
    segment, short = F.lower("segment"), F.concat(F.lower(F.substring("segment", 1, 3)), F.lit("x"))
    words = lambda *w: F.array(*(F.lit(x) if isinstance(x, str) else x for x in w))
    ta = F.when(n == 0, words("one", segment)).when(n == 1, words("one", "abz")).when(n == 2, words("abq")).otherwise(words("one", "two", "three"))
    tb = F.when(n == 0, words("one", short)).when(n == 1, words("one", "abc")).when(n == 2, words("abz")).otherwise(words("one"))
    return lex.swaps(_customers(spark, d).select(F.col("nation").cast("string").alias("scope"), ta.alias("ta"), tb.alias("tb")), 2)


# ---------------------------------------------------------------- ranks and context


@query(D.sql(*D.FULL, """
ctx AS (
  SELECT a, b, score AS p, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank_a, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rank_b,
    sum(score) OVER (PARTITION BY a) AS sum_a, count(*) FILTER (score > 0.5) OVER (PARTITION BY a) AS c05_a, count(*) OVER (PARTITION BY b) AS n_b,
    nth_value(score, 1) OVER wa AS a1, nth_value(score, 2) OVER wa AS a2, nth_value(score, 1) OVER wb AS b1, nth_value(score, 2) OVER wb AS b2 FROM cands
  WINDOW wa AS (PARTITION BY a ORDER BY score DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), wb AS (PARTITION BY b ORDER BY score DESC, a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
others AS (SELECT *, CASE WHEN p >= a1 THEN coalesce(a2, 0) ELSE a1 END AS other_a, CASE WHEN p >= b1 THEN coalesce(b2, 0) ELSE b1 END AS other_b FROM ctx)""",
    select="SELECT a, b, p, rank_a AS p_rank_a, other_a AS p_other_a, round(sum_a, 9) AS p_sum_a, c05_a AS p_c05_a, rank_b AS p_rank_b, other_b AS p_other_b, round(p - other_b, 9) AS p_margin_b, n_b AS p_n_b FROM others"))
def pair_context(spark, d):
    rows = windows.pair_context(D.cands(spark, d).select("a", "b", F.col("score").alias("p")), "p")
    return rows.withColumns({c: F.round(c, 9) for c in ("p_sum_a", "p_margin_b")} | {c: F.col(c).cast("long") for c in ("p_rank_a", "p_c05_a", "p_rank_b", "p_n_b")})


@query(D.sql(*D.FULL, """
s AS (SELECT a, b, R.src AS src, score, row_number() OVER (PARTITION BY a, R.src ORDER BY score DESC, b) AS r FROM pairs),
per AS (SELECT a, src, max(CASE WHEN r = 1 THEN score END) AS s1, max(CASE WHEN r = 2 THEN score END) AS s2, count(*) FILTER (score >= 0.5) AS n FROM s GROUP BY a, src)""",
    select="SELECT s.a, s.b, coalesce(CASE WHEN r = 1 THEN o.s2 ELSE o.s1 END, 0) AS same_best, coalesce(t.s1, 0) AS other_best, o.n - CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS same_n, coalesce(t.n, 0) AS other_n FROM s JOIN per o ON o.a = s.a AND o.src = s.src LEFT JOIN per t ON t.a = s.a AND t.src = 5 - s.src"))
def source_best(spark, d):
    rows = D.pairs(spark, d).select("a", "b", F.col("R.src").alias("src"), F.col("score").alias("p"))
    out = windows.source_context(rows, "p")
    return out.select("a", "b", F.col("g_same_best").alias("same_best"), F.col("g_other_best").alias("other_best"), F.col("g_same_n").cast("long").alias("same_n"), F.col("g_other_n").cast("long").alias("other_n"))


@query(D.sql(*D.FULL, """
s AS (SELECT a, b, array_to_string(R.nt, ' ') AS name, R.src AS src, score, nth_value(score, 1) OVER w AS s1, nth_value(score, 2) OVER w AS s2 FROM pairs
  WINDOW w AS (PARTITION BY a, R.src, array_to_string(R.nt, ' ') ORDER BY score DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
    select="SELECT a, b, CASE WHEN name = '' THEN 0 WHEN score >= s1 THEN coalesce(s2, 0) ELSE s1 END AS twin FROM s"))
def twin_best(spark, d):
    rows = D.pairs(spark, d).select("a", "b", F.col("R.src").alias("src"), F.col("R.sorted").alias("name"), F.col("score").alias("p"))
    return windows.twin_best(rows, "p", "twin").select("a", "b", "twin")


_STRUCTURE = """
own AS (SELECT a, b, CASE WHEN L.nt = R.nt THEN 1 ELSE 0 END AS alike, CASE WHEN L.nt = R.nt AND len(R.adr) = 0 THEN 1 ELSE 0 END AS bare, len(list_intersect(L.nu, R.nu)) AS num_shared, L.pool AS pool, array_to_string(L.nt, ' ') AS na, array_to_string(R.nt, ' ') AS nb, score FROM pairs),
carriers AS (SELECT pool, array_to_string(nt, ' ') AS name, count(*) AS n FROM recs WHERE src > 1 AND len(nt) > 0 GROUP BY ALL)"""


@query(D.sql(*D.FULL, _STRUCTURE, select="""
SELECT a, b, round(ln(1 + coalesce(x.n, 0)), 8) AS nm_rec_cnt_a, round(ln(1 + greatest(coalesce(z.n, 0) - 1, 0)), 8) AS nm_rec_cnt_b, (sum(alike) OVER (PARTITION BY a) - alike)::BIGINT AS a_same_name_cands,
  (sum(bare) OVER (PARTITION BY a) - bare)::BIGINT AS a_same_name_noaddr, (sum(alike) OVER (PARTITION BY b) - alike)::BIGINT AS b_name_claimants,
  row_number() OVER (PARTITION BY b ORDER BY alike + 0.5 * score + CASE WHEN num_shared > 0 THEN 0.25 ELSE 0 END DESC, a) AS b_name_rank
FROM own LEFT JOIN carriers x ON x.pool = own.pool AND x.name = na LEFT JOIN carriers z ON z.pool = own.pool AND z.name = nb"""))
def candidate_structure(spark, d):
    """Who else carries a pair's names; here names agree if their sorted words are equal, and the address cosine is the retrieval score."""
    rows = D.pairs(spark, d).select("a", "b", (F.col("L.sorted") == F.col("R.sorted")).cast("double").alias("jw_sorted"), F.col("score").alias("atok_cos"), sim.shared(F.col("L.nu"), F.col("R.nu")).alias("num_shared"), F.col("R.a_empty").alias("addr_empty_b"))
    out = windows.candidate_structure(rows, D.records(spark, d))
    return out.select("a", "b", F.round("nm_rec_cnt_a", 8).alias("nm_rec_cnt_a"), F.round("nm_rec_cnt_b", 8).alias("nm_rec_cnt_b"), *(F.col(c).cast("long").alias(c) for c in ("a_same_name_cands", "a_same_name_noaddr", "b_name_claimants", "b_name_rank")))


@query(D.sql(*D.FULL, select="SELECT a, b, score FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rb FROM cands) WHERE ra <= 3 OR rb = 1"))
def rerank_keep(spark, d):
    return models.rerank_keep(D.cands(spark, d), "score", 3).select("a", "b", "score")


@query(D.sql(*D.FULL, select="SELECT a, b, score FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM cands) WHERE r = 1"))
def top_row(spark, d):
    return windows.top_row(D.cands(spark, d), "score")


@query()
def group_agreement(spark, d):
    """Agreement of each candidate with the other likely matches of its left record."""
    rows = D.cands(spark, d).select("a", "b", "pool", F.col("score").alias("p"))
    return groups.group_agreement(rows, D.records(spark, d), "p", least=0.1).drop("pool", "p")


# ---------------------------------------------------------------- Fellegi-Sunter

_COMPARED = """
compared AS (
  SELECT a, b, y, jaro_winkler_similarity(array_to_string(L.nt, ' '), array_to_string(R.nt, ' ')) AS jw, score AS cos, L.state AS sa, R.state AS sb, len(L.adr) = 0 OR len(R.adr) = 0 AS missing,
    len(list_intersect(L.adr, R.adr))::DOUBLE / greatest(len(L.adr) + len(R.adr) - len(list_intersect(L.adr, R.adr)), 1) AS jac, len(list_intersect(L.nu, R.nu)) AS shared, len(L.nu) > 0 AND len(R.nu) > 0 AND len(list_intersect(L.nu, R.nu)) = 0 AS conflict FROM pairs
),
leveled AS (
  SELECT a, b, y, CASE WHEN jw >= 0.97 THEN 0 WHEN jw >= 0.9 THEN 1 WHEN jw >= 0.8 THEN 2 ELSE 3 END AS name_jw, CASE WHEN cos >= 0.9 THEN 0 WHEN cos >= 0.6 THEN 1 WHEN cos >= 0.3 THEN 2 ELSE 3 END AS name_tok,
    CASE WHEN missing THEN 4 WHEN jac >= 0.9 THEN 0 WHEN jac >= 0.6 THEN 1 WHEN jac >= 0.3 THEN 2 ELSE 3 END AS addr_tok, CASE WHEN missing THEN 3 WHEN jac >= 0.8 THEN 0 WHEN jac >= 0.5 THEN 1 ELSE 2 END AS addr_tri,
    CASE WHEN shared > 0 THEN 0 WHEN conflict THEN 1 ELSE 2 END AS house_num, CASE WHEN sa IS NULL AND sb IS NULL THEN 3 WHEN sa IS NULL OR sb IS NULL THEN 1 WHEN sa = sb THEN 0 ELSE 2 END AS state, 3 AS legal, 1 AS initials FROM compared
),
lv AS (SELECT a, b, y, comparison, lev AS level FROM leveled UNPIVOT (lev FOR comparison IN (name_jw, name_tok, addr_tok, addr_tri, house_num, state, legal, initials))),
spec AS (SELECT c AS comparison, unnest(range(k))::INT AS level FROM (VALUES ('name_jw', 4), ('name_tok', 4), ('addr_tok', 5), ('addr_tri', 4), ('house_num', 3), ('state', 4), ('legal', 4), ('initials', 2)) t(c, k)),
counted AS (SELECT s.comparison, s.level, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0 FROM spec s LEFT JOIN lv ON lv.comparison = s.comparison AND lv.level = s.level GROUP BY ALL),
clipped AS (SELECT comparison, level, least(greatest(n1 / greatest(sum(n1) OVER w, 1e-300), 1e-5), 1 - 1e-5) AS m, least(greatest(n0 / greatest(sum(n0) OVER w, 1e-300), 1e-5), 1 - 1e-5) AS u FROM counted WINDOW w AS (PARTITION BY comparison)),
mu AS (SELECT comparison, level, m / sum(m) OVER w AS m, u / sum(u) OVER w AS u FROM clipped WINDOW w AS (PARTITION BY comparison))"""


def _compared(spark, d):
    rows = D.compared(spark, d)
    jac = F.col("n_shared") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("n_shared"), F.lit(1))
    missing = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    return rows.select(
        "a", "b", "y", "jw_sorted", F.col("score").alias("ntok_cos"), jac.alias("atok_cos"), F.when(~missing, jac).alias("tri_addr"),
        "num_shared", "num_conflict", "state_cat", F.lit(0).alias("legal_cat"), F.lit(0).alias("acro"),
    )


@query(D.sql(*D.FULL, _COMPARED, select="SELECT comparison, level, round(m, 9) AS m, round(u, 9) AS u FROM mu"))
def fs_mu_table(spark, d):
    return fellegi.mu_table(_compared(spark, d)).select("comparison", "level", F.round("m", 9).alias("m"), F.round("u", 9).alias("u"))


@query(D.sql(*D.FULL, _COMPARED, select="SELECT a, b, round(sum(ln(m / u)), 6) AS fs_llr FROM lv JOIN mu ON mu.comparison = lv.comparison AND mu.level = lv.level GROUP BY a, b"))
def fs_llr(spark, d):
    rows = _compared(spark, d)
    return fellegi.fs_llr(rows, fellegi.supervised(rows)).select("a", "b", F.round("fs_llr", 6).alias("fs_llr"))


@query()
def fs_em(spark, d):
    """Weights of the fit without labels, where its guard accepts it."""
    rows = _compared(spark, d)
    return fellegi.fs_llr(rows, fellegi.unsupervised(rows, fellegi.supervised(rows))).select("a", "b", "fs_llr")


# ---------------------------------------------------------------- decisions

_Q = "q AS (SELECT a, b, pool, y, round(0.02 + 0.93 * score, 6) AS q FROM pairs)"


def _q(spark, d):
    return D.pairs(spark, d).select("a", "b", "pool", "y", F.round(0.02 + 0.93 * F.col("score"), 6).alias("q"))


@query(D.sql(*D.FULL, _Q, select="SELECT a, b, round(1.6 * q / (1.6 * q + 1 - q), 9) AS q FROM q"))
def odds_shift(spark, d):
    return _q(spark, d).select("a", "b", F.round(decisions.odds_shift(F.col("q"), 1.6), 9).alias("q"))


_HARD = "hard AS (SELECT a, b, q, CASE WHEN row_number() OVER w = 1 AND round(q - coalesce(lead(q) OVER w, 0), 9) >= 0.1 THEN q ELSE 0 END AS qe FROM q WINDOW w AS (PARTITION BY b ORDER BY q DESC, a))"


@query(D.sql(*D.FULL, _Q, _HARD, select="SELECT a, b, qe FROM hard"))
def hard_exclusive(spark, d):
    return _q(spark, d).select("a", "b", decisions.hard_exclusive("q", 0.1 - 1e-10).alias("qe"))


@query(D.sql(*D.FULL, _Q, select="SELECT a, b, round((q / (1 - q)) / (1 + sum(q / (1 - q)) OVER (PARTITION BY b)), 8) AS qe FROM q"))
def soft_exclusive(spark, d):
    return _q(spark, d).select("a", "b", F.round(decisions.soft_exclusive(), 8).alias("qe"))


_CHOSEN = "chosen AS (SELECT a, b FROM q WHERE q >= 0.5)"
_COUNTS = """counts AS (
  SELECT r.id AS a, r.pool, count(DISTINCT c.b) AS n_pred, count(DISTINCT CASE WHEN t.a IS NOT NULL THEN c.b END) AS tp, any_value(coalesce(n.n, 0)) AS n_true
  FROM recs r LEFT JOIN chosen c ON c.a = r.id LEFT JOIN truth t ON t.a = c.a AND t.b = c.b LEFT JOIN (SELECT a, count(*) AS n FROM truth GROUP BY a) n ON n.a = r.id WHERE r.src = 1 GROUP BY r.id, r.pool
)"""
_F05 = lambda tp, p, t: f"CASE WHEN {p} = 0 THEN CASE WHEN {t} = 0 THEN 1.0 ELSE 0.0 END ELSE 1.25 * ({tp}) / ({p} + 0.25 * {t}) END"


def _counts(spark, d):
    left = D.records(spark, d).filter("src = 1").select(F.col("id").alias("a"), "pool")
    return evaluation.list_counts(left, _q(spark, d).filter("q >= 0.5").select("a", "b"), D.truth(spark, d))


@query(D.sql(*D.FULL, _Q, _CHOSEN, _COUNTS, select=f"SELECT coalesce(pool, '*') AS grp, count(*) AS n, round(avg({_F05('tp', 'n_pred', 'n_true')}), 9) AS f05 FROM counts GROUP BY ROLLUP (pool)"))
def macro_f05(spark, d):
    return evaluation.macro_f05(_counts(spark, d), "pool").withColumn("f05", F.round("f05", 9))


_LISTS = "lists AS (SELECT a, list(q ORDER BY q DESC, b) AS ps FROM q GROUP BY a)"
_BINOMIAL = "list_reduce({0}, lambda acc, p: list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0) * (1 - p[1]) + CASE WHEN i > 1 THEN acc[i - 1] * p[1] ELSE 0 END), [1.0::DOUBLE])"


@query(D.sql(*D.FULL, _Q, _LISTS, select=f"SELECT a, i - 1 AS matches, round(d[i], 8) AS probability FROM (SELECT a, d, unnest(range(1, len(d) + 1)) AS i FROM (SELECT a, {_BINOMIAL.format('list_transform(ps, lambda p: [p::DOUBLE])')} AS d FROM lists))"))
def poisson_binomial(spark, d):
    """Probabilities of 0, 1, .. true matches of each left record."""
    lists = _q(spark, d).groupBy("a").agg(F.array_sort(F.collect_list("q")).alias("ps"))
    return lists.select("a", F.posexplode(decisions.match_counts(F.col("ps"))).alias("matches", "probability")).select("a", F.col("matches").cast("long").alias("matches"), F.round("probability", 8).alias("probability"))


_TAIL = _BINOMIAL.format("list_transform(ps[k + 1:], lambda p: [p::DOUBLE])")
_HEAD = _BINOMIAL.format("list_transform(ps[:k], lambda p: [p::DOUBLE])")


@query(D.sql(*D.FULL, _Q, _LISTS, f"""
ks AS (SELECT a, ps, unnest(range(0, len(ps) + 1)) AS k FROM lists),
parts AS (SELECT a, k, CASE WHEN k > 0 THEN {_HEAD} ELSE [1.0::DOUBLE] END AS h, CASE WHEN k < len(ps) THEN {_TAIL} ELSE [1.0::DOUBLE] END AS t FROM ks)""",
    select="SELECT a, k, round(CASE WHEN k = 0 THEN t[1] ELSE list_sum(list_transform(range(1, k + 1), lambda i: list_sum(list_transform(range(0, len(t)), lambda j: h[i + 1] * t[j + 1] * 1.25 * i / (k + 0.25 * (i + j)))))) END, 8) AS expected FROM parts"))
def expected_f05_k(spark, d):
    """Expected F0.5 of each left record's first k candidates."""
    lists = _q(spark, d).groupBy("a").agg(F.transform(F.array_sort(F.collect_list(-F.col("q"))), lambda x: -x).alias("ps"))
    rows = lists.select("a", "ps", F.explode(F.sequence(F.lit(0), F.size("ps"))).alias("k"))
    return rows.select("a", F.col("k").cast("long").alias("k"), F.round(decisions.expected_f05(F.col("ps"), F.col("k")), 8).alias("expected"))


_SOFT = "soft AS (SELECT a, b, round((q / (1 - q)) / (1 + sum(q / (1 - q)) OVER (PARTITION BY b)), 9) AS qe FROM q)"
_EXPECTED = """CASE WHEN k = 0 THEN t[1] ELSE list_sum(list_transform(range(1, k + 1), lambda i: list_sum(list_transform(range(0, len(t)), lambda j: h[i + 1] * t[j + 1] * 1.25 * i / (k + 0.25 * (i + j)))))) END"""


@query(D.sql(*D.FULL, _Q, _SOFT, "lists AS (SELECT a, list(qe ORDER BY qe DESC, b) AS ps, list(b ORDER BY qe DESC, b) AS bs FROM soft WHERE qe >= 0.001 GROUP BY a)", f"""
ks AS (SELECT a, ps, bs, unnest(range(0, len(ps) + 1)) AS k FROM lists),
parts AS (SELECT a, bs, k, CASE WHEN k > 0 THEN {_HEAD} ELSE [1.0::DOUBLE] END AS h, CASE WHEN k < len(ps) THEN {_TAIL} ELSE [1.0::DOUBLE] END AS t FROM ks),
best AS (SELECT a, bs, k FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(e, 12) DESC, k) AS r FROM (SELECT a, bs, k, {_EXPECTED} AS e FROM parts)) WHERE r = 1),
chosen AS (SELECT a, unnest(bs[1:k]) AS b FROM best),
joined AS (SELECT c.a, string_agg(c.b::VARCHAR, ',' ORDER BY qe DESC, c.b::VARCHAR) AS ids FROM chosen c JOIN soft s ON s.a = c.a AND s.b = c.b GROUP BY c.a)""",
    select="SELECT r.id::VARCHAR AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM recs r LEFT JOIN joined j ON j.a = r.id WHERE r.src = 1"))
def selected_lists(spark, d):
    """The list of largest expected F0.5 of each left record, after soft exclusivity."""
    rows = decisions.decide(_q(spark, d), {"excl": "soft", "min_p": 0.001}, calibrate=lambda q: F.round(q, 9))
    left = D.records(spark, d).filter("src = 1").select(F.col("id").alias("a"))
    return source.joined_lists(left, rows.filter("sel"), "qe", "matched_entity_ids")


@query(D.sql(*D.FULL, _Q, _SOFT, _HARD, select="SELECT q.a, q.b, CASE WHEN q.pool = 'en' THEN hard.qe ELSE round(soft.qe, 8) END AS qe FROM q JOIN soft ON soft.a = q.a AND soft.b = q.b JOIN hard ON hard.a = q.a AND hard.b = q.b"))
def exclusive_by_pool(spark, d):
    """Each pool's own exclusivity: a margin of 0.1 for one, soft for the others."""
    value = decisions.exclusive_by("pool", {"en": f"hard:{0.1 - 1e-10}"}, "soft")
    return _q(spark, d).select("a", "b", F.when(F.col("pool") == "en", value).otherwise(F.round(value, 8)).alias("qe"))


@query(D.sql(*D.FULL, _Q, select="SELECT a, b, q >= 0.4 AND (pool IN ('en', 'de') OR q >= 0.7) AS sel FROM q"))
def unseen_floor(spark, d):
    rows = _q(spark, d).withColumn("sel", F.col("q") >= 0.4)
    return decisions.unseen_floor(rows, ["en", "de"], 0.7, "pool", "q").select("a", "b", "sel")


@query(D.sql(*D.FULL, _Q, _LISTS, f"""
sized AS (SELECT a, count(*) FILTER (q >= 0.5) AS k FROM q GROUP BY a),
ks AS (SELECT l.a, ps, k FROM lists l JOIN sized z ON z.a = l.a),
parts AS (SELECT a, k, CASE WHEN k > 0 THEN {_HEAD} ELSE [1.0::DOUBLE] END AS h, CASE WHEN k < len(ps) THEN {_TAIL} ELSE [1.0::DOUBLE] END AS t FROM ks)""",
    select=f"SELECT a, k, round({_EXPECTED}, 8) AS expected FROM parts"))
def expected_of_lists(spark, d):
    """Length and expected F0.5 of the lists that a threshold gives, without labels."""
    out = evaluation.expected_lists(_q(spark, d).withColumn("sel", F.col("q") >= 0.5))
    return out.select("a", F.col("k").cast("long").alias("k"), F.round("expected", 8).alias("expected"))


_CLIP = "least(greatest({0}, 1e-6), 1 - 1e-6)"


@query(D.sql(*D.FULL, _Q, f"""
grid AS (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS w),
loss AS (SELECT w, -avg(CASE WHEN y THEN ln(p) ELSE ln(1 - p) END) AS l FROM (SELECT w, y, w * {_CLIP.format("q")} + (1 - w) * {_CLIP.format("1 - q")} AS p FROM q, grid) GROUP BY w)""",
    select="SELECT w, round(1 - w, 1) AS rest FROM (SELECT w, row_number() OVER (ORDER BY round(l, 12), w) AS r FROM loss) WHERE r = 1"))
def blend_grid(spark, d):
    """The weights of least log loss of a score and its complement."""
    rows = _q(spark, d).withColumn("other", 1 - F.col("q"))
    w, rest = models.blend_weights(rows, ["q", "other"])
    return spark.createDataFrame([(w, round(rest, 1))], "w double, rest double")


@query(D.sql(*D.FULL, _Q, """
edges AS (SELECT DISTINCT unnest(quantile_cont(q, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM q),
binned AS (SELECT q, y, (SELECT count(*) FROM edges WHERE e <= q) AS bin FROM q),
means AS (SELECT bin, count(*) AS n, avg(q) AS x, avg(y::INT) AS m, row_number() OVER (ORDER BY bin) AS i FROM binned GROUP BY bin),
spans AS (SELECT lo.i AS lo, hi.i AS hi, sum(t.m * t.n) / sum(t.n) AS mean FROM means lo, means hi, means t WHERE lo.i <= hi.i AND t.i BETWEEN lo.i AND hi.i GROUP BY lo.i, hi.i),
rising AS (SELECT i, max(least_mean) AS y FROM (SELECT m.i, s.lo, min(s.mean) AS least_mean FROM means m JOIN spans s ON s.lo <= m.i AND s.hi >= m.i GROUP BY m.i, s.lo) GROUP BY i)""",
    select="SELECT m.i, round(m.x, 9) AS x, round(r.y, 9) AS y FROM means m JOIN rising r ON r.i = m.i"))
def calibration_knots(spark, d):
    """The rising map from scores to match rates over ten quantile bins, as its knots."""
    xs, ys = calibration.fit_isotonic(_q(spark, d), "q", "y", bins=10)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True), 1)]
    return spark.createDataFrame(rows, "i long, x double, y double").select("i", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(D.sql(*D.FULL, _Q, """
hm AS (SELECT a, y, q, row_number() OVER (PARTITION BY a ORDER BY q DESC, b) AS r, q / sum(q) OVER (PARTITION BY a) AS share FROM q)""",
    select="SELECT a, max(CASE WHEN r = 1 THEN q END) AS q1, coalesce(max(CASE WHEN r = 2 THEN q END), 0) AS q2, coalesce(max(CASE WHEN r = 3 THEN q END), 0) AS q3, round(sum(q), 8) AS q_sum, count(*) FILTER (q > 0.5) AS n_q05, count(*) FILTER (q > 0.1) AS n_q01, count(*) AS n_cand, round(-sum(share * ln(share)), 8) + 0.0 AS q_entropy FROM hm GROUP BY a"))
def has_match_features(spark, d):
    rows = _q(spark, d).withColumns({c: F.lit(0.0) for c in ("jw_sorted", "atok_cos", "num_shared", "name_freq_a", "ntok_a")})
    out = decisions.has_match_features(rows, D.records(spark, d))
    return out.select("a", "q1", "q2", "q3", F.round("q_sum", 8).alias("q_sum"), "n_q05", "n_q01", "n_cand", (F.round("q_entropy", 8) + 0.0).alias("q_entropy"))


@query(D.sql(*D.FULL, _Q, """
w AS (SELECT a, b, q, coalesce(CASE WHEN row_number() OVER o = 1 THEN lead(q) OVER o ELSE first_value(q) OVER o END, 0) AS ru, count(*) FILTER (q >= 0.5) OVER (PARTITION BY a) AS n FROM q WINDOW o AS (PARTITION BY b ORDER BY q DESC, a)),
v AS (SELECT *, q >= 0.6 AND ru <= 0.5 AND n <= 6 AS pos FROM w)""",
    select="SELECT a, b, CASE WHEN pos THEN 1 ELSE 0 END AS label FROM (SELECT *, bool_or(pos) OVER (PARTITION BY a) AS has FROM v) WHERE pos OR (has AND q <= 0.2)"))
def pseudo_labels(spark, d):
    return decisions.pseudo_labels(_q(spark, d).withColumn("sel", F.col("q") >= 0.5), 0.6, 0.5, 0.2, 6)


# ---------------------------------------------------------------- evaluation


@query(D.sql(*D.FULL, _Q, select="SELECT coalesce(x.a, z.a) AS a, count(*) FILTER (z.b IS NULL) AS n_only_one, count(*) FILTER (x.b IS NULL) AS n_only_other FROM (SELECT a, b FROM q WHERE q >= 0.5) x FULL JOIN (SELECT a, b FROM q WHERE 1.6 * q / (1.6 * q + 1 - q) >= 0.55) z ON z.a = x.a AND z.b = x.b WHERE x.b IS NULL OR z.b IS NULL GROUP BY 1"))
def variant_diff(spark, d):
    rows = _q(spark, d)
    return evaluation.set_differences(rows.filter("q >= 0.5"), rows.filter(decisions.odds_shift(F.col("q"), 1.6) >= 0.55))


_ERRORS = """
kept AS (SELECT a, b, q >= 0.5 AS sel FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY q DESC, b) AS r FROM q) WHERE r <= 3),
wrong AS (SELECT k.a, k.b FROM kept k ANTI JOIN truth t ON t.a = k.a AND t.b = k.b WHERE sel),
errors AS (
  SELECT a, b, 'block_miss' AS error FROM truth t WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.a = t.a AND c.b = t.b)
  UNION ALL SELECT t.a, t.b, 'rerank_miss' FROM truth t JOIN cands c ON c.a = t.a AND c.b = t.b WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.a = t.a AND k.b = t.b)
  UNION ALL SELECT k.a, k.b, 'dropped_true' FROM kept k JOIN truth t ON t.a = k.a AND t.b = k.b WHERE NOT sel
  UNION ALL SELECT a, b, CASE WHEN a IN (SELECT a FROM truth) THEN 'false_match' ELSE 'singleton_fp' END FROM wrong
)"""


def _errors(spark, d):
    kept = _q(spark, d).withColumn("r", windows.rank_desc("a", "q", "b")).filter("r <= 3").select("a", "b", (F.col("q") >= 0.5).alias("sel"))
    return evaluation.error_types(D.cands(spark, d).select("a", "b"), kept, D.truth(spark, d))


@query(D.sql(*D.FULL, _Q, _ERRORS, select="SELECT a, b, error FROM errors"))
def error_types(spark, d):
    return _errors(spark, d)


@query(D.sql(*D.FULL, _Q, _ERRORS, """
ranked AS (SELECT a, b, q, row_number() OVER (PARTITION BY a ORDER BY q DESC, b) AS rank_a FROM q),
tops AS (SELECT a, b AS top_b, q AS top_q FROM ranked WHERE rank_a = 1)""",
    select="""SELECT e.a, e.b, error, x.name AS name_a, z.name AS name_b, r.q, r.rank_a, top_b, top_q FROM errors e JOIN recs x ON x.id = e.a AND x.src = 1 JOIN recs z ON z.id = e.b AND z.src > 1
  LEFT JOIN ranked r ON r.a = e.a AND r.b = e.b LEFT JOIN tops t ON t.a = e.a"""))  # fmt: skip
def error_frames(spark, d):
    """Each error with both names, its score and rank, and the left record's best candidate."""
    out = evaluation.error_frames(_errors(spark, d), _q(spark, d), D.records(spark, d))
    return out.withColumn("rank_a", F.col("rank_a").cast("long"))


_COST = _F05("tp + CASE WHEN error IN ('block_miss', 'rerank_miss', 'dropped_true') THEN k ELSE 0 END", "(n_pred + CASE WHEN error IN ('block_miss', 'rerank_miss', 'dropped_true') THEN k ELSE -k END)", "n_true")


@query(D.sql(*D.FULL, _Q, _CHOSEN, _COUNTS, _ERRORS, select=f"SELECT error, sum(k)::BIGINT AS n, round(sum({_COST} - ({_F05('tp', 'n_pred', 'n_true')})) / (SELECT count(*) FROM counts), 9) AS f05_lost FROM counts JOIN (SELECT error, a, count(*) AS k FROM errors GROUP BY ALL) e ON e.a = counts.a GROUP BY error"))
def error_costs(spark, d):
    return evaluation.error_costs(_counts(spark, d), _errors(spark, d)).withColumn("f05_lost", F.round("f05_lost", 9))


_KS = """
tagged AS (SELECT pool, q AS v, 1 AS x, 0 AS y FROM q WHERE b IN (SELECT id FROM recs WHERE src = 2) UNION ALL SELECT pool, q, 0, 1 FROM q WHERE b IN (SELECT id FROM recs WHERE src = 3)),
steps AS (SELECT pool, v, sum(x) AS x, sum(y) AS y FROM tagged GROUP BY pool, v),
dist AS (SELECT pool, abs(sum(x) OVER r / sum(x) OVER e - sum(y) OVER r / sum(y) OVER e) AS d, sum(x) OVER e > 0 AND sum(y) OVER e > 0 AS ok FROM steps WINDOW r AS (PARTITION BY pool ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY pool))"""


@query(D.sql(*D.FULL, _Q, _KS, select="SELECT pool, round(max(d), 9) AS ks FROM dist WHERE ok GROUP BY pool"))
def ks_shift(spark, d):
    src = D.records(spark, d).select(F.col("id").alias("b"), "src")
    rows = _q(spark, d).join(src, "b")
    return evaluation.ks_statistic(rows.filter("src = 2"), rows.filter("src = 3"), "q", "pool").withColumn("ks", F.round("ks", 9))


@query(D.sql(*D.FULL, _Q, select="SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d) / sqrt(count(*)), 9) AS se FROM (SELECT a, max(q) - min(q) AS d FROM q GROUP BY a)"))
def paired_comparison(spark, d):
    rows = _q(spark, d).groupBy("a")
    return evaluation.paired_difference(rows.agg(F.min("q").alias("f")), rows.agg(F.max("q").alias("f"))).select("n", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


_BAD = "ids AS (SELECT id, CASE src WHEN 1 THEN 'S1-' WHEN 2 THEN 'S2-' ELSE 'S3-' END || id AS e, src FROM recs), items AS (SELECT x.e AS s, z.e AS b FROM cands JOIN ids x ON x.id = a JOIN ids z ON z.id = b WHERE fwd_rank <= 2 UNION ALL SELECT x.e, x.e FROM cands JOIN ids x ON x.id = a WHERE fwd_rank = 1 AND score < 0.2)"


@query(D.sql(*D.BASE, _BAD, select="SELECT 'missing_source' AS problem, e AS id, NULL::VARCHAR AS detail FROM ids WHERE src = 1 AND e NOT IN (SELECT s FROM items) UNION ALL SELECT 'bad_prefix', s, b FROM items WHERE NOT regexp_matches(b, '^S[23]-') UNION ALL SELECT 'unknown_match', s, b FROM items WHERE b NOT IN (SELECT e FROM ids WHERE src > 1)"))
def validate_lists(spark, d):
    """Problems of lists into which some left records' own ids were written, and which leave out left records without candidates."""
    ids = D.records(spark, d).select("id", F.concat(F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-")), F.col("id").cast("string")).alias("entity_id"), "src")
    named = lambda c: ids.select(F.col("id").alias(c), F.col("entity_id").alias(f"e{c}"))
    rows = D.cands(spark, d).join(named("a"), "a").join(named("b"), "b")
    items = rows.filter("fwd_rank <= 2").select("ea", "eb").unionByName(rows.filter("fwd_rank = 1 AND score < 0.2").select("ea", F.col("ea").alias("eb")))
    lists = items.groupBy(F.col("ea").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_list("eb")), ",").alias("matched_entity_ids"))
    return evaluation.validate_lists(lists, ids.filter("src = 1"), ids.filter("src > 1"))


# ---------------------------------------------------------------- sampling, files


@query(D.sql(D.RECORDS, select="SELECT pool AS country, count(*) FILTER (src = 1) AS \"left\", count(*) FILTER (src > 1) AS \"right\" FROM recs GROUP BY pool"))
def country_counts(spark, d):
    return sampling.country_counts(D.records(spark, d).select(F.col("pool").alias("country"), "src"))


@query(D.sql(D.RECORDS, """
train AS (SELECT pool, count(*) FILTER (src = 1) AS n, count(*) FILTER (src > 1) AS m FROM recs WHERE id % 3 <> 0 GROUP BY pool),
test AS (SELECT pool, count(*) FILTER (src = 1) AS n, count(*) FILTER (src > 1) AS m FROM recs WHERE id % 3 = 0 AND pool <> 'es' GROUP BY pool)""",
    select="""SELECT r.pool AS name, round(CASE WHEN t.n IS NULL THEN 1.0 ELSE least(1.0, 0.9 * t.m / r.m) END * CASE WHEN t.n IS NULL THEN 0.9 ELSE 1 END, 9) AS keep,
  round(CASE WHEN t.n IS NULL THEN 0.19 ELSE greatest(0.0, 1 - (r.m / r.n) / (t.m / t.n)) END, 9) AS dropped FROM train r LEFT JOIN test t ON t.pool = r.pool"""))  # fmt: skip
def pool_plan(spark, d):
    """Shares of each training pool that make it as large and as dense as the test's; a pool that the test lacks keeps the cap."""
    rows = D.records(spark, d).select("id", F.col("pool").alias("country"), "src")
    train, test = sampling.counts_by_country(rows.filter("id % 3 <> 0")), sampling.counts_by_country(rows.filter("id % 3 = 0 AND country <> 'es'"))
    plan = [(p.name, round(p.keep, 9), round(p.drop, 9)) for p in sampling.plan_pools(train, test, cap=0.9)]
    return spark.createDataFrame(plan, "name string, keep double, dropped double")


@query(D.sql(D.RECORDS, D.TRUTH, select="SELECT a::VARCHAR AS a, b::VARCHAR AS b FROM truth"))
def files_round_trip(spark, d):
    """Known matches written as lists of ids, an empty one for each left record without any, and read back."""
    left = D.records(spark, d).filter("src = 1").select(F.col("id").alias("a"))
    path = f"{source.shared_folder(spark)}/lists-{uuid.uuid4().hex}"
    source.write_tsv(source.joined_lists(left, D.truth(spark, d).withColumn("s", F.lit(1.0)), "s", "matched_entity_ids"), path)
    return source.read_truth(spark, path)


# ---------------------------------------------------------------- whole runs


@query()
def pair_features(spark, d):
    """All comparison columns of each candidate."""
    return linkage.features(spark, d)


@query()
def linkage_lists(spark, d):
    """Left records with their match lists: blocking, re-ranking, features, boosted trees in two stages, calibration, decision."""
    return linkage.run(spark, d)


