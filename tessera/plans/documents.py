"""A record-linkage view of the `documents` table, as every query of the catalog uses it.

The tables hold no business records, so each document stands for one: its source gives the role (1 left, 2 and 3 right), its
language the pool, its first line is the name and its other lines are the address, all of them whole. Known matches are
equal texts in one pool, each right record owned by the smallest left id. Numbers are digit strings of any length, without
leading zeros.

Many queries start from the same records and candidates. They are written once for each state of the table, as Parquet in
the folder that the cluster shares, and read from there by every query of the application.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.operators import blocking
from tessera.operators.scoring import write_kept
from tessera.sources.tables import shared_folder

HOW = blocking.Blocking(k1=5, rev_k=2)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))


#: Tables of this application: (application, folder, state of the table, name) -> path.
_WRITTEN: dict[tuple, str] = {}


def _state(spark, path: str) -> str:
    """Names, sizes and times of a table's files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(where)))


def written(spark, sf_dir: str, name: str, make) -> DataFrame:
    """make()'s table (one, or parts that are written one after the other), from the shared folder if this application has written it for the documents as they are now."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, f"{sf_dir}/documents.parquet"), name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
        made = make()
        for part in made if isinstance(made, list) else [made]:
            write_kept(spark, part, path, "append")
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table that is read in fewer parts than there are cores, dealt out by a key; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = rows.inputFiles()
    return rows.repartition(cores, key) if len(files) < cores else rows


def records(spark, sf_dir: str) -> DataFrame:
    """id, src, pool, name, same, core, sorted, concat, nt, a_sorted, at, nu, state, a_empty. same: equal for equal texts. Only what
    does not follow from another column is written."""
    rows = written(spark, sf_dir, "records", lambda: _records(spark, sf_dir))
    words = _words(F.col("name"))
    rows = rows.withColumns({"core": F.array_join(words, " "), "concat": F.array_join(words, ""), "nt": F.array_sort(F.array_distinct(words))})
    return rows.withColumns({"sorted": F.array_join("nt", " "), "a_sorted": F.array_join("at", " "), "a_empty": (F.size("at") == 0).cast("int")})


def _records(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", F.lower(F.coalesce("text", F.lit(""))).alias("text")), "doc_id")
    split = docs.select(
        F.col("doc_id").alias("id"), (1 + F.substring("source", 4, 9).cast("int") % 3).alias("src"), F.col("lang").alias("pool"), "text", "source",
        F.get(F.split("text", "\n"), F.lit(0)).alias("name"), F.regexp_extract("text", "(?s)^[^\n]*\n(.*)$", 1).alias("rest"),
    )
    numbers = F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda d: F.regexp_replace(d, "^0+(?=.)", ""))
    return split.select(
        "id", "src", "pool", "name", F.unhex(F.sha2("text", 256)).alias("same"), F.array_sort(F.array_distinct(_words(F.col("rest")))).alias("at"),
        F.array_sort(F.array_distinct(numbers)).alias("nu"), F.when(F.contains("text", F.lit("license")), F.col("source")).alias("state"),
    )


RECORDS = """
docs AS (SELECT doc_id AS id, 1 + CAST(substr(source, 4) AS INT) % 3 AS src, lang AS pool, lower(coalesce(text, '')) AS text, source FROM documents),
split AS (SELECT *, string_split(text, chr(10)) AS ls FROM docs),
named AS (SELECT *, ls[1] AS name, regexp_extract_all(ls[1], '[a-z]+') AS words, regexp_extract_all(array_to_string(ls[2:], chr(10)), '[a-z]+') AS rest FROM split),
recs AS (
  SELECT id, src, pool, name, text, array_to_string(words, ' ') AS core, array_to_string(words, '') AS concat, words,
    list_sort(list_distinct(words)) AS nt, list_sort(list_distinct(rest)) AS adr,
    list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END))) AS nu,
    CASE WHEN contains(text, 'license') THEN source END AS state
  FROM named
)"""


def truth(spark, sf_dir: str) -> DataFrame:
    """(a, b) of equal texts in one pool."""
    rows = records(spark, sf_dir).select("id", "src", "pool", "same")
    left = rows.filter("src = 1").groupBy("pool", "same").agg(F.min("id").alias("a"))
    return rows.filter("src > 1").join(left, ["pool", "same"]).select("a", F.col("id").alias("b"))


TRUTH = """
truth AS (SELECT a, r.id AS b FROM recs r JOIN (SELECT pool, text, min(id) AS a FROM recs WHERE src = 1 GROUP BY pool, text) l ON l.pool = r.pool AND l.text = r.text WHERE r.src > 1)"""

FEATURES = """
feats AS (
  SELECT DISTINCT id, src, pool, f.type AS type, f.feature AS feature FROM (
    SELECT id, src, pool, unnest(list_concat(
      list_concat(list_transform(nt, lambda x: {'type': 'ntok', 'feature': x}), list_transform(range(1, length(concat) + 1), lambda i: {'type': 'tri', 'feature': substr('^' || concat || '$', i, 3)})),
      list_concat(list_transform(adr, lambda x: {'type': 'atok', 'feature': x}), list_transform(nu, lambda x: {'type': 'num', 'feature': x})),
      list_concat(
        flatten(list_transform(nu[1:3], lambda x: list_transform(adr[1:10], lambda t: {'type': 'numx', 'feature': x || '|' || t}))),
        flatten(list_transform(nu[1:3], lambda x: list_transform(nt[1:6], lambda t: {'type': 'nnum', 'feature': x || '|' || t})))),
      CASE WHEN len(words) = 1 THEN [{'type': 'span', 'feature': words[1]}] ELSE
        flatten(list_transform(range(1, least(len(words), 6) + 1), lambda i: list_transform(range(i + 1, least(len(words), 6) + 1), lambda j: {'type': 'span', 'feature': array_to_string(words[i:j], '')}))) END
    )) AS f FROM recs)
),
caps(type, cap, tw) AS (VALUES ('ntok', 20000, 1.0), ('tri', 5000, 0.35), ('atok', 20000, 0.8), ('num', 20000, 0.8), ('numx', 5000, 1.0), ('nnum', 5000, 1.0), ('span', 2000, 1.0)),
weights AS (
  SELECT f.pool, f.type, f.feature, f.df, c.tw::DOUBLE * ln((s.n + 1)::DOUBLE / f.df) AS w
  FROM (SELECT pool, type, feature, count(*) AS df FROM feats WHERE src > 1 GROUP BY ALL) f
  JOIN caps c ON c.type = f.type AND f.df <= c.cap JOIN (SELECT pool, count(*) FILTER (src > 1) AS n FROM recs GROUP BY pool) s ON s.pool = f.pool
),
vecs AS (
  SELECT id, src, f.pool, f.type, f.feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS v
  FROM feats f JOIN weights w ON w.pool = f.pool AND w.type = f.type AND w.feature = f.feature WHERE w <> 0
)"""

PAIRS = """
probes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, type, feature) AS r FROM vecs WHERE src = 1) WHERE r <= 48),
sims AS (
  SELECT p.id AS a, d.id AS b, p.pool, round(sum(p.v * d.v), 9) AS score
  FROM probes p JOIN vecs d ON d.src > 1 AND d.pool = p.pool AND d.type = p.type AND d.feature = p.feature GROUP BY ALL
),
fwd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS fwd_rank FROM sims) WHERE fwd_rank <= 5),
rev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rank FROM sims) WHERE rank <= 2),
cands AS (
  SELECT a, b, pool, score, fwd_rank, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rev_rank, max(score) OVER (PARTITION BY a) - score AS gap_a,
    max(score) OVER (PARTITION BY b) - score AS gap_b, count(*) OVER (PARTITION BY b) AS n_cand_b
  FROM (SELECT a, b, any_value(pool) AS pool, max(score) AS score, min(fwd_rank) AS fwd_rank FROM (SELECT a, b, pool, score, fwd_rank FROM fwd UNION ALL SELECT a, b, pool, score, 6 FROM rev) GROUP BY a, b)
)"""

#: Candidates with both records, and whether they are known to match.
SIDES = """
pairs AS (
  SELECT c.*, lft AS L, rgt AS R, t.a IS NOT NULL AS y FROM cands c JOIN recs lft ON lft.id = c.a JOIN recs rgt ON rgt.id = c.b LEFT JOIN truth t ON t.a = c.a AND t.b = c.b
)"""


def cands(spark, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "candidates", lambda: blocking.candidates(records(spark, sf_dir), HOW))


def pairs(spark, sf_dir: str) -> DataFrame:
    """Candidates with structs L and R and y."""
    rows = records(spark, sf_dir)
    one = F.struct(*rows.columns)
    left, right = rows.select(F.col("id").alias("a"), one.alias("L")), rows.select(F.col("id").alias("b"), one.alias("R"))
    # y first, so that the rows that carry both records are not dealt out again
    return _marked(spark, sf_dir).join(left, "a").join(right, "b")


def _marked(spark, sf_dir: str) -> DataFrame:
    """Candidates with y."""
    known = truth(spark, sf_dir).withColumn("y", F.lit(True))
    return cands(spark, sf_dir).join(known, ["a", "b"], "left").withColumn("y", F.coalesce("y", F.lit(False)))


def dealt(rows: DataFrame) -> DataFrame:
    """Pairs dealt out by number: small rows that take long to compare would be merged into a few tasks by their bytes."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, "a", "b")


def _words_of(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _in_parts(spark, sf_dir: str, pairs: DataFrame, carried: Column, compared) -> list[DataFrame]:
    """compared(pairs) for parts of the pairs (a, b). A pair that carries its left record's fields (carried: their bytes) is as large
    as a document, so the rows of a part are together no larger than half of the table; a part's shuffle files go before the next one starts."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    table = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    left = records(spark, sf_dir).select(F.col("id").alias("a"), carried.alias("n"))
    total = pairs.select("a").join(left, "a").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-2 * total // max(table, 1 << 20)))
    return [compared(pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i)) for i in range(parts)]


def overlaps(spark, sf_dir: str) -> DataFrame:
    """(a, b, n_a, n_b, n_shared) of the address tokens of all candidates, compared in parts."""
    return written(spark, sf_dir, "overlaps", lambda: _overlaps(spark, sf_dir))


def _overlaps(spark, sf_dir: str) -> list[DataFrame]:
    rows = records(spark, sf_dir).select("id", "a_sorted")

    def compared(pairs: DataFrame) -> DataFrame:
        one = pairs.join(rows.select(F.col("id").alias("a"), F.col("a_sorted").alias("x")), "a")
        both = one.join(rows.select(F.col("id").alias("b"), F.col("a_sorted").alias("y")), "b").select("a", "b", _words_of(F.col("x")).alias("x"), _words_of(F.col("y")).alias("y"))
        return both.select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.size(F.array_intersect("x", "y")).alias("n_shared"))

    return _in_parts(spark, sf_dir, cands(spark, sf_dir).select("a", "b"), F.length("a_sorted"), compared)


def compared(spark, sf_dir: str) -> DataFrame:
    """(a, b, y, score, jw_sorted, n_a, n_b, n_shared, num_shared, num_conflict, state_cat) of all candidates: names, address tokens
    (as in overlaps), numbers and states, compared in one pass and in parts. Rows of one id are compared each."""
    return written(spark, sf_dir, "compared", lambda: _compared(spark, sf_dir))


def _compared(spark, sf_dir: str) -> list[DataFrame]:
    marked = written(spark, sf_dir, "marked", lambda: _marked(spark, sf_dir).select("a", "b", "y", "score"))
    every = records(spark, sf_dir)
    once = not every.groupBy("id").count().filter("count > 1").limit(1).count()  # rows of one id may have both roles
    side = lambda key, name, role: (every.filter(role) if once else every).select(F.col("id").alias(key), F.struct("sorted", "a_sorted", "nu", "state").alias(name))

    def one_pass(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(side("a", "L", "src = 1"), "a").join(side("b", "R", "src > 1"), "b")
        numbers, x, y = sim.number_stats(F.col("L.nu"), F.col("R.nu")), _words_of(F.col("L.a_sorted")), _words_of(F.col("R.a_sorted"))
        return rows.select(
            "a", "b", "y", "score", sim.jaro_winkler_column(F.col("L.sorted"), F.col("R.sorted"), "floored").alias("jw_sorted"), F.size(x).alias("n_a"), F.size(y).alias("n_b"), F.size(F.array_intersect(x, y)).alias("n_shared"),
            numbers["shared"].alias("num_shared"), numbers["conflict"].alias("num_conflict"), sim.category(F.col("L.state"), F.col("R.state")).alias("state_cat"),
        )

    return _in_parts(spark, sf_dir, marked, F.length("sorted") + F.length("a_sorted") + F.length(F.array_join("nu", " ")), one_pass)


def sql(*parts: str, select: str) -> str:
    return "WITH" + ",".join(parts) + "\n" + select


BASE = (RECORDS, FEATURES, PAIRS)
FULL = (RECORDS, TRUTH, FEATURES, PAIRS, SIDES)
