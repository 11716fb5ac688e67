"""The pipeline against a brute-force version, and the registered SQL on the small tables."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import mixing, queries
from tests.llm.test_bpe import PLAIN

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after)), name


def test_run_against_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    kept = {r[0] for r in con.sql("SELECT doc_id FROM (" + queries.SQL["op6_quality_divergence"] + ") WHERE kept").fetchall()}
    rows = {i: (t, lang, s) for i, t, lang, s in con.sql("SELECT doc_id, text, lang, source FROM documents").fetchall() if i in kept}
    from tests.llm.test_dedup import linked, without_lines

    texts = {i: t for i, t, *_ in without_lines([(i, r[0]) for i, r in rows.items()], 3)}
    own = {i: root for i, (_, root) in linked(list(texts.items())).items()}
    texts = {i: t for i, t in texts.items() if own[i] == i}
    tokens = {i: len(PLAIN.encode_ordinary(t)) for i, t in texts.items()}

    def domain(source: str) -> str:
        return ("web", "books", "code")[int(source[3:]) % 3]

    def share(budget: float, children: dict) -> dict:
        """children: name -> (weight, capacity). Fill the children that cannot use their part, share the rest anew."""
        given, rest = {}, dict(children)
        while rest:
            level = (budget - sum(given.values())) / sum(w for w, _ in rest.values())
            full = {n for n, (w, c) in rest.items() if c <= level * w + 1e-9}
            if not full:
                return given | {n: min(c, w * level) for n, (w, c) in rest.items()}
            given |= {n: rest.pop(n)[1] for n in full}
        return given

    leaf = {i: (domain(rows[i][2]), rows[i][1], rows[i][2]) for i in texts}
    capacity = Counter()
    for i, path in leaf.items():
        for k in range(4):
            capacity[path[:k]] += tokens[i]
    budgets = {(): min(mixing.PIPELINE_SHARE * capacity[()], capacity[()])}
    for k, level in enumerate(mixing.LEVELS):
        for parent in [p for p in budgets if len(p) == k]:
            names = {p for p in capacity if len(p) == k + 1 and p[:k] == parent}
            budgets |= share(budgets[parent], {p: (mixing.WEIGHTS[level].get(p[-1], 1.0), capacity[p]) for p in names})
    chosen = set()
    for path in set(leaf.values()):
        before = 0
        order = sorted((i for i in texts if leaf[i] == path), key=lambda i: hashlib.md5(f"11:1:{i}".encode()).hexdigest())
        for i in order:
            if capacity[path] and (before < budgets[path] - 1e-6 or budgets[path] > capacity[path] - 1e-6):
                chosen.add(i)
            before += tokens[i]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == chosen
    for i, r in got.items():
        ids = PLAIN.encode_ordinary(texts[i])
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids) and r["round_trip"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    relation = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    assert sorted(relation.columns) == cols
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = Counter(str(tuple(plain(r[relation.columns.index(c)]) for c in cols)) for r in relation.fetchall())
    assert Counter(str(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= set(names) == set(__spark_entry__.queries())
