"""Odd rows, odd columns and empty tables through every operator and every stage of the pipeline."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import _exchange, ann, bpe, lines, lm, minhash, mixing, pii, pipeline, quality, substring, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PROSE = "the cat of the house and a dog in that street was on it for to be with as are this by at or from " * 2
LONG = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(30_000))  # a megabyte of words that differ
ROWS = [
    (1, PROSE, "en", "src0"), (2, PROSE, "en", "src0"), (2, PROSE, "en", "src0"), (2, "another text of the same id " + PROSE, "en", "src1"), (3, None, None, None), (4, "", "en", ""),
    (5, " \n\t\n ", "xx", "src2"), (None, PROSE, "en", "src0"), (None, None, "de", "src1"), (6, LONG, "en", "src1"), (7, "é中😀 " * 40, "fr", "x"), (1 << 60, "a far id, mail a@b.co", "en", "src3"),
    (-9, "x\ny\nz\nx\ny\nz", "es", "src4"), (8, "q", "en", "src0"),
]
#: Columns that operators make themselves, or whose names have to be quoted.
EXTRA = ["a.b", "language", "_q", "_row", "_words", "_bpe", "_all", "ref_common", "ref_classes", "domain", "kept", "n_removed", "label", "key", "g", "data", "bits", "bucket", "select", "n chars"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string, place long")
    return rows.select("*", *(F.concat(F.lit(f"{c}:"), F.col("place").cast("string")).alias(c) for c in EXTRA)).repartition(3)


OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, PATH),
    "substring": substring.dedup_substrings,
    "minhash": minhash.near_duplicates,
    "lines": lines.dedup_lines,
    "mixing": lambda d: mixing.mix(d, mixing.WEIGHTS, max_epochs=1),
    "quality": quality.judge,
    "lm": lm.score,
    "pii": pii.find_personal_data,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(odd, name):
    got = OPERATORS[name](odd).collect()
    ids = lambda rows: sorted(str(r["doc_id"]) for r in rows)
    if name != "mixing":
        assert ids(got) == sorted(str(r[0]) for r in ROWS)
    if name in ("lines", "quality", "mixing"):  # other columns come through with their rows
        made = {"lines": ["n_removed"], "quality": ["kept"], "mixing": ["domain"]}[name]
        for r in got:
            assert all(r[c] == f"{c}:{r['place']}" for c in EXTRA if c not in made)
    if name == "mixing":  # every leaf is taken whole; a leaf without tokens gives nothing
        assert {r["place"] for r in got} >= {0, 1, 2, 3, 9, 13}
    if name == "quality":
        by = {r["place"]: r for r in got}
        assert by[4]["n_words"] == by[5]["n_words"] == by[6]["n_words"] == 0 and by[4]["base_failed"] and by[9]["n_words"] == 30_000 and by[9]["word_chars"] == 32 * 30_000
    if name == "substring":
        removed = {}
        for r in got:
            removed.setdefault(r["doc_id"], []).append(r["n_removed"])
        n = len(PROSE.split())
        assert removed[1] == [0] and sorted(removed[2]) == [n, n, n] and removed[None].count(n) == 1 and removed[6] == [0]
    if name == "minhash":
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
        assert by[2] == {(1, False)} and by[None] == {(None, True)} and by[6] == {(6, True)} and by[1] == {(1, True)}
    if name == "pii":
        assert {r["doc_id"]: len(r["spans"]) for r in got}[1 << 60] == 1


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_on_nothing(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_ties_of_lines_do_not_depend_on_the_order_of_rows(spark):
    rows = [(5, "a\nb\nc\nfirst"), (5, "a\nb\nc\nsecond"), (None, "a\nb\nc\nnone"), (None, "p\nq\nr"), (None, "p\nq\nr\ns")]
    one, other = (sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(spark.createDataFrame(x, "doc_id long, text string").coalesce(1)).collect()) for x in (rows, rows[::-1]))
    assert one == other and [t for i, t in one if i == 5].count("a\nb\nc\nfirst") + [t for i, t in one if i == 5].count("a\nb\nc\nsecond") == 1
    assert [t for i, t in one if not i] == ["none", "p\nq\nr", "p\nq\nr\ns"]  # rows without an id keep what only they have


def test_group_bits(spark):
    frame = lambda ids, size=1024: spark.createDataFrame([(i, "x" * size) for i in ids], "doc_id long, text string")
    assert _exchange.group_bits(frame(range(3000))) == 10  # a thousand texts of a thousand bytes
    assert _exchange.group_bits(frame(range(0, 3000 << 20, 1 << 20))) in (29, 30)  # sparse ids
    assert _exchange.group_bits(frame([7] * 2000)) <= 10 and _exchange.group_bits(frame([])) == 0
    assert _exchange.group_bits(frame(range(20), 1 << 20)) == 0  # a text fills a group


def test_vectors_and_pages(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)], i) for i in range(60)] + [(3, [1.0, 1.0, 1.0], 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, place long").withColumn("a.b", F.lit(1)).withColumn("v", F.lit(2)).withColumn("_q", F.lit(3)).withColumn("cell", F.lit(4))
    got = ann.nearest(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in range(0, 60, 10) for k in range(1, 6)]
    ties = spark.createDataFrame([(i, [1.0, 0.0] if i == 0 else [1.0, 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(ties, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    pages = spark.createDataFrame([(1, "u", "x", 1), (2, None, "x", 2), (None, "u", None, 3), (3, "u", LONG, 4)], "page_id long, url string, html string, file long").withColumn("a.b", F.lit(1)).withColumn("offset", F.lit(1))
    folder = _exchange.new_path(spark, "edges")
    back = warc.read_archive(warc.write_archive(pages, folder), folder, payloads=True).collect()
    assert {r["page_id"]: r["refers_to"] for r in back} == {1: None, 2: 1, None: None, 3: None} and {r["page_id"]: r["payload"] for r in back}[3] == LONG.encode()


def test_stages(spark, odd):
    docs = odd
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
            assert all(r[c] == f"{c}:{r['place']}" for r in got for c in EXTRA), name
            docs = spark.createDataFrame(got, docs.schema)
        assert stage(spark, odd.limit(0), "").count() == 0, name
    assert {r["doc_id"] for r in got} <= {1, 2, 6, None} and all(r["round_trip"] for r in got)
