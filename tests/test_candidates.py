"""Queries over candidates never make a row for each pair of records that share a feature, nor carry all records' tokens at once."""

import random
from collections import Counter

import pytest

from tessera.functions.similarity import jaro_winkler
from tessera.operators import blocking
from tessera.plans import catalog, documents

NAMES = [
    "blend_grid",
    "calibration_knots",
    "candidate_structure",
    "categories",
    "error_costs",
    "error_frames",
    "error_types",
    "exclusive_by_pool",
    "expected_of_lists",
    "fs_em",
    "fs_mu_table",
    "hard_exclusive",
    "has_match_features",
    "idf_cosine",
    "jaccard_tokens",
    "ks_shift",
    "lev_ratio",
    "macro_f05",
    "num_stats",
    "pair_context",
    "prefix_ratio",
    "pseudo_labels",
    "recall_rollup",
    "selected_lists",
]


@pytest.fixture(scope="module", autouse=True)
def no_pair_rows():
    def fails(*_):
        raise AssertionError("a row for each pair that shares a feature")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(blocking, "similar_pairs", fails)
        patch.setattr(documents, "_WRITTEN", {})
        yield


@pytest.mark.parametrize("name", NAMES)
def test_in_blocks(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_lev_ratio_dealt_by_number(spark):
    plan = catalog.QUERIES["lev_ratio"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert plan.index("levenshtein") < plan.index("RepartitionByExpression")  # compared after they were dealt out


@pytest.fixture(scope="module")
def one_line(spark, tmp_path_factory):
    """Documents of one long line: the whole text is the name. The last id is there twice."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [word() for _ in range(1800)]
    rows = [(i, " ".join(r.sample(base, 1400) + [word() for _ in range(100)]) + f" {i % 4}", "en", f"src{i % 3}") for i in range(90)]
    rows.append((89, rows[88][1], "en", "src2"))
    d = str(tmp_path_factory.mktemp("one_line"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d, rows


def compared_in_parts(spark, one_line, monkeypatch, name):
    """The query's rows, and (a, b, jw) as written; the pairs that carry names must be written in parts."""
    parts, write = Counter(), documents.write_kept
    monkeypatch.setattr(documents, "_WRITTEN", {})
    monkeypatch.setattr(blocking, "similar_pairs", SIMILAR)  # an id that is there twice
    monkeypatch.setattr(documents, "write_kept", lambda spark, rows, path, *a: (parts.update([path]), write(spark, rows, path, *a)))
    got = catalog.QUERIES[name](spark, one_line[0]).collect()
    assert max(parts.values()) > 1
    return got, catalog._compared(spark, one_line[0]).collect()


SIMILAR = blocking.similar_pairs


def test_fs_mu_table_in_parts(spark, one_line, monkeypatch):
    got, rows = compared_in_parts(spark, one_line, monkeypatch, "fs_mu_table")
    assert len(got) == 30
    texts: dict = {}
    for i, text, _, _ in one_line[1]:
        texts.setdefault(i, []).append(text)
    sides = lambda t: (" ".join(sorted({w for w in t.split() if not w.isdigit()})), t.split()[-1])
    want = []
    for r in documents.cands(spark, one_line[0]).collect():
        for x in map(sides, texts[r["a"]]):
            want += [(r["a"], r["b"], jaro_winkler(x[0], y[0], floored=True), int(x[1] == y[1])) for y in map(sides, texts[r["b"]])]
    assert any(r[1] == 89 for r in want)
    assert sorted((r["a"], r["b"], r["jw_sorted"], r["num_shared"]) for r in rows) == sorted(want)


def test_fs_em_in_parts(spark, one_line, monkeypatch):
    got, rows = compared_in_parts(spark, one_line, monkeypatch, "fs_em")
    assert sorted((r["a"], r["b"]) for r in got) == sorted((r["a"], r["b"]) for r in rows)
