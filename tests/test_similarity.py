"""Floored Jaro-Winkler to the last bit against DuckDB: thresholds and rounded values depend on it."""

import random

import duckdb

from tessera.functions.similarity import jaro_winkler


def made(n: int = 4000) -> list[tuple[str, str]]:
    rng, out = random.Random(5), []
    for _ in range(n):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 200)))
        b = list(a)
        for _ in range(rng.randint(1, 1 + len(a) // 3)):
            b[rng.randrange(len(b))] = rng.choice("abcde ")
        out.append((a, "".join(b)))
    return out


def in_duckdb(pairs: list[tuple[str, str]]) -> list[float]:
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INT, x VARCHAR, y VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", [(i, x, y) for i, (x, y) in enumerate(pairs)])
    return [r[0] for r in con.sql("SELECT jaro_winkler_similarity(x, y) FROM p ORDER BY i").fetchall()]


def test_every_bit():
    pairs = made()
    assert [jaro_winkler(x, y, True) for x, y in pairs] == in_duckdb(pairs)


def test_levels_of_the_weights():
    """The levels that fs_llr makes of it use the same bits."""
    cuts = [0.97, 0.9, 0.8]
    pairs = [(" ".join(sorted(set(x.split()))), " ".join(sorted(set(y.split())))) for x, y in made(3000)]
    got, want = [jaro_winkler(x, y, True) for x, y in pairs], in_duckdb(pairs)
    assert [[v >= c for c in cuts] for v in got] == [[v >= c for c in cuts] for v in want]
    assert got == want
