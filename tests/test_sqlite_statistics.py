"""Statistics of a database file against SQLite's own."""

import random
import sqlite3

import pytest

from tablesense.sources.sqlite_ds import sqlite_statistics


@pytest.fixture
def base(tmp_path):
    rng = random.Random(3)
    c = sqlite3.connect(tmp_path / "a.db")
    c.execute('CREATE TABLE "odd ""name" (a INTEGER, "b c" TEXT, d, e REAL)')
    c.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?)', [(rng.randrange(90), rng.choice(["x", "y", None, "é", "1"]), rng.choice([1, 1.0, "1", None, b"\x01", 2.5]), rng.choice([0.5, 3.0, None])) for _ in range(700)])
    c.execute('DELETE FROM "odd ""name" WHERE rowid % 7 = 0')
    c.execute("CREATE TABLE pairs (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    c.executemany("INSERT INTO pairs VALUES (?, ?)", [(f"k{i}", i % 3) for i in range(20)])
    c.execute("CREATE TABLE empty_one (z TEXT)")
    c.execute("CREATE TABLE sqliteish (n INT)")
    c.execute("INSERT INTO sqliteish VALUES (1)")
    c.commit()
    yield c, str(tmp_path / "a.db")
    c.close()


@pytest.mark.parametrize("parts", [1, 5])
def test_statistics_are_those_of_sqlite(spark, base, parts):
    c, path = base
    got = {(r["table_name"], r["column_name"]): r for r in sqlite_statistics(spark, path, parts).collect()}
    tables = {'odd "name': ["a", "b c", "d", "e"], "pairs": ["k", "v"], "empty_one": ["z"], "sqliteish": ["n"]}
    assert set(got) == {(t, n) for t, names in tables.items() for n in names}
    for (t, n), r in got.items():
        table, column = '"' + t.replace('"', '""') + '"', f'"{n}"'
        rows, different = c.execute(f"SELECT count(*), count(DISTINCT {column}) FROM {table}").fetchone()
        assert (r["row_count"], r["cardinality"]) == (rows, different)
        counts = [k for _, k in c.execute(f"SELECT {column}, count(*) FROM {table} GROUP BY 1 ORDER BY 2 DESC LIMIT 5").fetchall()]
        assert (r["samples"] is None) if different > 60 else [s["cnt"] for s in r["samples"]] == counts
        assert len(r["first_values"]) == min(2, rows)
    assert got['odd "name', "a"]["samples"] is None and {s["value"] for s in got['odd "name', "b c"]["samples"]} == {"x", "y", None, "é", "1"}
    (head,) = c.execute('SELECT "b c" FROM "odd ""name" LIMIT 1').fetchone()
    assert got['odd "name', "b c"]["first_values"][0] == head
