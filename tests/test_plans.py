"""Every query of the library gives the rows of its SQL, or some rows where SQL can't express it."""

from __future__ import annotations

import random

import pytest

from paperloom import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_has_all_queries():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_markdown_blocks_equal_the_sql_whatever_lines_hold(spark, tmp_path):
    import duckdb

    odd = [
        "# top", "3. Von mit", "- a", "| a | b |", "", "x y", " a\tb ", "\xa0", "   ", "```", "~~~ b", "c\rd", "e\x85f",
        "　wide ", "\tc\t", "end \t", "## under", "g\xa0　", "|", "1) one", "| x |", "# z", "last", "\x0c", "### ", "4. Zuen",
    ]
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(odd) for _ in range(rng.choice([1, 3, 9, 40, 600]))) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, "", "\n\n\n", None])]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(SQL["markdown_blocks"])
    columns, want = [c[0] for c in expected.description], expected.fetchall()
    found = QUERIES["markdown_blocks"](spark, str(tmp_path))
    assert len(want) > 1_000
    assert rows_of(found.columns, found.collect()) == rows_of(columns, want)
