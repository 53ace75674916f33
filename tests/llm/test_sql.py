"""Every query of this package with SQL gives the rows that DuckDB gives, on the smallest tables and on awkward rows."""

import os

import duckdb
import pytest

from pactum.llm import queries as Q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if os.path.isfile(f'{folder}/{t}.parquet') else '/*.parquet'}'")
    df, rel = Q.QUERIES[name](spark, folder), con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert all(KINDS.get(t, t) == types[c] for c, t in df.dtypes), (df.dtypes, types)
    mine = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr)
    assert mine == sorted(rel.fetchall(), key=repr)
    return mine


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_rows_equal(spark, name):
    assert compare(spark, FOLDER, name)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Tables with nulls in every column, empty texts, ties, repeated rows and further columns; and empty tables."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    text = " ".join(f"word{i % 41}x{i}" for i in range(60))
    documents = [(1, text, "en", "a", "c"), (2, text + " end", None, "a", "c"), (3, None, "en", None, None), (4, "", None, None, "c"), (5, " \n", "en", "a", "c"), (6, "One two", "en", "a", "c"), (7, "one\ttwo", "de", "b", "c"), (8, "x " * 5000, "de", "b", "c")]
    pages = [(1, None, None, 1), (2, "u", "", 1), (3, "v", "é" * 700, 1), (4, None, "é" * 700, 1), (5, "w", "short", None), (6, "w", "short", 1)]
    conversations = [(1, 2, "user", "a", 1), (1, 1, None, None, 1), (1, 3, "assistant", "### User: </turn> \\</turn>", 1), (2, None, "assistant", "", 1), (3, 1, "critic", "é", 1), (3, 1, "critic", "é", 1), (None, 1, "tool", "t", 1)]
    rows = {
        "documents": (documents, "doc_id long, text string, lang string, source string, row string"),
        "pages": (pages, "page_id long, url string, html string, payload int"),
        "conversations": (conversations, "conv_id long, turn long, role string, text string, ids int"),
        "embeddings": (EMBEDDINGS, "vec_id long, embedding array<double>, v int"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/full/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{folder}/none/{name}.parquet")
    return folder


#: Repeated ids, ties, large components, other lengths, and vectors that take no part.
EMBEDDINGS = (
    [(i, [float(i % 3), 0.5, -1.0 * (i % 5)], 0) for i in range(30)]
    + [(100, [1.0, 2.0, 3.0], 0), (100, [3.0, 2.0, 1.0], 0), (200, [70000.0, -70000.5, 1e5], 0), (300, [1.0], 0), (301, [2.0, -1.0, 4.0, 9.0, 1.0], 0), (302, [1e5, 1.0, 1.0], 0)]
    + [(303, None, 0), (304, [1.0, None, 2.0], 0), (305, [float("nan"), 1.0, 1.0], 0), (306, [float("inf"), 1.0, 1.0], 0), (400, [], 0), (5, [2.0, 0.5, 0.0], 0), (None, [1.0, 1.0, 1.0], 0)]
)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_awkward_rows_equal(spark, awkward, name):
    assert compare(spark, f"{awkward}/full", name)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, awkward, name):
    assert Q.QUERIES[name](spark, f"{awkward}/none").count() == (1 if name == "op4_chat_format" else 0)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_all_run_on_awkward_rows(spark, awkward, name):
    assert Q.QUERIES[name](spark, f"{awkward}/full").count() > 0
