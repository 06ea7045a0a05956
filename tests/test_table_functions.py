"""Chunks from SQL: the table function against the DataFrame form, registered chunkers, errors when a plan is made."""

import random

import pytest

from quarry.jobs import registry
from quarry.operators import syntax, table_functions


def _texts():
    dice = random.Random(3)
    for n in range(60):
        lines = []
        for _ in range(dice.randrange(60)):
            kind = dice.random()
            lines.append("#" * dice.randint(1, 4) + f" {dice.choice('abc')} > {dice.randrange(3)}" if kind < 0.25 else "" if kind < 0.4 else "word " * dice.randrange(40))
        yield n, "\n".join(lines), ("markdown", None, "python", "markdown")[n % 4], n % 5 + 1
    yield 90, None, "markdown", 1
    yield 91, "", None, 1
    yield 92, "w " * 220, None, 1
    yield 93, "w " * 221 + "\n" + "x " * 180, None, 7


def test_sql_equals_the_dataframe_form(spark):
    docs = spark.createDataFrame(list(_texts()), "doc_id long, text string, language string, line int")
    docs.createOrReplaceTempView("docs_to_chunk")
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM chunk(TABLE(docs_to_chunk), line => 'line')")
    want = syntax.chunks(docs, "doc_id", line_col="line")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[2])) == sorted(map(tuple, want.collect()), key=lambda r: (r[0], r[2]))
    by_source = spark.sql("SELECT count(*) FROM chunk(TABLE(docs_to_chunk) PARTITION BY language, line => 'line')").first()[0]
    assert by_source == want.count() > 100


def test_registered_chunkers(spark):
    table_functions.CHUNKERS["lines"] = lambda text, language, line: (table_functions.Chunk(t, line + n, line + n) for n, t in enumerate(text.split("\n")))
    try:
        docs = spark.createDataFrame([(1, "a\nb", None), (2, None, None)], "id long, body string, kind string")
        got = table_functions.chunks(docs, "lines", "body", "kind").collect()
        assert [tuple(r) for r in got] == [(1, None, 0, "a", 1, 1, ""), (1, None, 1, "b", 2, 2, "")]
    finally:
        del table_functions.CHUNKERS["lines"]
    for wrong, said in ((("none", "body", "kind"), "no chunker"), (("auto", "text", "kind"), "no column")):
        with pytest.raises(Exception, match=said):
            table_functions.chunks(docs, *wrong).collect()


def test_query_is_registered():
    assert "chunk_function" in registry.QUERIES and "chunk_function" in registry.SQL
