"""Search over written parts against a full scan: ties, zeros, equal vectors, filters, share of what is read."""

import numpy as np
import pytest

from quarry.jobs import scratch
from quarry.operators import parts, search


def clustered(seed=1, clusters=12, each=60, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        centre = rng.normal(size=dim)
        for _ in range(each):
            rows.append((centre + rng.normal(size=dim) * 0.05).tolist())
    rows += [rows[5]] * 40 + [[0.0] * dim] * 3
    rows += [(2 * np.array(rows[5])).tolist()] * 5
    return [(n, n % 7, v) for n, v in enumerate(rows)]


@pytest.fixture(scope="module")
def laid_out(spark):
    rows = clustered()
    frame = spark.createDataFrame([*rows, (9001, 1, None), (9002, 1, [float("nan")] * 16), (9003, 2, [None] * 16)], "vec_id long, label int, embedding array<double>")
    folder = scratch.fresh(spark, "parts")
    parts.write_parts(frame.repartition(5), folder, pivots=10, file_rows=50)
    return rows, parts.Parts.read(spark, folder)


@pytest.mark.parametrize("limit", [1, 10, 60, 5000])
def test_search_equals_the_full_scan(spark, laid_out, limit):
    rows, found = laid_out
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for query in (rows[5][2], rows[300][2], (-np.array(rows[7][2])).tolist(), [0.0] * 16):
        got = parts.search_parts(found, query, limit).hits.collect()
        want = search.nearest(frame, query, limit).collect()
        assert [(r["vec_id"], round(r["score"], 9)) for r in got] == [(r["vec_id"], round(r["score"], 9)) for r in want]
        assert set(got[0].asDict()) == {"vec_id", "label", "score"}


def test_a_filter_of_the_source(spark, laid_out):
    rows, found = laid_out
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    from pyspark.sql import functions as F

    for label in (3, 99):
        got = parts.search_parts(found, rows[5][2], 9, F.col("label") == label).hits.collect()
        assert [r["vec_id"] for r in got] == [r["vec_id"] for r in search.nearest(frame, rows[5][2], 9, F.col("label") == label).collect()]


def test_clustered_vectors_are_read_in_part(laid_out):
    rows, found = laid_out
    got = parts.search_parts(found, rows[400][2], 10)
    assert got.all_rows == len(rows) and got.rows < 0.3 * got.all_rows and got.rings < 0.4 * got.all_rings
    filters = got.hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in filters and "pivot" in filters.split("PushedFilters")[1]


def test_many_queries_equal_the_full_scan(spark, laid_out):
    rows, found = laid_out
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    queries = frame.where("vec_id % 9 = 0 OR vec_id >= 755")
    for limit in (3, 50):
        got = parts.search_parts_each(found, queries, limit, scratch.written, most_queries=20).select("query_id", "rank", "score").collect()
        want = search.nearest_each(frame, queries, limit).select("query_id", "rank", "score").collect()
        of = lambda x: sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in x)
        assert of(got) == of(want)


def test_nothing_zeros_and_several_lengths(spark):
    schema = "vec_id long, label int, embedding array<double>"
    for rows in ([], [(1, 1, [0.0, 0.0]), (2, 1, [0.0, 0.0])]):
        folder = scratch.fresh(spark, "parts")
        frame = spark.createDataFrame(rows, schema)
        parts.write_parts(frame, folder)
        found = parts.Parts.read(spark, folder)
        assert [r["vec_id"] for r in parts.search_parts(found, [1.0, 0.0], 5).hits.collect()] == [r[0] for r in rows]
        assert parts.search_parts_each(found, frame, 5, scratch.written).count() == len(rows) ** 2
    with pytest.raises(ValueError, match="components"):
        parts.write_parts(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0, 2.0])], schema), scratch.fresh(spark, "parts"))
