"""Point look-ups: the rows of brute force, and row groups that aren't read."""

import pytest
from pyspark.sql import functions as F

from quarry.errors import InvalidArgument
from quarry.jobs import store
from quarry.operators import lookups


def _scanned(found):
    """Rows that come out of the scans of a plan, once it ran."""
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    if "Adaptive" in plan.getClass().getName():
        plan = plan.executedPlan()

    def below(node):
        own = [node.metrics().get("numOutputRows").get().value()] if "FileSourceScan" in node.getClass().getName() else []
        return sum((below(node.children().apply(k)) for k in range(node.children().size())), own)

    return sum(below(plan))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('lookups')}/t"
    rows = spark.range(60_000).select(F.sha1(F.col("id").cast("string")).alias("document_id"), F.when(F.col("id") % 1000 != 5, F.concat(F.lit("/r/"), F.sha1((F.col("id") % 50_000).cast("string")))).alias("uri"), (F.col("id") * 7919 % 60_013).alias("n"))
    lookups.written(rows, path, "document_id", ["uri", "n"], distinct=2000, row_group_bytes=1 << 17)
    return rows, path


@pytest.mark.parametrize("column", ["document_id", "uri", "n"])
def test_few_row_groups_are_read(spark, table, column):
    rows, path = table
    values = [r[0] for r in rows.where("n IN (3, 500, 40000)").select(column).collect()]
    found = lookups.rows(spark, path, column, values)
    want = rows.where(F.col(column).isin(values))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 3
    assert _scanned(lookups.rows(spark, path, column, values)) < 12_000  # of 60,000
    assert _scanned(lookups.rows(spark, path, column, values[:1] * 3)) < 6_000


def test_without_filters_all_is_read(spark, table, tmp_path):
    rows, _ = table
    lookups.written(rows, f"file://{tmp_path}/t", "document_id", [], row_group_bytes=1 << 17)
    assert _scanned(lookups.rows(spark, f"file://{tmp_path}/t", "uri", [rows.where("n = 3").first()["uri"]])) > 50_000


def test_values_from_a_table_few_or_many(spark, table):
    rows, path = table
    asked = rows.where("n < 300").select(F.col("uri").alias("asked"))
    asked = asked.unionByName(asked).unionByName(spark.createDataFrame([(None,), ("/none",)], "asked string"))
    want = rows.join(asked.select(F.col("asked").alias("uri")).distinct(), "uri", "left_semi").select(*rows.columns)
    for most, sent in ((1000, 0), (10, lookups.SENT_BYTES), (10, 0)):
        got = lookups.rows_of(spark, path, "uri", asked, most, sent).select(*rows.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert lookups.rows_of(spark, path, "uri", asked.limit(0)).count() == 0 and lookups.rows(spark, path, "uri", [None]).count() == 0
    assert lookups.rows(spark, path, "n", list(range(1000))).count() == rows.where("n < 1000").count()  # a thousand filters are still planned
    with pytest.raises(InvalidArgument):
        lookups.rows(spark, path, "n", list(range(1001)))
    with pytest.raises(InvalidArgument):
        lookups.written(rows, "unused", "document_id", ["url"])


def test_parts_of_an_index_are_sorted_by_document(spark, tmp_path):
    rows = spark.range(500).select(F.sha1(F.col("id").cast("string")).alias("document_id"), F.lit("s").alias("source_id"), F.lit(1).alias("bucket"), F.col("id").cast("string").alias("uri"))
    store.publish_parts(rows, f"file://{tmp_path}/t", [("s", 1)])
    got = store.read_parts(spark, f"file://{tmp_path}/t", "document_id string, source_id string, bucket int, uri string", "s")
    ids = [r["document_id"] for r in got.collect()]
    assert len(ids) == 500 and ids == sorted(ids)
