"""Point look-ups in tables on Parquet: rows by exact values of columns that the table isn't laid out by.

`written` sorts rows by the first key, so that its minima and maxima tell row groups apart, and gives the
other keys Bloom filters, which tell them apart where values lie scattered. `rows` asks with filters
that the reader answers from both, so that what it reads is what may hold the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from quarry.errors import InvalidArgument

#: Bytes of a row group, chance that a Bloom filter passes a value that isn't there, values that are asked as a filter at most.
ROW_GROUP_BYTES, FALSE_HITS, FILTERED = 8 << 20, 0.01, 1000
#: Bytes of values, with 16 more for each, up to which they are sent to all executors.
SENT_BYTES = 64 << 20


def written(df: DataFrame, path: str, sorted_by: str, blooms: list[str], distinct: int = 100_000, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write df for look-ups by sorted_by and by blooms; distinct is how many values of a row group its filters are made for."""
    known = dict(df.dtypes)
    for c in [sorted_by, *blooms]:
        if c not in known:
            raise InvalidArgument(f"no column {c!r} to look up by")
    writer = df.repartitionByRange(sorted_by).sortWithinPartitions(sorted_by).write.option("parquet.block.size", row_group_bytes)
    for c in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", distinct).option(f"parquet.bloom.filter.fpp#{c}", FALSE_HITS)
    writer.parquet(path)


def rows(spark: SparkSession, path: str, column: str, values: list, filtered: int = FILTERED) -> DataFrame:
    """The rows whose column is one of values; nulls among values ask for nothing.

    Spark turns an IN of more than parquet.filter.inFilterThreshold values into a range, which Bloom filters
    can't answer, so up to filtered values are asked one filter each, joined by OR.
    """
    table = spark.read.parquet(path)
    asked = list(dict.fromkeys(v for v in values if v is not None))
    if len(asked) > filtered:
        raise InvalidArgument(f"more than {filtered} values; give them as a table to rows_of")
    if not asked:
        return table.limit(0)
    if not isinstance(table.schema[column].dataType, (StringType, IntegerType, LongType)):
        raise InvalidArgument("look-ups are by texts and whole numbers")
    return table.where(_any([F.col(column) == F.lit(v) for v in asked]))


def _any(tests: list):
    """OR of all, as a balanced tree: a chain of a thousand is too deep for the optimizer."""
    while len(tests) > 1:
        tests = [tests[k] | tests[k + 1] if k + 1 < len(tests) else tests[k] for k in range(0, len(tests), 2)]
    return tests[0]


def rows_of(spark: SparkSession, path: str, column: str, asked: DataFrame, filtered: int = FILTERED, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows whose column is among the values of asked's first column: as filters if there are few, else by a semi join.

    No more than filtered values, and one to tell that there are more, are collected. The values of the join are
    measured: up to sent_bytes they are broadcast, so that the table isn't shuffled, beyond that both sides are.
    """
    values = asked.select(F.col(asked.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct()
    few = [r[0] for r in values.limit(filtered + 1).collect()]
    if len(few) <= filtered:
        return rows(spark, path, column, few, filtered)
    size = values.agg(F.sum(F.octet_length(F.col(column).cast("string")) + 16)).first()[0]
    return spark.read.parquet(path).join(F.broadcast(values) if size <= sent_bytes else values, column, "left_semi")


