"""URL filters by a sort-merge range join.

A host written label by label from the right, each label followed by a dot, turns
"this host and all its subdomains" into one interval of keys: net -> ["net.", "net/").
Intervals of two hosts are disjoint or nested. URLs are cut into key ranges of bounded
size, every rule goes to the ranges that its interval meets, and each range is swept
once in key order while a stack holds the rules whose intervals are open.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import about, ascii_lower

#: URLs that one task sweeps at once, about.
ROWS_A_RANGE = 100_000


def host_and_path(url):
    """(host, path) columns: host after the first ://, A-Z lower-cased; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host):
    """example.net -> net.example. ; keys of subdomains start with the key of their domain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(urls: pa.Table, rules: pa.Table) -> pa.Table:
    """One pass over URLs and rules of a range, both in key order."""
    keys = urls.column("key").to_pylist()
    paths = urls.column("path").to_pylist()
    opened = sorted(zip(rules.column("key").to_pylist(), rules.column("prefix").to_pylist(), rules.column("rule").to_pylist(), rules.column("verdict").to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    found: list[str | None] = [None] * len(keys)
    said: list[str | None] = [None] * len(keys)
    stack: list[tuple[str, str, str, str]] = []
    nxt = 0
    for i in order:
        key, path = keys[i], paths[i]
        while nxt < len(opened) and opened[nxt][0] <= key:
            while stack and not opened[nxt][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(opened[nxt])
            nxt += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for rule in stack:  # all that are open fit the host; the longest whose path fits wins
            if path.startswith(rule[1]) and (best is None or (len(rule[2]), rule[2]) > (len(best[2]), best[2])):
                best = rule
        if best is not None:
            found[i], said[i] = best[2], best[3]
    return urls.drop_columns(["range", "key"]).append_column("rule", pa.array(found, pa.string())).append_column("verdict", pa.array(said, pa.string()))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Judge every URL by the longest rule that fits its host (or a parent domain) and starts its path.

    rules has host, prefix (of the path, with its slash) and verdict. Returns id_col, host,
    path, rule (host + prefix, null where none fits) and verdict (default where none fits),
    one row per input row. A null URL, or one without ://, has an empty host and path and so
    fits no rule; repeated rows are judged each on its own; an empty table gives an empty
    result; other columns are ignored whatever their names. Between rules of equal length
    the later in code-point order wins. Rules with an empty host are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    spots = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        host_key(ascii_lower(F.col("host"))).alias("key"), F.col("prefix"), F.concat(ascii_lower(F.col("host")), F.col("prefix")).alias("rule"), F.col("verdict")
    )
    rows = pages.count()
    ranges = max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_range))
    # Range borders: a repeatable selection of keys by hash, a few for each range, as any range partitioning takes.
    wanted = max(4 * ranges, min(32 * ranges, 50_000))
    seen = sorted(r[0] for r in about(urls, 2 * wanted, rows, id_col, "key").select("key").limit(4 * wanted).collect())
    borders = [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            low = np.array([bisect.bisect_left(borders, k) for k in keys], dtype=np.int64)
            high = np.array([bisect.bisect_right(borders, k) for k in keys], dtype=np.int64)
            turn = np.arange(len(keys), dtype=np.int64)  # a key that fills several ranges is spread over them
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low + turn % (high - low + 1))], names=[*batch.schema.names, "range"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans = [(bisect.bisect_left(borders, k), bisect.bisect_right(borders, k[:-1] + "/")) for k in keys]
            take = np.repeat(np.arange(len(keys)), [b - a + 1 for a, b in spans])
            at = np.concatenate([np.arange(a, b + 1) for a, b in spans]) if spans else np.zeros(0, dtype=np.int64)
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at.astype(np.int64))], names=[*batch.schema.names, "range"])

    id_type = dict(pages.dtypes)[id_col]
    dealt = urls.mapInArrow(deal, f"`{id_col}` {id_type}, host string, path string, key string, range long")
    met = spots.mapInArrow(reach, "key string, prefix string, rule string, verdict string, range long")
    swept = dealt.groupBy("range").cogroup(met.groupBy("range")).applyInArrow(_sweep, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
