"""Greedy batches in order, without a task that sees all rows.

A batch takes rows until it holds `most`, or the next one would take it beyond `target` bytes; a
row of more than that is a batch alone. So where a batch ends depends on where it began, which is
a chain through all rows. It is cut into blocks of rows: a batch holds at most `most` rows, so a
chain can enter a block only at one of its first `most` rows. Each block says for each of them
where the chain leaves it and how many batches it began; these small tables are composed in
groups, level by level, and the entries are handed down again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.jobs.scratch import written
from quarry.operators import events

#: Documents and bytes of a batch. Fixed values.
MOST, TARGET = 128, 4 * 1024 * 1024
#: Rows of a block, and tables that are composed at once.
BLOCK, FAN = 65_536, 256


def _after(frame: pd.DataFrame, most: int, target: int) -> np.ndarray:
    """For each row (in order) the place of the row that begins the next batch, if a batch began here."""
    key, flush = frame["key"].to_numpy(), frame["flush"].to_numpy(dtype=bool)
    n = len(frame)
    new = np.ones(n + 1, dtype=bool)  # where no batch goes on
    new[1:n] = (key[1:] != key[:-1]) | flush[1:] | flush[:-1]
    at = np.arange(n)
    borders = np.flatnonzero(new)
    sums = np.concatenate([[0], np.cumsum(frame["size"].to_numpy(dtype=np.int64))])
    full = np.searchsorted(sums, sums[:-1] + target, side="right") - 1
    border = borders[np.searchsorted(borders, at, side="right")]
    return np.maximum(at + 1, np.minimum(np.minimum(full, at + most), border))


def _transfer(most: int, target: int, block: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq", ignore_index=True)
        home = int(frame["block"].iloc[0])
        after, own = _after(frame, most, target).tolist(), int(((frame["seq"] - 1) // block == home).sum())
        begins = (~frame["flush"].to_numpy(dtype=bool)).astype(int).tolist()
        leaves, counts = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            j = after[i]
            leaves[i], counts[i] = (j - own, begins[i]) if j >= own else (leaves[j], begins[i] + counts[j])
        # the last block may be shorter than a batch: beyond it there is nothing to enter
        pad = [0] * (most - own)
        return pd.DataFrame({"block": [home], "leaves": [[*leaves[:most], *pad]], "counts": [[*counts[:most], *pad]]})

    return run


def _composed(fan: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        at, count = np.arange(len(frame["leaves"].iloc[0])), 0
        for leaves, counts in zip(frame["leaves"], frame["counts"], strict=True):
            at, count = np.asarray(leaves)[at], count + np.asarray(counts)[at]
        return pd.DataFrame({"block": [frame["block"].iloc[0] // fan], "leaves": [at.tolist()], "counts": [count.tolist()]})

    return run


def _handed_down(above: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
    at, number = int(above["entry"].iloc[0]), int(above["before"].iloc[0])
    rows = []
    below = below.sort_values("block")
    for block, leaves, counts in zip(below["block"], below["leaves"], below["counts"], strict=True):
        rows.append((block, at, number))
        at, number = int(leaves[at]), number + int(counts[at])
    return pd.DataFrame(rows, columns=["block", "entry", "before"])


def _assigned(most: int, target: int, block: int):
    def run(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq", ignore_index=True)
        home = int(frame["block"].iloc[0])
        after, n = _after(frame, most, target), len(frame)
        flush = frame["flush"].to_numpy(dtype=bool)
        begins = np.zeros(n, dtype=np.int64)
        i = int(entry["entry"].iloc[0])
        while i < n:
            begins[i] = not flush[i]
            i = int(after[i])
        number = int(entry["before"].iloc[0]) + np.cumsum(begins)
        # what comes before the entry belongs to a batch of the block before, the rest of the next block to that
        keep = ~flush & ((frame["seq"].to_numpy() - 1) // block == home)
        return pd.DataFrame({"seq": frame["seq"][keep], "batch": number[keep]})

    return run


def batched(rows: DataFrame, key: str, order: list[str], size: str, flush: str | None = None, most: int = MOST, target: int = TARGET, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """rows with batch, numbered from 1 in the order of key and order.

    A batch is of one key. A row whose flush is true (a deletion, say) ends the batch before it and is
    left out. Order has to tell a key's rows apart. A size that is null is 0, a flush that is null false.
    """
    block = max(block, most)
    placed = written(events.numbered(rows, [key, *order], "__seq"), "batching")
    sized = placed.select(F.col("__seq").alias("seq"), F.to_json(F.struct(F.col(key).alias("k"))).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), (F.coalesce(F.col(flush), F.lit(False)) if flush else F.lit(False)).alias("flush"))
    home = F.floor((F.col("seq") - 1) / block)
    near = F.when((home > 0) & ((F.col("seq") - 1) % block < most), F.array(home, home - 1)).otherwise(F.array(home))  # a batch may end among the first rows of the next block
    shared = sized.withColumn("block", F.explode(near))
    table = "block long, leaves array<long>, counts array<long>"
    levels = [written(shared.groupBy("block").applyInPandas(_transfer(most, target, block), table), "batch-level")]
    blocks = -(-placed.count() // block)
    while blocks > fan:
        levels.append(written(levels[-1].groupBy(F.floor(F.col("block") / fan)).applyInPandas(_composed(fan), table), "batch-level"))
        blocks = -(-blocks // fan)
    entries = rows.sparkSession.createDataFrame([(0, 0, 0)], "block long, entry long, before long")
    for level in reversed(levels):
        entries = entries.groupBy("block").cogroup(level.groupBy(F.floor(F.col("block") / fan))).applyInPandas(_handed_down, "block long, entry long, before long")
    found = shared.groupBy("block").cogroup(entries.groupBy("block")).applyInPandas(_assigned(most, target, block), "seq long, batch long")
    return placed.join(found.withColumnRenamed("seq", "__seq"), "__seq").drop("__seq")
