"""A folder tree walked by tasks alone: a table of folders that are still to be listed, dealt anew in rounds.

A task lists folders until it has seen so many entries and gives back those that it didn't get to,
so a deep or lopsided subtree spreads over tasks from round to round, and a small tree takes one.
The driver lists nothing; it only counts folders that wait. Ignore rules go along with a folder,
so the files above it aren't read again. Tasks have to see the tree under the same path.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.jobs.scratch import written
from quarry.sources.ignore import parse
from quarry.sources.localtree import PARTS, SCHEMA, LocalTreeReader

#: Entries that a task lists before it gives back the folders that wait.
ENTRIES = 20_000
_WAITING = "folder string, rules string"


def _expand(options: dict[str, str], entries: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = LocalTreeReader(options)
        parsed: dict[tuple[str, str], tuple] = {}
        columns = [c.split()[0] for c in f"{SCHEMA}, {_WAITING}".split(", ")]
        left = entries
        for frame in frames:
            todo = deque(zip(frame["folder"], (json.loads(r) for r in frame["rules"]), strict=True))
            rows: list[tuple] = []
            while todo and left > 0:
                folder, above = todo.popleft()
                try:
                    above = [*above, [folder, (Path(tree.root) / folder / ".gitignore").read_text(errors="replace")]]
                except OSError:
                    pass
                rules = [parsed.setdefault((at, text), (at, parse(text))) if (at, text) not in parsed else parsed[at, text] for at, text in above]
                found = tree._entries(folder)
                left -= len(found) + 1
                for e, path in found:
                    if e.is_dir(follow_symlinks=False):
                        if tree._enters(e.name, path, rules):
                            todo.append((path, above))
                    elif file := tree._file(e, path, rules):
                        rows.append((*file, None, None))
            rows += [(None,) * 5 + (folder, json.dumps(rules)) for folder, rules in todo]
            yield pd.DataFrame(rows, columns=columns)

    return run


def walk(spark: SparkSession, path: str, exclude: list[str] | None = None, entries: int = ENTRIES, now: float | None = None) -> DataFrame:
    """The rows of localtree.scan, listed in rounds and written; entries of a task and round at most, but for a folder that alone has more."""
    options = {"path": path, "now": repr(time.time() if now is None else now)}
    if exclude is not None:
        options["excluded_json"] = json.dumps(exclude)
    LocalTreeReader(options)  # a root that isn't a folder is an error here
    waiting, n, rounds = spark.createDataFrame([("", "[]")], _WAITING), 1, []
    while n:
        dealt = waiting.repartition(min(n, PARTS * max(1, spark.sparkContext.defaultParallelism // PARTS)))
        rounds.append(written(dealt.mapInPandas(_expand(options, entries), f"{SCHEMA}, {_WAITING}"), "walk"))
        waiting = rounds[-1].where(F.col("folder").isNotNull()).select("folder", "rules")
        n = waiting.count()
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionAll(more)
    return found.where(F.col("folder").isNull()).drop("folder", "rules")
