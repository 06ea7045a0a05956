"""Changes of a folder tree as a stream of hints: each only says that a scan is due, and below which folder.

A watcher keeps what it saw of each folder between triggers, as a tree of digests. A trigger looks
at the times of folders and files that it knows and lists only folders whose own time moved, and
those below an ignore file that changed. However many files changed, it gives at most one hint,
which names the lowest folder above all that moved.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.ignore import parse
from quarry.sources.localtree import RACY_S, LocalTreeReader

SCHEMA = "root string, folder string, digest string"
IGNORE, GONE = ".gitignore", "gone"


@dataclass
class _Folder:
    """What was seen of a folder: its time, the rules that it was listed under, its files and folders, and the digest of all below it."""

    listed_ns: int = -1
    rules: str = ""
    files: list[str] = field(default_factory=list)
    below: dict[str, _Folder] = field(default_factory=dict)
    own: str = ""
    digest: str = ""


def _stamp(path: str) -> str | None:
    try:
        stat = os.lstat(path)
    except OSError:
        return None
    return f"{stat.st_size}:{stat.st_mtime_ns}"


def _moved(before: _Folder, now: _Folder) -> str:
    """The lowest folder above all that differs."""
    path = ""
    while before.own == now.own and before.below.keys() == now.below.keys():
        names = [n for n in now.below if before.below[n].digest != now.below[n].digest]
        if len(names) != 1:
            break
        path = f"{path}/{names[0]}" if path else names[0]
        before, now = before.below[names[0]], now.below[names[0]]
    return path


class Watcher(SimpleDataSourceStreamReader):
    """entered counts the folders that were listed so far. A watcher that starts anew lists all of them once."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.root = options["path"]
        self.seen: _Folder | None = None
        self.entered = 0

    def look(self) -> _Folder | None:
        """The tree as it is now; none once the root is gone."""
        try:
            reader = LocalTreeReader(self.options)
        except OSError:
            return None
        return self._look(reader, "", self.seen or _Folder(), [], "")

    def _look(self, reader: LocalTreeReader, folder: str, before: _Folder, rules: list, above: str) -> _Folder:
        at = os.path.join(reader.root, folder)
        ignore = _stamp(os.path.join(at, IGNORE))
        if ignore is not None:
            above = f"{above}\0{folder}\0{ignore}"
            try:
                with open(os.path.join(at, IGNORE), errors="replace") as f:
                    rules = [*rules, (folder, parse(f.read()))]
            except OSError:
                pass
        try:
            listed_ns = os.stat(at).st_mtime_ns
        except OSError:
            return _Folder()
        if listed_ns == before.listed_ns and above == before.rules:
            now = _Folder(listed_ns, above, before.files, dict.fromkeys(before.below))
        else:
            self.entered += 1
            fresh = reader.now - listed_ns / 1e9 < RACY_S  # more may come within the same tick, so it is listed again next time
            now = _Folder(-1 if fresh else listed_ns, above)
            for e, path in reader._entries(folder):
                if e.is_dir(follow_symlinks=False):
                    if reader._enters(e.name, path, rules):
                        now.below[e.name] = None
                elif reader._wanted(e, path, rules):
                    now.files.append(e.name)
        own, whole = hashlib.sha256(f"{ignore}\n".encode()), hashlib.sha256()
        for name in now.files:
            own.update(f"{name}\0{_stamp(os.path.join(at, name))}\n".encode("utf-8", "surrogateescape"))
        now.own = own.hexdigest()
        for name in now.below:
            now.below[name] = self._look(reader, f"{folder}/{name}" if folder else name, before.below.get(name) or _Folder(), rules, above)
            whole.update(f"{name}\0{now.below[name].digest}\n".encode("utf-8", "surrogateescape"))
        now.digest = hashlib.sha256(f"{now.own}{whole.hexdigest()}".encode()).hexdigest()
        return now

    def initialOffset(self) -> dict:
        return {"digest": "start", "folder": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.look()
        digest = now.digest if now else GONE
        if digest == start["digest"]:
            end = start
        else:
            known = now and self.seen and self.seen.digest == start["digest"]
            end = {"digest": digest, "folder": _moved(self.seen, now) if known else ""}
        self.seen = now
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([] if start["digest"] == end["digest"] else [(self.root, end["folder"], end["digest"])])


class TreeWatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treewatch"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return Watcher(dict(self.options))


def hints(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """A stream of hints, the first at once: a source that begins to be watched is due.

    A root that goes gives one hint with the digest "gone", and one when it is back.
    """
    spark.dataSource.register(TreeWatch)
    reader = spark.readStream.format("treewatch").option("path", path)
    if exclude is not None:
        reader = reader.option("excluded_json", json.dumps(exclude))
    return reader.load()


def on_hints(watched: DataFrame, scan, checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """Run scan(root) for each batch that has a hint, but for roots that are gone. Looking every so often is also what is left where nothing reports changes."""

    def due(batch: DataFrame, _: int) -> None:
        for r in batch.where(F.col("digest") != GONE).select("root").distinct().collect():  # one row a watched root
            scan(r["root"])

    return watched.writeStream.foreachBatch(due).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
