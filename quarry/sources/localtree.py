"""A folder tree as a Spark data source: one row a file that can be indexed, without its content.

Spark's own file sources leave out names that begin with an underscore or a dot and keep only
milliseconds, so the walk is its own. Folders are divided level by level until there are enough
of them for tasks; content is read later, only of the files that reconciliation asks for.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.errors import InvalidArgument
from quarry.sources.ignore import ignored, parse

SCHEMA = "uri string, mime_type string, content_hash string, fingerprint string, display_path string"
#: Folders that are never entered unless the option exclude says otherwise. Fixed values.
EXCLUDED = ("node_modules", "vendor", "target", "__pycache__")
#: Files changed within so many seconds before the scan are hashed: their time says little.
RACY_S = 2.0
#: MIME types by extension. Fixed values.
BY_EXTENSION = {
    ".txt": "text/plain", ".text": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown",
    ".go": "text/x-go", ".rs": "text/x-rust", ".lua": "text/x-lua", ".nix": "text/x-nix",
    ".py": "text/x-python", ".pyi": "text/x-python", ".js": "text/javascript", ".mjs": "text/javascript",
    ".cjs": "text/javascript", ".jsx": "text/jsx", ".ts": "text/typescript", ".mts": "text/typescript",
    ".cts": "text/typescript", ".tsx": "text/tsx", ".java": "text/x-java-source", ".kt": "text/x-kotlin",
    ".kts": "text/x-kotlin", ".c": "text/x-c", ".h": "text/x-c", ".cc": "text/x-c++",
    ".cpp": "text/x-c++", ".cxx": "text/x-c++", ".hh": "text/x-c++", ".hpp": "text/x-c++",
    ".hxx": "text/x-c++", ".cs": "text/x-csharp", ".rb": "text/x-ruby", ".php": "text/x-php",
    ".swift": "text/x-swift", ".scala": "text/x-scala", ".sc": "text/x-scala", ".sh": "text/x-shellscript",
    ".bash": "text/x-shellscript", ".zsh": "text/x-shellscript", ".fish": "text/x-shellscript", ".sql": "text/x-sql",
    ".yaml": "text/yaml", ".yml": "text/yaml", ".toml": "text/x-toml", ".json": "text/json",
    ".jsonc": "text/json", ".html": "text/html", ".htm": "text/html", ".css": "text/css",
    ".scss": "text/x-scss", ".sass": "text/x-sass", ".less": "text/x-less", ".proto": "text/x-protobuf",
    ".xml": "text/xml", ".svg": "text/xml",
}
#: Folders that a walk is divided into at least, where there are so many.
PARTS = 64
_LOG = logging.getLogger(__name__)


def mime_of(name: str) -> str | None:
    dot = name.rfind(".")
    return BY_EXTENSION.get(name[dot:].lower()) if dot >= 0 else None


def canonical(path: str) -> str:
    """Absolute path without links; a missing folder, a file or a web address is an error."""
    if path.startswith(("http://", "https://")):
        raise NotImplementedError("web addresses are no source yet")
    real = os.path.realpath(os.path.expanduser(path))
    if not os.path.isdir(real):
        raise FileNotFoundError(f"no such directory: {path}")
    return real


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class LocalTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = canonical(options["path"])
        self.now = float(options.get("now", time.time()))
        given = options.get("exclude")
        listed = options.get("excluded_json")  # as JSON, for names with commas
        names = json.loads(listed) if listed else EXCLUDED if given is None else given.split(",")
        self.excluded = {x.strip() for x in names if x.strip()}

    def partitions(self) -> list[InputPartition]:
        shallow, deep = [""], self._below("")
        while deep and len(deep) < PARTS:  # one level further: a folder's own files, and its folders
            below = [(f, self._below(f)) for f in deep]
            if not any(b for _, b in below):
                break
            shallow += [f for f, _ in below]
            deep = [x for _, b in below for x in b]
        return [*[_Part(f, False) for f in shallow], *[_Part(f, True) for f in deep]]

    def _below(self, folder: str) -> list[str]:
        rules = self._rules(folder)
        return [path for e, path in self._entries(folder) if e.is_dir(follow_symlinks=False) and self._enters(e.name, path, rules)]

    def _entries(self, folder: str) -> list[tuple[os.DirEntry, str]]:
        try:
            return [(e, f"{folder}/{e.name}" if folder else e.name) for e in sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)]
        except OSError as e:
            _LOG.warning("skipped %s: %s", os.path.join(self.root, folder), e.strerror)
            return []

    def _rules(self, folder: str) -> list:
        found = []
        parts = folder.split("/") if folder else []
        for n in range(len(parts) + 1):
            at = "/".join(parts[:n])
            try:
                found.append((at, parse((Path(self.root) / at / ".gitignore").read_text(errors="replace"))))
            except OSError:
                continue
        return found

    def _enters(self, name: str, path: str, rules: list) -> bool:
        return not name.startswith(".") and name not in self.excluded and not ignored(rules, path, True)

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self._walk(partition.folder, partition.deep)

    def _walk(self, folder: str, deep: bool) -> Iterator[tuple]:
        rules = self._rules(folder)
        for e, path in self._entries(folder):
            if e.is_dir(follow_symlinks=False):
                if deep and self._enters(e.name, path, rules):
                    yield from self._walk(path, True)
            elif found := self._file(e, path, rules):
                yield found

    def _wanted(self, e: os.DirEntry, path: str, rules: list) -> bool:
        return mime_of(e.name) is not None and (e.is_file(follow_symlinks=False) or e.is_symlink()) and not ignored(rules, path, False)

    def _file(self, e: os.DirEntry, path: str, rules: list) -> tuple | None:
        if not self._wanted(e, path, rules):
            return None
        try:
            stat = e.stat(follow_symlinks=False)
            digest = hashlib.sha256(Path(e.path).read_bytes()).hexdigest() if self.now - stat.st_mtime_ns / 1e9 < RACY_S else ""
        except OSError:
            return None
        return e.path, mime_of(e.name), digest, f"{stat.st_size}:{stat.st_mtime_ns}", path


class LocalTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "localtree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LocalTreeReader(dict(self.options))


def scan(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """All files under path that can be indexed; exclude replaces the folders that are never entered."""
    spark.dataSource.register(LocalTree)
    reader = spark.read.format("localtree").option("now", repr(time.time()))
    if exclude is not None:
        reader = reader.option("excluded_json", json.dumps(exclude))
    return reader.load(path)


#: Scans by the type that the catalog remembers of a source.
TYPES = {"local_dir": scan}


def from_catalog(spark: SparkSession, source_type: str, uri: str) -> DataFrame:
    """The scan of a source that the catalog knows by its type and uri; a type that nothing was registered for is an error."""
    if source_type not in TYPES:
        raise InvalidArgument(f"unknown source type {source_type!r}")
    return TYPES[source_type](spark, uri)
