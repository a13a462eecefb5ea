"""Directory listings as a table: a Python data source, since Spark's own file index drops hidden names and nanoseconds.

The walk is depth-first in the order of names, follows no links and keeps supported files. Each first-level entry of
the root is a partition, so that large trees are walked in parallel.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import SUPPORTED
from ..model import LISTING


def supported(name: str) -> bool:
    return "." in name and name.rsplit(".", 1)[1].lower() in SUPPORTED


def walk(root: str, below: str = "") -> Iterator[tuple[str, int, int, str | None]]:
    """(rel_path, byte_size, mtime_ns, error) of the supported files under root/below; unreadable entries come as errors."""
    here = os.path.join(root, below) if below else root
    try:
        names = sorted(os.listdir(os.fsencode(here)))
    except OSError as e:
        yield below, 0, 0, e.strerror or str(e)
        return
    for raw in names:
        try:
            name = raw.decode()
        except UnicodeDecodeError:
            yield f"{below}/{os.fsdecode(raw)!a}".lstrip("/"), 0, 0, "name is not UTF-8"
            continue
        yield from entry(root, f"{below}/{name}" if below else name)


def entry(root: str, rel: str) -> Iterator[tuple[str, int, int, str | None]]:
    try:
        found = os.lstat(os.path.join(root, rel))
    except OSError as e:
        yield rel, 0, 0, e.strerror or str(e)
        return
    kind = found.st_mode & 0o170000
    if kind == 0o040000:
        yield from walk(root, rel)
    elif kind == 0o100000 and supported(rel.rsplit("/", 1)[-1]):
        yield rel, found.st_size, found.st_mtime_ns, None


class _Part(InputPartition):
    def __init__(self, names: list[str] | None) -> None:
        super().__init__(names)
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, root: str, parts: int) -> None:
        self.root, self.parts = root, parts

    def partitions(self) -> list[_Part]:
        try:
            names = sorted(x.decode() for x in os.listdir(os.fsencode(self.root)) if _decodes(x))
            odd = sum(not _decodes(x) for x in os.listdir(os.fsencode(self.root)))
        except OSError:
            return [_Part(None)]
        if odd or not names:
            return [_Part(None)]
        size = -(-len(names) // max(1, self.parts))
        return [_Part(names[k : k + size]) for k in range(0, len(names), size)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.names is None:
            yield from walk(self.root)
        else:
            for name in partition.names:
                yield from entry(self.root, name)


def _decodes(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


class ListingSource(DataSource):
    """spark.read.format("listing").option("parts", 8).load(root)"""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("parts", "8")))


def listing(spark: SparkSession, root: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").option("parts", parts).load(os.path.abspath(root))


def expand(paths: list[str]) -> list[tuple[str, str]]:
    """(path, shown name) for streaming: files as given, even unsupported ones, and the supported files of directories."""
    out = []
    for p in paths:
        if os.path.isdir(p):
            out += [(os.path.join(p, rel), rel.rsplit("/", 1)[-1]) for rel, _, _, error in walk(p) if error is None]
        else:
            out.append((p, os.path.basename(p)))
    return out
