"""Saved search results as a data source of Spark, for tables and streams, with filters pushed into it.

Result pages are JSON objects, one a line: query, engine, region, and hits in `organic` or `results`. A path may
be a file or a folder; below a folder, `engine=...` or `region=...` in a file's path says what it holds, and a file
that a pushed filter rules out is not opened. Files are opened by pyarrow's file systems (local, hdfs, s3, gs), in the workers;
for stores that only Spark opens there are snapshot.search_results() and search_stream(), which return the same rows.

Defined results: hits without a URL go; a missing title or snippet is empty, a snippet has 300 characters; broken
lines are left out; filters compare as SQL does, so a NULL equals nothing.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "query string, engine string, region string, ord int, title string, url string, snippet string"
#: Columns that are constant on a result page, so that whole pages are passed over.
PAGE_COLUMNS = ("query", "engine", "region")


@dataclass
class SearchFile(InputPartition):
    """A file to read, and what it may hold: column -> values."""

    path: str
    wanted: dict[str, list[str]]


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(paths: Iterable[str]) -> list[str]:
    """The files at or below the paths, in the order of their names; hidden ones are none."""
    from pyarrow import fs

    out = []
    for path in paths:
        system, where = _opened(path)
        head = path[: len(path) - len(where)] if path.endswith(where) else ""
        info = system.get_file_info(where)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(where, recursive=True)) if f.type == fs.FileType.File]
            out += [head + f for f in found if not posixpath.basename(f).startswith(("_", "."))]
        elif info.type == fs.FileType.File:
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return sorted(out)


def _of_path(path: str) -> dict[str, str]:
    parts = (p.partition("=") for p in path.split("/"))
    return {name: unquote(value) for name, eq, value in parts if eq and name in PAGE_COLUMNS}


def _rows(file: SearchFile) -> Iterator[tuple]:
    system, where = _opened(file.path)
    held = _of_path(file.path)
    with system.open_input_stream(where) as f:
        for line in _lines(f):
            try:
                page = json.loads(line)
            except ValueError:
                continue
            if not isinstance(page, dict):
                continue
            own = {c: page.get(c, held.get(c)) for c in PAGE_COLUMNS}
            if any(own[c] not in values for c, values in file.wanted.items()):
                continue
            for k, hit in enumerate(page.get("organic") or page.get("results") or []):
                if hit.get("url"):
                    yield (*own.values(), k, hit.get("title") or "", hit["url"], (hit.get("snippet") or "")[:300])


def _lines(f) -> Iterator[bytes]:
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class SearchReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.wanted: dict[str, list[str]] = {}

    def partitions(self) -> Sequence[InputPartition]:
        held = [SearchFile(p, self.wanted) for p in files(self.paths) if all(_of_path(p).get(c, v[0] if v else None) in v for c, v in self.wanted.items())]
        return held or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition) if isinstance(partition, SearchFile) else iter(())


class FilteringReader(SearchReader):
    """Filters on query, engine and region are the reader's own."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in PAGE_COLUMNS:
                yield f
                continue
            values = [v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None]
            self.wanted[name] = [v for v in values if v in self.wanted.get(name, values)]


class SearchStreamReader(DataSourceStreamReader):
    """New files in the order of their names; an offset is the last name that was read."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.after = ""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        new = [p for p in files(self.paths) if p > self.after]
        if new:
            self.after = new[-1]
        return {"after": self.after}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.after = max(self.after, end["after"])
        return [SearchFile(p, {}) for p in files(self.paths) if start["after"] < p <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition)


class SearchSource(DataSource):
    """spark.read or spark.readStream .format("expodex_search"); options: path or paths.

    A batch of a stream has all files that are new. It expects the names of new files to sort after those of older ones.
    """

    @classmethod
    def name(cls) -> str:
        return "expodex_search"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SearchReader(self._options())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return SearchStreamReader(self._options())


class FilteringSource(SearchSource):
    """The same with filters pushed into it, which a session must allow."""

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FilteringReader(self._options())


def registered(spark) -> None:
    """Make the source known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilteringSource)
