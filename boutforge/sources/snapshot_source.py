"""A data source for snapshots that others publish: JSON lines, fetched at most once in a while, filtered while read.

    snapshot_source.register(spark)
    spark.read.format("snapshot").schema("title string, at long").option("path", uri).load()

* ``path``: an http(s) address of one file, or a file or folder in any store that pyarrow opens.
* ``ttl`` and ``cache``: a file's copy in the cache folder serves all reads for so many seconds.
* ``mode``: ``empty`` reads a snapshot that is missing or cannot be fetched as an empty table and leaves broken
  lines out; ``strict`` fails on either, so that a failure is not taken for an empty snapshot.
* ``split``: bytes of a partition; files are cut at line ends.

Comparisons, null tests and tests of a text's beginning, end or content are pushed into the scan and decided
on Arrow columns, before a row reaches Spark. Of the columns only those of the schema are parsed.
"""

from __future__ import annotations

import dataclasses
import hashlib
import io
import json
import time
import urllib.request
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, json as arrow_json
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK = 4 << 20  # bytes that are parsed together
TESTS = {
    EqualTo: lambda c, v: pc.equal(c, v),
    GreaterThan: lambda c, v: pc.greater(c, v),
    GreaterThanOrEqual: lambda c, v: pc.greater_equal(c, v),
    LessThan: lambda c, v: pc.less(c, v),
    LessThanOrEqual: lambda c, v: pc.less_equal(c, v),
    StringContains: lambda c, v: pc.match_substring(c, v),
    StringStartsWith: lambda c, v: pc.starts_with(c, v),
    StringEndsWith: lambda c, v: pc.ends_with(c, v),
}


@dataclasses.dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file."""

    uri: str
    start: int
    end: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _fetched(uri: str) -> bytes:
    if uri.startswith(("http://", "https://")):
        with urllib.request.urlopen(uri, timeout=30) as answer:  # noqa: S310
            return answer.read()
    store, path = _open(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def cached(uri: str, cache: str, ttl: float, now: float) -> str:
    """The copy of a file that is younger than ttl, made now if there is none; a copy is complete when it has its name."""
    store, folder = _open(cache)
    store.create_dir(folder, recursive=True)
    name = hashlib.sha256(uri.encode()).hexdigest()[:24]
    found = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith(f"{name}-") and f.base_name.endswith(".json")]
    at = lambda path: int(path.rsplit("-", 1)[1].removesuffix(".json")) / 1000
    young = [p for p in found if at(p) > now - ttl]
    path = max(young, key=at) if young else f"{folder}/{name}-{int(now * 1000)}.json"
    if not young:
        body = _fetched(uri)
        with store.open_output_stream(f"{path}.part") as f:
            f.write(body)
        store.move(f"{path}.part", path)
    return cache.rstrip("/") + "/" + path.rsplit("/", 1)[1]


class SnapshotReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = to_arrow_schema(schema), options
        self.strict = options.get("mode", "empty") == "strict"
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.schema.names and type(f) in TESTS:
                self.tests.append((type(f), column, f.value))
            elif column in self.schema.names and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((type(f), column, None))
            elif column in self.schema.names and isinstance(f, In):
                self.tests.append((In, column, list(f.value)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        uri, split = self.options["path"], int(self.options.get("split", 32 << 20))
        try:
            if "cache" in self.options:
                uri = cached(uri, self.options["cache"], float(self.options.get("ttl", 3600)), time.time())
            store, path = _open(uri)
            info = store.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(uri)
            files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        except Exception:
            if self.strict:
                raise
            return []
        prefix = uri[: len(uri) - len(path)]
        return [Range(prefix + f.path, a, min(f.size, a + split)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, split)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, path = _open(part.uri)
        with io.BufferedReader(store.open_input_file(path), 1 << 16) as f:
            f.seek(max(0, part.start - 1))
            if part.start:
                f.readline()  # the line that begins before
            while f.tell() < part.end:
                block = f.read(min(BLOCK, part.end - f.tell()))
                if not block.endswith(b"\n"):
                    block += f.readline()
                for batch in self._parsed(block).to_batches():
                    if batch.num_rows:
                        yield batch

    def _parsed(self, block: bytes) -> pa.Table:
        how = arrow_json.ParseOptions(explicit_schema=self.schema, unexpected_field_behavior="ignore")
        try:
            table = arrow_json.read_json(io.BytesIO(block), parse_options=how, read_options=arrow_json.ReadOptions(block_size=max(1, len(block) + 1))) if block.strip() else self.schema.empty_table()
        except pa.ArrowInvalid:
            if self.strict:
                raise
            good = []
            for line in block.splitlines():
                try:
                    if isinstance(row := json.loads(line), dict):
                        good.append(pa.Table.from_pylist([{n: row.get(n) for n in self.schema.names}], self.schema))
                except (ValueError, pa.ArrowInvalid, pa.ArrowTypeError):
                    continue
            table = pa.concat_tables([self.schema.empty_table(), *good])
        keep = None
        for kind, column, value in self.tests:
            c = table.column(column)
            if kind is IsNull:
                one = pc.is_null(c)
            elif kind is IsNotNull:
                one = pc.is_valid(c)
            elif kind is In:
                one = pc.and_(pc.is_valid(c), pc.is_in(c, pa.array(value, c.type)))
            else:
                one = TESTS[kind](c, value if kind in (StringContains, StringStartsWith, StringEndsWith) else pa.scalar(value, c.type))
            keep = one if keep is None else pc.and_(keep, one)
        return table if keep is None else table.filter(keep)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def reader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
