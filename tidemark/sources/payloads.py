"""A Python data source for delta-coded payloads: gzip files of JSON lines, one folder a date.

`spark.read.format("delta_payloads").load(path)` gives (date, minute, value). Files are `<path>/date=YYYY-MM-DD/*.json.gz`;
a line holds start, multiplier, times and values, as encode_delta() makes them. Each file is an input partition; filters on
date (with spark.sql.python.filterPushdown.enabled) choose files before any is opened. readStream gives files as they
come, in order of modification time and name. A file is decoded line by line; arrays of unequal length fail.
"""

from __future__ import annotations

import datetime
import gzip
import json
import operator
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import encode_delta

FORMAT = "delta_payloads"
_DATE = re.compile(r"/date=(\d{4}-\d\d-\d\d)/[^/]+\.json\.gz$")
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_ROWS = pa.schema([("date", pa.date32()), ("minute", pa.int64()), ("value", pa.float64())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; Hadoop writes file:/a for file:///a."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class PayloadFile(InputPartition):
    def __init__(self, root: str, path: str, date: datetime.date, mtime: int):
        super().__init__(path)
        self.root, self.path, self.date, self.mtime = root, path, date, mtime


def payload_files(root: str) -> list[PayloadFile]:
    system, path = opened(root)
    found = [(f, _DATE.search(f.path)) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
    return sorted((PayloadFile(root, f.path, datetime.date.fromisoformat(m[1]), f.mtime_ns or 0) for f, m in found if m), key=lambda p: (p.mtime, p.path))


def _decoded(part: PayloadFile) -> Iterator[pa.RecordBatch]:
    system, _ = opened(part.root)
    with system.open_input_stream(part.path, compression=None) as raw, gzip.open(raw, "rt", encoding="utf-8") as lines:
        for line in lines:
            row = json.loads(line)
            if len(row["times"]) != len(row["values"]):
                raise ValueError(f"arrays of unequal length in {part.path}")
            minute, units, minutes, values = row["start"], 0, [], []
            for step, change in zip(row["times"], row["values"]):
                minute, units = minute + step, units + change
                minutes.append(minute)
                values.append(units * row["multiplier"])
            yield pa.RecordBatch.from_arrays([pa.array([part.date] * len(minutes), pa.date32()), pa.array(minutes, pa.int64()), pa.array(values, pa.float64())], schema=_ROWS)


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.tests = root, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _COMPARE and f.attribute == ("date",):
                self.tests.append((_COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[PayloadFile]:
        return [p for p in payload_files(self.root) if all(test(p.date, value) for test, value in self.tests)]

    def read(self, partition: PayloadFile) -> Iterator[pa.RecordBatch]:
        # A folder without files of these dates still is one empty partition.
        if isinstance(partition, PayloadFile):
            yield from _decoded(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = payload_files(self.root)
        return {"mtime": files[-1].mtime, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[PayloadFile]:
        after, last = (start["mtime"], start["path"]), (end["mtime"], end["path"])
        return [p for p in payload_files(self.root) if after < (p.mtime, p.path) <= last]

    def read(self, partition: PayloadFile) -> Iterator[pa.RecordBatch]:
        yield from _decoded(partition)


class DeltaPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "date date, minute long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DeltaPayloads)


def write_payloads(rows: DataFrame, ts: str, value: str, multiplier: float, path: str) -> None:
    """rows as payloads, a line a date."""
    coded = encode_delta(rows.withColumn("date", F.to_date(ts)), "date", ts, value, multiplier)
    coded.write.partitionBy("date").option("compression", "gzip").json(path)
