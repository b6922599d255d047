"""Sectioned report files as a Spark data source (S-1/S-5): ``spark.read.format("sectioned_report")``.

The rows are those of ``report_file.parse_report``.  A file is one partition, read line by line in its task, so
sections and line numbers need no shuffle and no file is held whole.  Filters on ``month`` choose the files before
any is opened: the month of a file is known from its path (a ``month=…`` folder, else a ``xxx_stats.csv`` name, else null).

Defined results: a missing path or a folder without files gives no rows, a path given twice is read once, hidden files
(``_…``, ``.…``) are skipped, empty files and lines above the first section title give no rows, cells beyond the fourth
are ignored, numbers that do not parse are null (a row without a count is no data row), bytes that are not UTF-8 raise.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, IsNull)

from .. import constants as K

FORMAT = "sectioned_report"
SCHEMA = "month STRING, section STRING, line_no INT, tag STRING, n_dialogs BIGINT, pct_1 DOUBLE, pct_2 DOUBLE"
ARROW = pa.schema([("month", pa.string()), ("section", pa.string()), ("line_no", pa.int32()), ("tag", pa.string()),
                   ("n_dialogs", pa.int64()), ("pct_1", pa.float64()), ("pct_2", pa.float64())])
SECTIONS = {K.REPORT_STAGE1_TITLE: "stage1", K.REPORT_STAGE2_TITLE: "stage2", K.REPORT_CONVERSION_TITLE: "conversion"}
BATCH_ROWS = 8192
HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"

_INTEGER = re.compile(r"[+-]?[0-9]+")
_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def month_of(path: str) -> str | None:
    """The month a file's path names."""
    folder = re.search(r"/month=([^/]+)/", path)
    if folder:
        value = unquote(folder[1])
        return None if value == HIVE_NULL else value
    flat = re.search(r"/([a-z]{3})_stats\.csv$", path)
    return flat[1] if flat else None


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", uri)))


def _count(text: str) -> int | None:
    text = text.strip(" ")
    value = int(text) if _INTEGER.fullmatch(text) else None
    return value if value is not None and -2**63 <= value < 2**63 else None


def _percent(text: str) -> float | None:
    text = text.strip(" ").removesuffix("%")
    return float(text) if _NUMBER.fullmatch(text) else None


def _cells(line: str) -> list[str]:
    return (next(csv.reader([line])) + [""] * 4)[:4]


def parse_lines(lines: Iterable[str], month: str | None) -> Iterator[tuple]:
    """Data rows of one file's lines: those with a count below a section title, numbered within their section."""
    section, numbers = None, dict.fromkeys(SECTIONS.values(), 0)
    for line in lines:
        line = line.replace("\r", "").removesuffix("\n")
        if not line:
            continue
        tag, count, pct_1, pct_2 = _cells(line)
        section = SECTIONS.get(tag, section)
        n = _count(count)
        if section is not None and n is not None:
            numbers[section] += 1
            yield month, section, numbers[section], tag or None, n, _percent(pct_1), _percent(pct_2)


@dataclass
class ReportFile(InputPartition):
    root: str  # URI that names the file system
    path: str  # the file's path there; empty: no file
    month: str | None


class ReportReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]):
        self.paths = list(paths)
        self.months: set[str | None] | None = None  # None: every month
        self.not_null = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the conditions on the month that a file's path decides; hands the others back."""
        for f in filters:
            if getattr(f, "attribute", None) != ("month",):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self._keep({f.value} if isinstance(f, EqualNullSafe) else {f.value} - {None})
            elif isinstance(f, In):
                self._keep(set(f.value) - {None})
            elif isinstance(f, IsNull):
                self._keep({None})
            elif isinstance(f, IsNotNull):
                self.not_null = True
            else:
                yield f

    def _keep(self, months: set) -> None:
        self.months = months if self.months is None else self.months & months

    def _asked(self, month: str | None) -> bool:
        return (self.months is None or month in self.months) and not (self.not_null and month is None)

    def partitions(self) -> list[ReportFile]:
        """One partition per file of an asked month; files are listed, not opened."""
        found = {}
        for uri in self.paths:
            files, path = _filesystem(uri)
            info = files.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                continue
            infos = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
            for i in infos:
                inner = i.path[len(path):] if i is not info else i.base_name
                if i.type == fs.FileType.File and not any(p[:1] in ("_", ".") for p in inner.split("/")):
                    month = month_of("/" + i.path.lstrip("/"))
                    if self._asked(month):
                        found[i.path] = ReportFile(uri, i.path, month)
        # A source needs a partition; without a file it is an empty one.
        return list(found.values()) or [ReportFile("", "", None)]

    def read(self, partition: ReportFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _filesystem(partition.root)
        csv.field_size_limit(2**31 - 1)  # a cell may be as long as its line
        with files.open_input_stream(partition.path) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="\n") as lines:
            rows = []
            for row in parse_lines(lines, partition.month):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReportReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else []
        return ReportReader(paths + ([self.options["path"]] if "path" in self.options else []))


def read_reports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The rows of report files or folders of them.  Registers the source and lets the session push filters into
    Python sources; paths without a scheme lie on the session's default file system."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReportSource)

    def qualified(path: str) -> str:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString()

    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(FORMAT).option("paths", json.dumps([qualified(p) for p in paths])).load()
