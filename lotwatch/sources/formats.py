"""Landed folders as Spark data sources, and pages as a table function of SQL.

After ``register(spark)``:

    spark.read.format("lotwatch_listing").load("s3a://bucket/landed/listing")
    SELECT p.url, x.* FROM pages p, LATERAL page_parts(p.url, p.html) x

A format discovers the files of a folder, deals them in splits of ``splitbytes`` (64 MB; larger where there
would be more than about a thousand), fetches each split in a task and parses it into rows of its columns, with ``landed`` (the file) and ``error``. What can't be
parsed is a row with nothing but these two. Page formats read JSON lines with ``url`` and ``html``, and a
large file is read by many tasks; other formats take each file whole. Files whose names begin with a dot or
an underscore are left out. A folder without files gives no rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from . import landed

SPLIT_BYTES = 64 << 20
#: Splits of a folder, about: those of a larger folder are larger than ``splitbytes``, as what a task holds doesn't follow its split.
MOST_SPLITS = 1000


@dataclass(frozen=True)
class Format:
    """A source: ``parse`` turns a page (url, html), or a file (name, bytes), into dicts of ``columns``."""

    name: str
    columns: str
    parse: Callable[..., list[dict]]
    lines: bool


FORMATS: dict[str, Format] = {}


def data_format(name: str, columns: str, lines: bool = True):
    """Add a format; a format without a name or with one that is taken is an error."""

    def add(parse: Callable[..., list[dict]]) -> Callable[..., list[dict]]:
        if not name:
            raise ValueError("a format needs a name")
        if name in FORMATS:
            raise ValueError(f"format {name!r} is already registered")
        FORMATS[name] = Format(name, columns, parse, lines)
        return parse

    return add


data_format("listing", landed.LISTING_ROW)(landed._listing)
data_format("cards", landed.CARD_ROW)(landed._cards)
data_format("detail", landed.DETAIL_ROW)(landed._detail)


@data_format("enforcement", "record string", lines=False)
def enforcement_records(name: str, content: bytes) -> list[dict]:
    """The records of one landed page as JSON; a page without any is an error."""
    found = json.loads(content).get("results")
    if not found:
        raise ValueError("no results")
    return [{"record": json.dumps(r, ensure_ascii=False)} for r in found]


@data_format("text", "name string, text string", lines=False)
def text_file(name: str, content: bytes) -> list[dict]:
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return [{"name": stem, "text": content.decode("utf-8", "replace")}]


@dataclass
class Splits(InputPartition):
    """What one task reads: (file, first byte, byte behind the last) of each split."""

    splits: list[tuple[str, int, int]]


def _open(path: str, default_fs: str):
    """The filesystem and the path in it: a path without scheme lies where Spark would look for it."""
    from pyarrow import fs

    uri = path if urlsplit(path).scheme else default_fs.rstrip("/") + "/" + path.lstrip("/")
    uri = "s3:" + uri[4:] if uri.startswith("s3a:") else uri
    return fs.FileSystem.from_uri("file://" + uri[5:].replace("//", "") if uri.startswith("file:") and not uri.startswith("file:///") else uri)


def _lines(file, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end)."""
    at = max(start - 1, 0)
    file.seek(at)
    reader = io.BufferedReader(file, 1 << 20)
    if start:
        at += len(reader.readline())
    while at < end and (line := reader.readline()):
        at += len(line)
        yield line


class LandedReader(DataSourceReader):
    def __init__(self, kind: Format, options: dict, default_fs: str):
        self.kind, self.default_fs, self.path = kind, default_fs, options.get("path")
        if not self.path:
            raise ValueError("load() needs the folder of the landed files")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        if self.split_bytes < 1:
            raise ValueError("splitbytes must be at least 1")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _open(self.path, self.default_fs)
        files = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.size and not any(p[0] in "._" for p in f.path[len(root) :].split("/") if p))
        out: list[Splits] = []
        room, split_bytes = 0, max(self.split_bytes, sum(size for _, size in files) // MOST_SPLITS)
        for path, size in files:
            step = split_bytes if self.kind.lines else size
            for start in range(0, size, step):
                end = min(start + step, size)
                if end - start > room:
                    out.append(Splits([]))
                    room = split_bytes
                out[-1].splits.append((path, start, end))
                room -= end - start
        return out or [Splits([])]

    def _rows(self, system, path: str, start: int, end: int) -> Iterator[dict]:
        with system.open_input_file(path) as file:
            if not self.kind.lines:
                try:
                    yield from self.kind.parse(path.rsplit("/", 1)[-1], file.read())
                except (ValueError, AttributeError) as e:
                    yield {"error": str(e)}
                return
            for line in _lines(file, start, end):
                if not line.strip():
                    continue
                try:
                    page = json.loads(line)
                    found = self.kind.parse(page.get("url") or "", page.get("html") or "")
                except (ValueError, AttributeError) as e:
                    found = [{"error": str(e)}]
                yield from found

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path, self.default_fs)
        rows = (row | {"landed": path} for path, start, end in partition.splits for row in self._rows(system, path, start, end))
        yield from landed.batches_of(rows, landed.arrow_schema(f"{self.kind.columns}, landed string, error string"))


def source_class(kind: Format, default_fs: str) -> type[DataSource]:
    class Landed(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"lotwatch_{kind.name}"

        def schema(self) -> str:
            return f"{kind.columns}, landed string, error string"

        def reader(self, schema) -> DataSourceReader:
            return LandedReader(kind, self.options, default_fs)

    return Landed


@udtf(returnType="part string, at int, fields string", useArrow=True)
class PageParts:
    """(part, at, fields) of a page, parsed once: listing rows, cards, the detail fields and links; ``fields`` is JSON."""

    def eval(self, url: str, html: str):
        yield from landed.page_parts(url or "", html or "")


def register(spark: SparkSession) -> None:
    """Make all formats and ``page_parts`` known to the session."""
    default_fs = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    for kind in FORMATS.values():
        spark.dataSource.register(source_class(kind, default_fs))
    spark.udtf.register("page_parts", PageParts)
