"""Harvest of chained OAI-PMH pages as a Spark data source, batch and stream.

A harvester outside of the engine stages every response of an identifier listing
as one file, named after the resumption token it was asked for with
(:func:`page_name`; the first page has the empty token). A page names the next
token or, as the last one, none, so the pages are a chain.

* ``readStream`` follows the chain as far as it is staged. Its offset is the
  resumption token to go on with (and the number of pages before it): a stopped
  harvest goes on at the page it stopped at, and :func:`next_token` tells the harvester what to ask for.
* ``read`` returns the rows of the whole chain. With a page directory
  (:func:`build_directory`) filters on ``datestamp`` skip pages before any task is planned.
* A page is one task. The driver reads the end of each page (``TAIL`` bytes) to
  find its token, or one row per page from the directory.

Defined results: a page without headers has no rows; a date that is none is null,
which no date filter keeps; repeated headers come repeatedly; pages outside of the chain are not read; a page
that is no XML raises, as does a chain that comes back to a page. Pages are never changed once staged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual)

from .storage import open_fs

FORMAT = "oai_pages"
SCHEMA = "identifier string, datestamp date, setSpec array<string>, deleted boolean, page long"
TAIL = 16 << 10                       # bytes at the end of a page that hold its resumption token
_TOKEN = re.compile(rb"<(?:\w+:)?resumptionToken\b[^>]*?(?:/>|>([^<]*)<)")


def page_name(token: str) -> str:
    """The file of the page that was asked for with ``token``."""
    return hashlib.sha256(token.encode()).hexdigest() + ".xml"


def _next(files: fs.FileSystem, path: str) -> str | None:
    """The token a page names, "" on the last page, None where the page is not staged."""
    info = files.get_file_info(path)
    if info.type != fs.FileType.File:
        return None
    with files.open_input_file(path) as f:
        data = f.read_at(min(TAIL, info.size), max(0, info.size - TAIL))
    found = _TOKEN.findall(data)
    return unescape(found[-1].decode()).strip() if found else ""


def _chain(folder: str, token: str, directory: dict[str, dict] | None = None) -> Iterator[tuple[str, str]]:
    """(file name, next token) of the staged pages from the one of ``token`` on."""
    files, root = open_fs(folder)
    seen = set()
    while True:
        name = page_name(token)
        if name in seen:
            raise ValueError(f"the pages in {folder} come back to the token {token!r}")
        seen.add(name)
        if directory and name in directory:
            after = directory[name]["next"]
        else:
            after = _next(files, f"{root}/{name}")
        if after is None:
            return
        yield name, after
        if not after:
            return
        token = after


def _headers(folder: str, name: str) -> Iterator[tuple[str | None, date | None, list[str], bool]]:
    files, root = open_fs(folder)
    with files.open_input_stream(f"{root}/{name}") as f:
        try:
            for _, x in ElementTree.iterparse(f):
                if x.tag.rpartition("}")[2] != "header":
                    continue
                fields: dict[str, list[str]] = {}
                for child in x:
                    fields.setdefault(child.tag.rpartition("}")[2], []).append((child.text or "").strip())
                yield (fields.get("identifier", [None])[0], _day(fields.get("datestamp", [""])[0]),
                       fields.get("setSpec", []), x.get("status") == "deleted")
                x.clear()
        except ElementTree.ParseError as e:
            raise ValueError(f"{folder}/{name} is not a page: {e}") from e


def _day(text: str) -> date | None:
    try:
        return date.fromisoformat(text[:10])
    except ValueError:
        return None


class _Page(InputPartition):
    def __init__(self, name: str, page: int):
        self.name, self.page = name, page


def _rows(folder: str, part: _Page) -> Iterator[tuple]:
    for row in _headers(folder, part.name):
        yield (*row, part.page)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, directory: str | None):
        self.folder, self.directory = folder, directory
        self.least: date | None = None                     # bounds that a wanted datestamp keeps
        self.most: date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("datestamp",) and isinstance(getattr(f, "value", None), date):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least or f.value, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most = min(self.most or f.value, f.value)
            yield f                                        # pages are skipped by it, rows are left to Spark

    def partitions(self) -> list[_Page]:
        known = None
        if self.directory:
            files, root = open_fs(self.directory)
            known = {r["file"]: r for r in pq.read_table(root, filesystem=files).to_pylist()}
        bounded = self.least is not None or self.most is not None
        out = []
        for k, (name, _) in enumerate(_chain(self.folder, "", known)):
            r = known.get(name) if known and bounded else None
            if r and (r["first"] is None or (self.least and r["last"] < self.least) or (self.most and r["first"] > self.most)):
                continue
            out.append(_Page(name, k))
        return out or [_Page("", -1)]

    def read(self, part: _Page) -> Iterator[tuple]:
        return _rows(self.folder, part) if part.name else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offset: token (of the page to read next), pages (before it), end (1 behind the last page)."""

    def __init__(self, folder: str):
        self.folder = folder
        self.at = self.initialOffset()                     # as far as the chain was followed

    def initialOffset(self) -> dict:
        return {"token": "", "pages": 0, "end": 0}

    def latestOffset(self) -> dict:
        if not self.at["end"]:
            for _, after in _chain(self.folder, self.at["token"]):
                self.at = {"token": after, "pages": self.at["pages"] + 1, "end": int(not after)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        n = end["pages"] - start["pages"]
        if n <= 0:
            return []
        return [_Page(name, start["pages"] + k) for k, (name, _) in zip(range(n), _chain(self.folder, start["token"]), strict=False)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class OaiPages(DataSource):
    """``spark.read`` / ``spark.readStream`` format ``oai_pages``; options: path, directory (batch only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("directory"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register_source(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach sources written in Python (a setting of the session)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OaiPages)


def read_pages(spark: SparkSession, folder: str, directory: str | None = None) -> DataFrame:
    """The headers of all pages of the chain in ``folder``."""
    register_source(spark)
    r = spark.read.format(FORMAT).option("path", folder)
    return (r.option("directory", directory) if directory else r).load()


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The headers as a stream, page after page of the chain."""
    register_source(spark)
    return spark.readStream.format(FORMAT).option("path", folder).load()


def next_token(folder: str, token: str = "") -> str | None:
    """The token of the first page that is not staged yet, looked for from the page of ``token`` on;
    None when the chain is complete."""
    for _, after in _chain(folder, token):
        token = after
        if not after:
            return None
    return token


def build_directory(spark: SparkSession, folder: str, dest: str) -> str:
    """Write one row per staged page: file, next token, number of headers, first and last date. Tasks parse the
    pages; one that is staged later is found by its own end until the directory is built again."""
    names = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_fs(folder)
        schema = pa.schema([("file", pa.string()), ("next", pa.string()), ("n", pa.int64()), ("first", pa.date32()), ("last", pa.date32())])
        for b in batches:
            for name in b.column(0).to_pylist():
                n, first, last = 0, None, None
                for _, day, *_ in _headers(folder, name):
                    n += 1
                    if day:
                        first, last = min(first or day, day), max(last or day, day)
                yield pa.RecordBatch.from_pylist([{"file": name, "next": _next(files, f"{root}/{name}"), "n": n, "first": first, "last": last}], schema)

    names.mapInArrow(run, "file string, next string, n long, first date, last date").write.parquet(dest)
    return dest
