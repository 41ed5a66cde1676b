"""Stored Atom feeds as a data source, `atom`: files of entries in a folder for each day.

Conditions on the category, the day and the words of an entry go to the source: days that are asked for choose the folders, before
a file is listed, and category and words choose the entries, before they are made rows. A file is one partition and is read in
pieces, so that a task holds one piece and one entry at most. Entries without a title are none; a folder's day is that of its entries.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains

from folio.sources.search import ABSTRACT, PDF
from folio.sources.shared import file_system

SCHEMA = "paper string, title string, published string, authors array<string>, category string, words string, url string, pdf_url string"
ARROW = pa.schema([("paper", pa.string()), ("title", pa.string()), ("published", pa.string()), ("authors", pa.list_(pa.string())), ("category", pa.string()), ("words", pa.string()), ("url", pa.string()), ("pdf_url", pa.string())])
PIECE = 1 << 20
BATCH = 2000
#: How many results a search gives, and over how many days it may go.
MOST_RESULTS, DAYS, MOST_DAYS = 60, 3, 30

_ENTRY = re.compile(r"<entry>(.*?)</entry>", re.S)
_NAME = re.compile(r"<name>(.*?)</name>", re.S)
_CATEGORY = re.compile(r'<category\b[^>]*\bterm="([^"]*)"')
_OWN = re.compile(r"^(\d{4}\.\d{4,5})(?:v\d+)?$", re.I | re.A)


def _inner(entry: str, tag: str) -> str:
    found = re.search(rf"<{tag}>(.*?)</{tag}>", entry, re.S)
    return unescape(found[1]) if found else ""


def parsed(entry: str) -> dict | None:
    """A row of an entry's markup."""
    title = " ".join(_inner(entry, "title").split())
    if not title:
        return None
    bare = re.sub(r"^https?://arxiv\.org/abs/", "", _inner(entry, "id"))
    own = _OWN.match(bare)
    paper, names, category = own[1] if own else bare, [unescape(n) for n in _NAME.findall(entry)], _CATEGORY.search(entry)
    words = " ".join(" ".join([title, _inner(entry, "summary"), *names]).split()).lower()
    return {"paper": paper, "title": title, "published": _inner(entry, "published")[:10], "authors": names, "category": unescape(category[1]) if category else "", "words": words, "url": ABSTRACT + paper, "pdf_url": PDF + paper}


@dataclass
class FeedFile(InputPartition):
    path: str


class AtomReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.days: list[tuple[str, str]] = []
        self.category: str | None = None
        self.words: list[str] = []
        self.nothing = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("published",), value):
                    self.days.append(("==", value))
                case GreaterThanOrEqual(("published",), value):
                    self.days.append((">=", value))
                case GreaterThan(("published",), value):
                    self.days.append((">", value))
                case LessThanOrEqual(("published",), value):
                    self.days.append(("<=", value))
                case LessThan(("published",), value):
                    self.days.append(("<", value))
                case EqualTo(("category",), value):
                    self.nothing |= self.category is not None and self.category != value
                    self.category = value
                case StringContains(("words",), value):
                    self.words.append(value)
                case IsNotNull(_):  # no column of a row is null
                    pass
                case _:
                    yield f

    def _asked(self, day: str) -> bool:
        holds = {"==": day.__eq__, ">=": day.__ge__, ">": day.__gt__, "<=": day.__le__, "<": day.__lt__}
        return all(holds[sign](value) for sign, value in self.days)

    def partitions(self) -> list[FeedFile]:
        if self.nothing:
            return []
        system, path = file_system(self.path)
        folders = [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory and x.base_name.startswith("day=") and self._asked(x.base_name[4:])]
        files = [f for folder in folders for f in system.get_file_info(fs.FileSelector(folder.path)) if f.type == fs.FileType.File and f.base_name.endswith((".xml", ".txt"))]
        return [FeedFile(f.path) for f in sorted(files, key=lambda f: f.path)]

    def _entries(self, path: str) -> Iterator[str]:
        held = b""
        with file_system(self.path)[0].open_input_stream(path) as stream:
            while piece := stream.read(PIECE):
                *whole, held = (held + piece).split(b"</entry>")
                for part in whole:
                    yield from _ENTRY.findall(part.decode("utf-8", "replace") + "</entry>")

    def read(self, partition: FeedFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, FeedFile):  # Spark gives null where there are no partitions
            return
        rows = []
        for entry in self._entries(partition.path):
            row = parsed(entry)
            if row and self._asked(row["published"]) and self.category in (None, row["category"]) and all(w in row["words"] for w in self.words):
                rows.append(row)
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class AtomSource(DataSource):
    """Option `path`: the folder with a folder `day=YYYY-MM-DD` for each day."""

    @classmethod
    def name(cls) -> str:
        return "atom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AtomReader:
        return AtomReader(posixpath.join(self.options["path"]))


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a folder of feeds."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AtomSource)
    return spark.read.format("atom").option("path", folder).load()


def write_feeds(entries: DataFrame, folder: str) -> None:
    """entries (published, entry: markup) as files of a folder for each day."""
    entries.select(F.col("published").alias("day"), "entry").repartition("day").write.partitionBy("day").option("maxRecordsPerFile", 100_000).text(folder)


def search(papers: DataFrame, today: str, days: int = DAYS, category: str = "", keyword: str = "", most: int | None = MOST_RESULTS) -> DataFrame:
    """Papers published in the `days` (30 at most) up to today, in the category and with the keyword if they are given, the newest first; all if `most` is None."""
    since = F.date_format(F.date_sub(F.lit(today).cast("date"), min(days or DAYS, MOST_DAYS)), "yyyy-MM-dd")
    # the source is asked with plain values
    since = papers.sparkSession.range(1).select(since).first()[0]
    rows = papers.where((F.col("published") >= since) & (F.col("published") <= today))
    if category:
        rows = rows.where(F.col("category") == category)
    if keyword:
        rows = rows.where(F.col("words").contains(keyword.lower()))
    return rows if most is None else rows.orderBy(F.desc("published"), "paper", "title").limit(most)


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
