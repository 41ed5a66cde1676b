"""Queries over the trees of pages: their blocks under headings, and their articles. A page is worked on within its row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import articles as A
from folio.functions.addresses import resolve
from folio.operators.documents import table

_BLOCKS = pa.list_(pa.struct([(c, pa.string()) for c in ("path", "type", "text")]))
_ARTICLE = ["title", "byline", "excerpt", "text", "institution", "date"]
#: Pages whose results a task holds at once.
SLICE = 64


def _each(make, kinds: list[pa.DataType]):
    """A function over batches (key, html) that gives the key and what `make` makes of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [make(html) for html in part.column(1).to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [str(k) for k in range(len(kinds) + 1)])

    return run


def block_lists(rows: DataFrame, key: str) -> DataFrame:
    """key and the array of the blocks (path, type and text) of `html`."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "html").mapInArrow(_each(lambda html: (A.blocks(html),), [_BLOCKS]), f"`{key}` {kind}, blocks array<struct<path string, type string, text string>>")


def blocks_of(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, path, type and text of each block of `html`."""
    lists = block_lists(rows, key)
    return lists.select(key, F.posexplode("blocks").alias("pos", "b")).select(key, F.col("pos").cast("long").alias("pos"), "b.path", "b.type", "b.text")


def articles_of(rows: DataFrame, key: str) -> DataFrame:
    """key and title, byline, excerpt, text, institution and date of the article in `html`."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "html").mapInArrow(_each(lambda html: tuple(A.article(html)[c] for c in _ARTICLE), [pa.string()] * len(_ARTICLE)), f"`{key}` {kind}, " + ", ".join(f"{c} string" for c in _ARTICLE))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(table(spark, sf_dir, "pages"), "page_id")
    return rows.select("page_id", "pos", "path", "type", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles_of(table(spark, sf_dir, "pages"), "page_id")
    return rows.select("page_id", "title", "byline", F.md5("excerpt").alias("excerpt_md5"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"), "institution", "date", (F.length("text") >= 80).alias("enough"))


#: Ways to write a link, of which a page's links take one each in turn.
FORMS = ["{}", ".{}", "..{}", "../..{}/./x/../", "?q={}", "#{}", "//other.example{}", "g:{}", "a/..{}"]


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, written in several ways and resolved against its page's address."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links).alias("pos", "href"))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.pmod(F.col("page_id") + F.col("pos"), F.lit(len(FORMS))) + 1).cast("int"))
    rows = rows.select("page_id", F.col("pos").cast("long").alias("pos"), "url", F.replace(form, F.lit("{}"), F.col("href")).alias("reference"))
    return rows.select("page_id", "pos", "reference", resolve(F.col("url"), F.col("reference")).alias("address"))


QUERIES = {"page_blocks": page_blocks, "page_articles": page_articles, "page_links": page_links}
SQL: dict[str, str] = {}
