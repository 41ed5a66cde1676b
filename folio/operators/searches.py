"""Queries over stored feeds: all documents written as entries of their days, and searched through the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.documents import table
from folio.sources import atom
from folio.sources.shared import shared_folder

#: What is searched for: the last day, how many days, a category and a keyword.
TODAY, DAYS, CATEGORY, KEYWORD = "2024-06-28", 30, "en", "the"
#: The first day of a document, by its id, and over how many days documents are spread.
FIRST_DAY, SPREAD = "2024-05-01", 90


def entries_of(docs: DataFrame) -> DataFrame:
    """Every document's lines with a word as entries: published on its day, in the category of its language, with the line before as summary."""
    day = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("doc_id", F.lit(SPREAD)).cast("int")), "yyyy-MM-dd")
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), day.alias("published"), lines)
    own: Column = F.concat(F.lit("http://arxiv.org/abs/cs/"), F.col("doc_id"), F.lit("."), F.col("k"), F.lit("v1"))
    names = F.transform(F.slice(F.split("line", " "), 1, 4), lambda w: F.concat(F.lit("<author><name>"), atom.escaped(w), F.lit("</name></author>")))
    entry = F.concat(
        F.lit("<entry>\n<id>"), own, F.lit("</id>\n<published>"), F.col("published"), F.lit("T01:02:03Z</published>\n<title>"), atom.escaped(F.col("line")), F.lit('</title>\n<category term="'), atom.escaped(F.col("lang")), F.lit('"/>\n'), F.array_join(names, ""), F.lit("</entry>")
    )
    return rows.select("published", entry.alias("entry"))


def feed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the search finds among all documents written as feeds."""
    folder = shared_folder(spark, "feeds")
    atom.write_feeds(entries_of(table(spark, sf_dir, "documents")), folder)
    found = atom.search(atom.feeds(spark, folder), TODAY, DAYS, CATEGORY, KEYWORD, most=None)
    authors = F.array_join(F.slice("authors", 1, 3), ", ")
    return found.select("paper", "published", F.md5("title").alias("title_md5"), F.md5(authors).alias("authors_md5"), F.size("authors").cast("long").alias("n_authors"), "url")


QUERIES = {"feed_search": feed_search}
_WHITE = r"'[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
SQL = {
    "feed_search": rf"""with a as (select doc_id, coalesce(lang, '') lang, strftime(date '{FIRST_DAY}' + (((doc_id % {SPREAD}) + {SPREAD}) % {SPREAD})::integer, '%Y-%m-%d') published, string_split(coalesce(text, ''), chr(10)) lines from documents),
      b as (select doc_id, lang, published, unnest(lines) line, unnest(range(len(lines))) k from a),
      c as (select 'cs/' || doc_id || '.' || k || 'v1' paper, published, trim(regexp_replace(line, {_WHITE}, ' ', 'g')) title, string_split(line, ' ')[1:4] names from b where lang = '{CATEGORY}' and published between strftime(date '{TODAY}' - {DAYS}, '%Y-%m-%d') and '{TODAY}')
      select paper, published, md5(title) title_md5, md5(array_to_string(names[1:3], ', ')) authors_md5, len(names)::bigint n_authors, 'https://arxiv.org/abs/' || paper url from c
      where title <> '' and contains(lower(title || ' ' || array_to_string(names, ' ')), '{KEYWORD}')""",
}
