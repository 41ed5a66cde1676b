"""Results of paper searches as rows: Atom feeds and two JSON forms. Each gives paper, title, published, authors, url and pdf_url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import bound, paper_id, text_or_empty

# Addresses of a paper, and of what names it in other catalogues.
ABSTRACT, PDF = "https://arxiv.org/abs/", "https://arxiv.org/pdf/"
OWN_DOI = r"(?i)10\.48550/arxiv\.([0-9]{4}\.[0-9]{4,5})"
OWN_ADDRESS = r"(?i)arxiv\.org/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,5})"
MOST_AUTHORS = 3
WORK_SCHEMA = "doi string, display_name string, title string, publication_date string, locations array<struct<landing_page_url: string, pdf_url: string>>, authorships array<struct<author: struct<display_name: string>>>"
HIT_SCHEMA = "title string, publicationDate string, authors array<struct<name: string>>, externalIds struct<ArXiv: string>"


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(text), r"\s+", " "))


def _paper(paper: Column, title: Column, published: Column, authors: Column) -> Column:
    names = F.array_join(F.slice(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != ""), 1, MOST_AUTHORS), ", ")
    day = F.left(text_or_empty(published), F.lit(10))
    return F.struct(paper.alias("paper"), one_line(title).alias("title"), day.alias("published"), names.alias("authors"), F.concat(F.lit(ABSTRACT), paper).alias("url"), F.concat(F.lit(PDF), paper).alias("pdf_url"))


def atom_entries(feed: Column) -> Column:
    """Array of a feed's entries that have a title; ids without a version."""
    inner = lambda e, tag: F.regexp_extract(e, rf"(?s)<{tag}>(.*?)</{tag}>", 1)

    def entry(e: Column) -> Column:
        own = lambda bare: F.regexp_extract(bare, r"(?i)^([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?$", 1)
        paper = bound(F.regexp_replace(inner(e, "id"), r"^https?://arxiv\.org/abs/", ""), lambda bare: bound(own(bare), lambda o: F.when(o != "", o).otherwise(bare)))
        return bound(paper, lambda p: _paper(p, inner(e, "title"), inner(e, "published"), F.regexp_extract_all(e, F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1))))

    entries = F.regexp_extract_all(text_or_empty(feed), F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    return F.filter(F.transform(entries, entry), lambda p: p["title"] != "")


def work_paper(work: Column) -> Column:
    """A work of a catalogue as a paper, by its DOI or the first address that names one; null if neither does.

    The JSON is bound, and the id that is found in it, or each field would parse it again.
    """
    named = lambda a: F.nullif(F.regexp_extract(text_or_empty(a), OWN_ADDRESS, 1), F.lit(""))
    places = lambda w: F.filter(F.transform(w["locations"], lambda x: F.coalesce(named(x["landing_page_url"]), named(x["pdf_url"]))), F.isnotnull)
    by_doi = lambda w: F.nullif(F.regexp_extract(text_or_empty(w["doi"]), OWN_DOI, 1), F.lit(""))
    title = lambda w: F.coalesce(F.nullif(w["display_name"], F.lit("")), w["title"])
    paper = lambda w, p: F.when(p.isNotNull(), _paper(p, title(w), w["publication_date"], F.transform(w["authorships"], lambda a: a["author"]["display_name"])))
    return bound(F.from_json(work, WORK_SCHEMA), lambda w: bound(F.coalesce(by_doi(w), F.get(places(w), F.lit(0))), lambda p: paper(w, p)))


def hit_paper(hit: Column) -> Column:
    """A hit of a search as a paper; null without an id of its own. The JSON is parsed once, as above."""
    paper = lambda h, p: F.when(p != "", _paper(p, h["title"], h["publicationDate"], F.transform(h["authors"], lambda a: a["name"])))
    return bound(F.from_json(hit, HIT_SCHEMA), lambda h: bound(paper_id(h["externalIds"]["ArXiv"]), lambda p: paper(h, p)))


def with_papers(rows: DataFrame, key: list[str], paper: Column) -> DataFrame:
    """The key and a paper's fields, for rows that have one. The paper is made within a generator, as a filter on it would make it twice."""
    return rows.select(*key, F.inline(F.array_compact(F.array(paper))))


def recent_or_any(published: Column, since: Column) -> Column:
    """Whether a row is recent; rows without a date are."""
    return (F.coalesce(published, F.lit("")) == "") | (published >= since)
