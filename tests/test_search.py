"""Parsing of search results, and headings of plain text, on forms written by hand."""

import pytest
from pyspark.sql import functions as F

from folio.operators.papers import best_edition, plain_heading
from folio.operators.search import checked_scenes, hit_papers, newest_of, recent_papers, visuals, work_papers
from folio.sources import search as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_entries_of_a_feed(spark):
    feed = """<feed><entry><id>http://arxiv.org/abs/2610.02116v1</id><title> Two
      lines </title><published>2026-01-02T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author><author><name>C</name></author><author><name>D</name></author></entry>
      <entry><id>http://arxiv.org/abs/cs/0001</id><title> </title></entry><entry><id>http://arxiv.org/abs/cs/0002</id><title>Old</title></entry></feed>"""
    got = value(spark, S.atom_entries(F.lit(feed)))
    assert [(p["paper"], p["title"], p["published"], p["authors"]) for p in got] == [("2610.02116", "Two lines", "2026-01-02", "A, B, C"), ("cs/0002", "Old", "", "")]
    assert value(spark, S.atom_entries(F.lit(None).cast("string"))) == []


def test_works_and_hits(spark):
    work = '{"doi":"https://doi.org/10.48550/arXiv.2501.12948","display_name":"A  b","publication_date":"2025-01-22","authorships":[{"author":{"display_name":"X"}},{"author":null}]}'
    assert value(spark, S.work_paper(F.lit(work)))["paper"] == "2501.12948"
    located = '{"title":"T","locations":[{"landing_page_url":null,"pdf_url":"https://arxiv.org/pdf/1706.03762v5"}]}'
    got = value(spark, S.work_paper(F.lit(located)))
    assert (got["paper"], got["title"], got["authors"], got["pdf_url"]) == ("1706.03762", "T", "", "https://arxiv.org/pdf/1706.03762")
    assert value(spark, S.work_paper(F.lit('{"doi":"https://doi.org/10.1/x"}'))) is None and value(spark, S.work_paper(F.lit("broken"))) is None
    assert value(spark, S.hit_paper(F.lit('{"title":"T","externalIds":{"ArXiv":"1706.03762v5"},"authors":[{"name":"A"}]}')))["url"] == "https://arxiv.org/abs/1706.03762"
    assert value(spark, S.hit_paper(F.lit('{"title":"T","externalIds":{}}'))) is None


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [work_papers, hit_papers])
def test_json_is_parsed_once(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_recent_papers_are_made_once(spark):
    rows = recent_papers(spark, SF)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("from_json") == 1


def test_newest_papers_of_a_source(spark):
    days = ["2024-05-01", "2024-04-30", "2024-01-01", "2023-01-01"]
    rows = [("new", i, f"p{i}", days[i % 4]) for i in range(400)] + [("old", i, f"p{i}", days[2 + i % 2]) for i in range(400, 600)]
    rows += [("undated", i, f"p{i}", "" if i < 670 else days[3]) for i in range(600, 700)] + [(None, 700, "p700", days[1]), (None, 701, "p701", days[2])]
    got = newest_of(spark.createDataFrame(rows, "source string, doc_id long, paper string, published string")).collect()
    want = []
    for source in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == source]
        recent = [r for r in own if r[3] == "" or r[3] >= "2024-04-01"]
        best = sorted(recent or own, key=lambda r: (r[3], r[1]), reverse=True)[:60]
        want += [(source, k + 1, r[1], r[2], r[3]) for k, r in enumerate(best)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_plain_headings(spark):
    lines = ["1 Introduction", "2.1 Model Details", "3.2.1. Deep One", "Abstract", "引言：", "1 a lower start", "2 Ends with a stop.", "2 Ab", "", "4 " + "A" * 90]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    level, title = plain_heading(F.col("line"))
    got = [(r["level"], r["title"]) for r in rows.select("i", level.alias("level"), title.alias("title")).orderBy("i").collect()]
    assert got == [(1, "1 Introduction"), (2, "2.1 Model Details"), (3, "3.2.1 Deep One"), (1, "Abstract"), (1, "引言"), *[(0, None)] * 5]


def test_best_edition(spark):
    long = "x" * 600
    rows = spark.createDataFrame([(1, long, 2, long, 3, None), (2, long, 0, long, 3, None), (3, "short", 1, long, 3, long), (4, None, None, "short", 1, long), (5, None, None, None, None, "y" * 299), (6, "x" * 500, 1, None, 0, None)], "id int, html_text string, html_figures int, tex_text string, tex_figures int, pdf_text string")
    assert [(r["edition"], r["figures"]) for r in best_edition(rows, "id").orderBy("id").collect()] == [("html", 2), ("html+tex", 3), ("tex", 3), ("pdf", 0), ("none", 0), ("none", 0)]


def test_scenes_lose_figures_that_are_not_there(spark):
    scenes = spark.createDataFrame([(1, 0, " a ", None), (1, 1, "b", 1), (1, 2, "", 1), (1, 3, "c", 9), (1, 4, "d", None), (2, 0, None, None)], "conv_id long, turn long, narration string, figure long")
    figures = spark.createDataFrame([(1, 1), (1, 1)], "conv_id long, num long")
    got = checked_scenes(scenes, figures)
    assert [(r["pos"], r["narration"], r["figure"]) for r in got.orderBy("pos").collect()] == [(0, "a", None), (1, "b", 1), (2, "c", None), (3, "d", None)]
    pages = spark.createDataFrame([(1, 2)], "conv_id long, pages long")
    assert [(r["kind"], r["page"]) for r in visuals(got, pages).orderBy("pos").collect()] == [("title", None), ("figure", None), ("page", 1), ("end", None)]
