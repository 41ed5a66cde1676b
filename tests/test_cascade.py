"""Cascades of searches, names of HTML editions, and prompts under caps."""

from folio.operators.cascade import cascade, edition_meta
from folio.operators.prompts import BODY, figure_lines, meta_block, within_budget
from pyspark.sql import functions as F


def test_cascade_stops_at_the_first_that_finds_and_keeps_reasons(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "q string")
    found = lambda rows: spark.createDataFrame(rows, "q string, p string").select("q", F.struct("p").alias("paper"))
    failed = lambda rows: spark.createDataFrame(rows, "q string, reason string")
    steps = [
        ("one", found([("a", "x"), ("a", "w")]), failed([("b", "HTTP 503"), ("b", "HTTP 500"), ("d", "timeout")])),
        ("two", found([("a", "y"), ("b", "y"), ("b", "z")]), failed([("d", "no proxy")])),
        ("three", found([(None, "n"), ("b", "late")]), None),
    ]
    got = {r.q: (r.source, r.n_papers, r.first.p if r.first else None, r.reasons) for r in cascade(keys, "q", steps).collect()}
    assert got == {
        "a": ("one", 2, "w", []),
        "b": ("two", 2, "y", ["one: HTTP 500"]),
        "c": (None, 0, None, ["one: found nothing", "two: found nothing", "three: found nothing"]),
        "d": (None, 0, None, ["one: timeout", "two: no proxy", "three: found nothing"]),
        None: ("three", 1, "n", ["one: found nothing", "two: found nothing"]),
    }


def test_edition_meta(spark):
    pages = [
        '<title>Page</title><h1 class="a ltx_title_document">A <i>deep</i>\n title</h1><span class="ltx_personname">Ann Lee<sup>1</sup> 2 ,</span><span class="ltx_personname">Bo</span><span class="ltx_personname"> </span><span class="ltx_personname">C</span><span class="ltx_personname">D</span>',
        "<title> Only\n page </title>",
        "<p>none</p>",
        None,
    ]
    got = [r.m for r in spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "id long, html string").select("id", edition_meta(F.col("html")).alias("m")).orderBy("id").collect()]
    assert [tuple(m) if m else None for m in got] == [("A deep title", "Ann Lee, Bo, C"), ("Only page", ""), None, None]


def test_parts_within_a_budget(spark):
    rows = spark.createDataFrame([(1, "abc", "de", "fghi"), (2, None, "de", "fghi"), (3, None, None, None), (4, "abcdefgh", "x", "y")], "id long, a string, b string, c string")
    for budget, want in ((100, ["abc\nde\nfghi", "de\nfghi", "", "abcdefgh\nx\ny"]), (8, ["abc\nde\nf", "de\nfghi", "", "abcdefgh"]), (4, ["abc", "de\nf", "", "abcd"]), (0, ["", "", "", ""])):
        got = [r.t for r in rows.select("id", within_budget([F.col(c) for c in "abc"], budget).alias("t")).orderBy("id").collect()]
        assert got == want, budget


def test_meta_and_figures(spark):
    row = spark.createDataFrame([("é" * 300, "", None, [(3, 4, "a\n b " * 80), (5, None, "")])], "authors string, institution string, date string, figures array<struct<num:int,page:int,caption:string>>")
    meta, lines, none = row.select(meta_block(F.col("authors"), F.col("institution"), F.col("date")), figure_lines(F.col("figures")), meta_block(F.lit(None), F.lit(""), F.lit(None))).first()
    assert meta == "作者：" + "é" * 200 and none == "（暂无机构/时间元数据）"
    first, second = lines.split("\n")
    assert first.startswith("- 图片 3（第 4 页）图注：a b a b") and len(first.split("图注：")[1]) == 200
    assert second == "- 图片 5图注：无图注" and BODY.endswith("：")
