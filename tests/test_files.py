"""Lines of PDFs, main TeX files, authors, uploads, HTML of Markdown and feeds of jobs, on forms written by hand."""

from pyspark.sql import functions as F

from folio.operators.feeds import job_feeds
from folio.operators.files import author_names, edition_authors, is_chinese, item_lines, main_tex, pdf_lines, upload
from folio.operators.html import markdown_to_html

ITEMS = "doc_id long, page long, item long, str string, y double, eol boolean"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lines_end_by_height_or_mark(spark):
    rows = [
        (1, 1, 0, "Deep ", 700.0, False), (1, 1, 1, " nets", 698.0, False), (1, 1, 2, "next", 690.0, False), (1, 1, 3, None, None, None),
        (1, 1, 4, "-- ==", 690.0, True), (1, 1, 5, " same", 600.0, False), (1, 1, 6, "x", 500.0, None), (1, 2, 0, "two", 1.0, False), (1, 41, 0, "late", 1.0, False),
    ]
    got = [(r["page"], r["line"], r["text"]) for r in pdf_lines(spark.createDataFrame(rows, ITEMS)).orderBy("page", "line").collect()]
    # the item that ends a line opens the next one, and its height is forgotten
    assert got == [(1, 1, "Deep nets"), (1, 2, "next"), (1, 3, "-- == same"), (1, 4, "x"), (2, 1, "two")]
    assert pdf_lines(spark.createDataFrame([], ITEMS)).count() == 0


def test_pages_stop_behind_the_most_characters(spark):
    rows = [(1, p, 0, "x" * 50_000, 1.0, False) for p in range(1, 6)] + [(2, 1, 0, "--", 1.0, False)]
    got = pdf_lines(spark.createDataFrame(rows, ITEMS))
    assert sorted((r["doc_id"], r["page"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 3)]


def test_words_of_pages_go_through_no_shuffle(spark):
    plan = item_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window ") == 1


def test_authors_are_found_once(spark):
    plan = edition_authors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ltx_personname(?:") == 1 and plan.count("ltx_authors(?:") == 1


def test_main_file_and_its_inputs(spark):
    main = "\\begin{document} \\input{a}\\include{ sub/b.tex }\\input{gone}\\input{a}\\input{main}"
    rows = [(1, "x/main.tex", main), (1, "x/a.tex", "A"), (1, "y/a.TEX", "no"), (1, "y/aa.tex", "longer"), (1, "x/sub/b.tex", None), (1, "z.tex", "z" * 500), (2, "b.tex", "same"), (2, "a.tex", "same"), (3, "a.cls", "none"), (None, "n.tex", "n")]
    got = {r["paper"]: (r["main"], r["parts"], r["text"]) for r in main_tex(spark.createDataFrame(rows, "paper long, path string, content string")).collect()}
    # a name stands for the longest file whose path ends with it
    assert got == {1: ("x/main.tex", 4, "\n\n".join([main, "longer", "", "longer"])), 2: ("a.tex", 1, "same")}


def test_authors(spark):
    marked = '<div class="ltx_authors"><span class="ltx_personname">A  B<sup>1</sup>†</span> and <span class="x ltx_personname">C &amp; D<em class="ltx_note">n</em></span><span class="ltx_personname"> * </span></div>'
    assert value(spark, author_names(F.lit(marked))) == "A B, C & D"
    assert value(spark, author_names(F.lit('<p class="ltx_authors"> Authors： X Y‡ , <b>Z</b></p>'))) == "X Y, Z"
    assert value(spark, author_names(F.lit('<p class="ltx_authorship">X</p>'))) == "" and value(spark, author_names(F.lit(None).cast("string"))) == ""


def test_uploads(spark):
    def got(text, name="n.md"):
        return tuple(value(spark, c) for c in upload(F.lit(text).cast("string"), F.lit(name)).values())

    assert got("\r\n  \r\n## A  title\r\nbody 2024-05") == ("A  title", "## A title body 2024-05", "2024年5月")
    assert got(None, "My note.TXT") == ("My note", "", "") and got("#")[0] == "#" and len(got("x" * 200)[0]) == 80
    assert value(spark, is_chinese(F.lit("图" * 20))) and not value(spark, is_chinese(F.lit("图" * 19)))


def test_markdown_as_html(spark):
    def tags(text):
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return markdown_to_html(rows).select(F.regexp_replace("html", ' (?:style|alt)="[^"]*"', "").alias("h")).first()["h"]

    assert tags("# A **b**\n##### five\ntwo") == "<h2>A <strong>b</strong></h2><p>##### five two</p>"
    assert tags("- a\ntext\n- b\n1. c\n\n2) d") == "<ul><li>a</li><p>text</p><li>b</li></ul><ol><li>c</li></ol><ol><li>d</li></ol>"
    assert tags("a\r\n```js\n | <x>\n# y\n```\n```svg\n1") == "<p>a</p><pre><code> | &lt;x&gt;\n# y</code></pre>" + tags("```svg")
    assert tags("|no|\n| a | b |\n|--|:--:|\n|1|\n| 2 | `3` |\n> q") == "<p>|no|</p><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td></tr><tr><td>2</td><td><code>3</code></td></tr></tbody></table><blockquote>q</blockquote>"
    assert tags("|a|\n|-|") == "<p>|a| |-|</p>"  # two strokes at least
    assert tags("x $a<b$ $$c$$ ![t](u.png)") == '<p>x <span>a&lt;b</span> <span>c</span> <img src="u.png" /></p>'
    assert tags("```\n```\n- z") == "<pre><code></code></pre><ul><li>z</li></ul>" and tags("") == "" and tags(None) == ""


def test_feeds_of_jobs(spark):
    day = lambda t: f"2024-01-01 {t}:00"
    rows = [("a", day("00:00"), 1, "queued"), ("a", day("00:02"), 2, "write"), ("a", day("00:04"), 3, "done"), ("a", day("00:05"), 4, "fail"), ("b", day("00:01"), 5, "queued"), ("b", day("03:00"), 6, None), (None, day("00:00"), 7, "queued")]
    events = spark.createDataFrame(rows, "job_id string, ts string, event_id long, event string").withColumn("ts", F.to_timestamp("ts"))
    at = spark.createDataFrame([("a", day("00:01")), ("a", day("00:04")), ("a", day("00:14")), ("a", day("00:15")), ("b", day("02:00")), ("c", day("02:00"))], "job_id string, at string").withColumn("at", F.to_timestamp("at"))
    got = sorted((r["job_id"], r["at"].strftime("%H:%M"), r["event_id"] or 0, r["kind"], r["stage"]) for r in job_feeds(events, at, ends=("done", "fail")).collect())
    assert got == [
        ("a", "00:01", 0, "snapshot", "queued"), ("a", "00:01", 2, "stage", "write"), ("a", "00:01", 3, "end", "done"),
        ("a", "00:04", 0, "snapshot", "write"), ("a", "00:04", 3, "end", "done"), ("a", "00:14", 0, "snapshot", "write"), ("a", "00:14", 3, "end", "done"),
        ("b", "02:00", 0, "snapshot", "queued"), ("b", "02:00", 6, "stage", None),
    ]
