"""Resolution by the RFC's own examples, and all links of pages against the standard library; archives; progress of plans."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from folio.functions.addresses import is_picture, resolve
from folio.operators.files import main_tex
from folio.operators.pages import page_links
from folio.sources.archives import listed, pictures, texts
from folio.streaming.progress import BatchProgress, Stages

BASE = "http://a/b/c/d;p?q"
# RFC 3986, sections 5.4.1 and 5.4.2
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_examples_of_the_rfc(spark):
    rows = spark.createDataFrame([(BASE, k) for k in EXAMPLES] + [("http://h", "x/../y"), (None, "x"), ("x", None), ("http://h", "HTTP://i/../j")], "base string, ref string")
    got = [r.x for r in rows.select(resolve(F.col("base"), F.col("ref")).alias("x")).collect()]
    assert dict(zip(EXAMPLES, got, strict=False)) == EXAMPLES
    assert got[len(EXAMPLES) :] == ["http://h/y", "x", None, "HTTP://i/j"]


def test_links_of_pages_against_the_standard_library(spark):
    sf = "/root/testdata/sf0.001"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = page_links(spark, sf).collect()
    assert len(rows) > 100 and len({r.reference[:2] for r in rows}) > 6
    assert [(r.reference, r.address) for r in rows if r.address != urljoin(urls[r.page_id], r.reference)] == []


def test_pictures(spark):
    cases = {"figs/a.png": True, "": False, None: False, "data:image/png;base64,x": False, "/static/x.png": False, "my-Logo.svg": False, "x/icons/a.png": False, "http://h/plot.svg": True}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r.x for r in rows.select(is_picture(F.col("s")).alias("x")).collect()] == list(cases.values())


def test_an_archive_goes_through_main_files(spark, tmp_path):
    root = tmp_path / "archives"
    for paper, files in {"p1": {"main.tex": "\\begin{document}\\input{sec/one}\\end{document}", "sec/one.tex": "One", "figs/b.png": "x", "figs/Ä.png": "x", "figs/a.PNG": "x", "figs/z.png": "x", "notes.txt": "x"}, "p2": {"deep/er/only.tex": "Only é"}}.items():
        for name, content in files.items():
            path = root / paper / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(content)
    files = listed(spark, str(root))
    assert {(r.paper, r.path, r.length) for r in files.select("paper", "path", "length").collect()} >= {("p1", "sec/one.tex", 3), ("p2", "deep/er/only.tex", 7)}
    got = {r.paper: (r.main, r.parts, r.text) for r in main_tex(texts(files)).collect()}
    assert got == {"p1": ("main.tex", 2, "\\begin{document}\\input{sec/one}\\end{document}\n\nOne"), "p2": ("deep/er/only.tex", 1, "Only é")}
    # as readers of names have it: ä beside a, capitals beside small letters
    assert [(r.num, r.name) for r in pictures(files).orderBy("num").collect()] == [(1, "a.PNG"), (2, "Ä.png"), (3, "b.png"), (4, "z.png")]
    assert [r.name for r in pictures(files, 2).orderBy("num").collect()] == ["a.PNG", "Ä.png"]


def test_progress_of_a_plan(spark):
    stages = Stages("run-1")
    rows = stages.through("read", spark.range(100), most=F.max("id"))
    rows = stages.through("kept", rows.where("id % 4 = 0"))
    rows = stages.through("groups", rows.groupBy(F.col("id") % 3).count(), total=F.sum("count"))
    assert len(rows.collect()) == 3
    got = [tuple(r) for r in stages.events(spark).collect()]
    assert got == [("run-1", 0, "read", 100, '{"most": 99}'), ("run-1", 1, "kept", 25, "{}"), ("run-1", 2, "groups", 3, '{"total": 25}')]


def test_progress_of_a_stream(spark, tmp_path):
    for k in range(2):
        spark.range(10 * (k + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = BatchProgress("watched")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("read", F.count(F.lit(1)).alias("rows"))
        query = stream.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        for _ in range(100):
            if len(listener.seen) == 2:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(r.rows for r in listener.events(spark).collect()) == [10, 20]
