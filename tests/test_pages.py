"""Blocks of pages: a fixture read by hand, and the pages table held against an HTML parser."""

import random
import time
from html.parser import HTMLParser

from folio.functions.articles import article, blocks
from folio.functions.tree import VOID, Tree
from folio.operators.pages import articles_of, blocks_of, page_blocks

HTML = """<html><body><nav><p>menu</p></nav><h1>Title</h1><p>Lead <b>one</b> &amp; two<p>Second
<section><h2>1 Intro</h2><div><p>Score <math alttext="41"><mn>41.0</mn><annotation encoding="application/x-tex">41.0</annotation></math> here</p></div>
<h4>Deep</h4><ul><li>a<li2></li><li>b</li></ul><h3>1.2 Less deep</h3><math alttext="x&lt;y"></math>
<figure><img src="a"><figcaption>A plot</figcaption></figure></section>
<h2>Method</h2><figure class="t"><figcaption>Numbers</figcaption><table><tr><td>1</td></tr></table></figure><script>var t="</p>"</script></body></html>"""
WANT = [
    ("正文", "paragraph", "Lead one & two"),
    ("正文", "paragraph", "Second"),
    ("Intro", "heading", "Intro"),
    ("Intro", "paragraph", "Score $41.0$ here"),
    ("Intro", "formula", "$$41.0$$"),
    ("Intro›Deep", "heading", "Deep"),
    ("Intro›Deep", "list", "- a\n- b"),
    ("Intro›Less deep", "heading", "Less deep"),
    ("Intro›Less deep", "formula", "$$x<y$$"),
    ("Intro›Less deep", "figure", "图注：A plot"),
    ("Method", "heading", "Method"),
    ("Method", "figure", "图注：Numbers"),
]


def test_blocks_of_a_page(spark):
    rows = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<h1>only</h1>")], "id long, html string")
    got = blocks_of(rows, "id").orderBy("id", "pos").collect()
    assert [(r.path, r.type, r.text) for r in got] == WANT
    assert [r.pos for r in got] == list(range(len(WANT)))


class Words(HTMLParser):
    """Words in paragraphs, lists and tables outside what is no content."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("nav", "header", "footer", "aside", "script", "style", "noscript"):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skip:
            self.skip.remove(tag)

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_pages_keep_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {}
    for r in blocks_of(pages, "page_id").collect():
        found.setdefault(r.page_id, set()).update(r.text.split())
    for page in pages.collect():
        parser = Words()
        parser.feed(page.html)
        assert found[page.page_id] <= set(parser.words) | {"-"} or len(found[page.page_id] - set(parser.words)) < 0.1 * len(found[page.page_id])
    assert page_blocks(spark, "/root/testdata/sf0.001").columns == ["page_id", "pos", "path", "type", "chars", "text_md5"]


NESTED = """<body><div class=sidebar><p>Buy now, a long enough line of an advertisement, with commas, many.</p></div>
<div id=main><div><h2>One</h2><ul><li>a<ul><li>b<li>c</ul>tail<li>d</ul><ol><li>x</ol>
<table><tr><td>q<table><tr><td>r</td></tr></table><td>s</table>
<section class="ltx_abstract">Short <p>abstract</section><div class="ltx_title_subsection">2.1 By class</div>
<p>Unclosed <b>bold<div>div ends it</div></p> after</div></div></body>"""


def test_kinds_nest_within_themselves():
    got = [(b["path"], b["type"], b["text"]) for b in blocks(NESTED)]
    assert got == [
        ("正文", "paragraph", "Buy now, a long enough line of an advertisement, with commas, many."),
        ("One", "heading", "One"),
        ("One", "list", "- abctail\n- b\n- c\n- d"),
        ("One", "list", "- x"),
        ("One", "table", "qrs"),
        ("One", "abstract", "Short abstract"),
        ("One›By class", "heading", "By class"),
        ("One›By class", "paragraph", "Unclosed bold"),
    ]


class Paths(HTMLParser):
    """For well-formed markup: each text with the elements it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        self.found.append(("/".join(self.open), data))


def well_formed(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.choice(["text", "div", "ul", "span", "section", "table", "br"])
        if kind == "text":
            out.append(rng.choice(["a", " b &amp; c ", "é\n", "1 &lt; 2"]))
        elif kind == "br":
            out.append("<br>")
        elif depth < 6:
            inner = well_formed(rng, depth + 1)
            inner = f"<li>{inner}</li><LI x='>'>{inner}</LI>" if kind == "ul" else f"<tbody><tr><td>{inner}</td></tr></tbody>" if kind == "table" else inner
            out.append(f'<{kind} class="k>{depth}" data-x=1>{inner}</{kind} >')
    return "".join(out)


def test_trees_of_well_formed_markup_against_the_standard_parser():
    rng = random.Random(4)
    for _ in range(300):
        html = well_formed(rng)
        plain, tree = Paths(), Tree(html)
        plain.feed(html)
        plain.close()
        path, found = [], []
        for k in range(1, tree.end[0]):
            while path and k >= tree.end[path[-1]]:
                path.pop()
            if tree.tag[k]:
                path.append(k)
            else:
                found.append(("/".join(tree.tag[p] for p in path), tree.value[k]))
        assert [(p, t) for p, t in found if "/br" not in p] == plain.found


def test_every_tag_soup_gives_a_tree_that_nests():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "x", "<a href='", '"', ">", "<h2>", "</h2>", "<script>", "</script>", "<!--", "-->", "<", "&amp;", "</", "<math>", "<mi/>", "</math>", "<br/>"]
    for _ in range(2000):
        html = "".join(rng.choice(parts) for _ in range(25))
        tree = Tree(html)
        for k in range(1, tree.end[0]):
            assert k < tree.end[k] <= tree.end[0]
        stack = [tree.end[0]]
        for k in range(1, tree.end[0]):
            while k >= stack[-1]:
                stack.pop()
            assert tree.end[k] <= stack[-1]
            stack.append(tree.end[k])
        blocks(html)
        article(html)


def test_time_is_linear_in_odd_markup():
    for part in ("<div>", "<div><p>", "<a href='", "<", "<!--", "</p>", "<table><tr><td>", "<li>"):
        for make in (blocks, article):
            took = []
            for n in (3000, 12000):
                began = time.process_time()
                make(part * n + "x" * 50)
                took.append(time.process_time() - began)
            assert took[1] < 12 * took[0] + 1


def test_articles(spark):
    page = """<html><head><title> Head  title </title><meta name="author" content="Ann &amp; Bo"><meta name="citation_journal_title" content="Journal"><meta name="dc.publisher" content=" Institute ">
    <meta property="article:published_time" content="2024-05-06T07:08:09Z"><meta name="date" content="2020"></head><body><nav><p>Menu, with, many, commas, and words enough to count, if it were content</p></nav>
    <div class="sidebar"><p><a href=x>Links, links, links, links that are long enough to count, but all in links</a></p></div>
    <div class="ad"><p>Buy this, buy that, and buy it all while it lasts, friends.</p></div>
    <article><h1>Own title</h1><p>The first paragraph is long, has commas, and tells a story of some length.</p><div><p>The second one, deeper, does too, and at more length than the others do together.</p></div><p>Short.</p></article></body></html>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, "plain words"), (4, page)], "id long, html string")
    got = {r.id: r for r in articles_of(rows, "id").collect()}
    assert (got[1].title, got[1].byline, got[1].institution, got[1].date) == ("Head title", "Ann & Bo", "Institute", "2024-05-06T07:08:09Z")
    assert got[1].text.startswith("Own title") and got[1].text.endswith("Short.") and "Buy" not in got[1].text and "Links" not in got[1].text
    assert got[1].excerpt.startswith("The first paragraph")
    assert tuple(got[1])[1:] == tuple(got[4])[1:]
    assert (got[2].text, got[3].text) == ("", "plain words")


def test_articles_of_pages_leave_menus_out(spark):
    """On the pages table, whose articles stand in an element of that name: the text is that element's by the standard parser."""

    class Within(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"

        def handle_endtag(self, tag):
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth:
                self.parts.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for page in pages.collect():
        within = Within()
        within.feed(page.html)
        want[page.page_id] = " ".join("".join(within.parts).split())
    got = {r.page_id: r.text for r in articles_of(pages, "page_id").collect()}
    assert sum(got[k] == " ".join(want[k].split()) for k in want) > 0.9 * len(want)
    plan = articles_of(pages, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" not in blocks_of(pages, "page_id")._jdf.queryExecution().executedPlan().toString()
