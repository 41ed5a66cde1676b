"""The dispatch over sources: which one is used, rows that share an id, and terms within a row."""

import json
import random
from collections import Counter

from folio.functions import text as X
from folio.operators.structures import structures

SCHEMA = "id long, kind string, text string, text_lines string, html string, structure string"


def given(n):
    return json.dumps({"chunks": [{"section_id": "s1", "path": "P", "type": "paragraph", "text": f"given {k} of 12%"} for k in range(n)]})


def test_the_source_that_is_used(spark):
    html = "<h1>T</h1><p>lead words</p><h2>One</h2><ul><li>a<ul><li>b</ul></ul><p>some text of one</p>"
    rows = [
        (1, "html", "text", "1 Intro Here\nline", html, given(3)),
        (2, "html", "text", "1 Intro Here\nline", html, given(2)),
        (3, "html", "text here", "1 Introduction\nline of it", "", "no json"),
        (4, "tex", "## Part\nbody of it\n## Other\nmore", "lines", "<p>x y</p>", None),
        (5, "other", "plain text alone", None, "<p>x y</p>", "{}"),
        (6, None, None, None, None, None),
        (7, "html", None, None, "<script>x</script>", None),
    ]
    got = {}
    for r in structures(spark.createDataFrame(rows, SCHEMA)).orderBy("id", "idx").collect():
        got.setdefault(r.id, []).append((r.kind, r.section_id, r.path, r.type, r.text))
    assert [x[4] for x in got[1]] == [f"given {k} of 12%" for k in range(3)] and {x[0] for x in got[1]} == {"given"}
    assert got[2] == [("html", "s1", "正文", "paragraph", "lead words"), ("html", "s2", "One", "list", "- ab\n- b"), ("html", "s2", "One", "paragraph", "some text of one")]
    assert got[3] == [("pdf", "s1", "1 Introduction", "paragraph", "line of it")]
    assert [(x[0], x[2], x[4]) for x in got[4]] == [("tex", "Part", "body of it"), ("tex", "Other", "more")]
    assert got[5] == [("text", "s1", "正文", "paragraph", "plain text alone")]
    assert 6 not in got and 7 not in got


def test_rows_that_share_an_id_stay_apart(spark):
    rows = [(1, "tex", "## A\nxx of a", None, None, None), (1, "tex", "## C\nzz of c", None, None, None), (None, "tex", "## B\nyy of b", None, None, None), (None, "text", "ww", None, None, None)]
    got = sorted((str(r.id), r.idx, r.path, r.text) for r in structures(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect())
    assert got == sorted([("1", 0, "A", "xx of a"), ("1", 0, "C", "zz of c"), ("None", 0, "B", "yy of b"), ("None", 0, "正文", "ww")])
    assert structures(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_and_terms_of_a_chunk(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "the", "of", "zz", "delta9", "混合", "alphabet"]
    texts = [None, "", "the of", "alpha"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    tokens = {r.id: r.t for r in rows.select("id", X.tokens(rows.text).alias("t")).collect()}
    for r in rows.select("id", X.terms_of(rows.text, 4).alias("terms")).collect():
        count, first = Counter(tokens[r.id]), {}
        for k, t in enumerate(tokens[r.id]):
            first.setdefault(t, k)
        assert r.terms == sorted(count, key=lambda t: (-count[t], -len(t), first[t]))[:4]
    one = structures(spark.createDataFrame([(1, "text", "Gains of 3.5 % and 3.5% over 12x", None, None, None)], SCHEMA)).first()
    assert one.numbers == ["3.5%", "12x"] and one.terms == ["gains", "over"]
