"""Blocks under headings, chunks and terms within rows: a plain fold, repeated ids, plans without a shuffle, and very many headings."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.tree import normal
from folio.operators.documents import term_counts
from folio.operators.papers import assembled, plain_heading, with_blocks
from folio.operators.structure import BODY, SEP, section_blocks

LINES = ["## A", "### B b", "#### C", "# D", "##### E", "##F", "图注：x", "$$a$$", "$$b", "words here", "more of it", "", "  ", "## A", "- item"]


def plain_blocks(text):
    """Line by line: the open headings, and the block that is gathered."""
    out, stack, block, start = [], [], [], 0

    def flush():
        joined = "\n".join(block).strip(" \n")
        if joined:
            out.append((start, SEP.join(stack) or BODY, joined))

    for i, line in enumerate(normal(text).split("\n")):
        head = re.fullmatch(r"(#{2,4})\s+(.+)", line)
        if head or line.startswith("图注") or re.fullmatch(r"\$\$.*\$\$", line):
            flush()
            block, start = [], i + 1
            if head:
                stack = stack[: len(head[1]) - 2] + [head[2]]
            else:
                out.append((i, SEP.join(stack) or BODY, line))
        else:
            block.append(line)
    flush()
    return out


def test_blocks_equal_a_plain_fold(spark):
    rng = random.Random(5)
    texts = [None, "", "## A", "图注：x\n图注：y"] + ["\n".join(rng.choice(LINES) for _ in range(rng.choice([1, 3, 12, 40]))) for _ in range(120)]
    texts.append("\n".join(rng.choice(LINES) for _ in range(3 * X.SCAN_GROUP)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in section_blocks(rows).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.path, r.text))
    assert got == {k: plain_blocks(t or "") for k, t in enumerate(texts) if plain_blocks(t or "")}


def test_repeated_ids_and_plans(spark):
    rows = spark.createDataFrame([(1, "tex", "## A\nxx"), (1, "tex", "## C\nzz"), (None, "pdf", "1 Part One\nyy"), (None, None, "ww"), (2, None, None)], "doc_id long, kind string, text string")
    blocks = section_blocks(rows)
    assert sorted((r.path, r.text) for r in blocks.where("doc_id = 1").collect()) == [("A", "xx"), ("C", "zz")]
    chunks = assembled(with_blocks(rows))
    assert sorted((r.idx, r.section_id, r.path, r.text) for r in chunks.collect()) == sorted([(0, "s1", "A", "xx"), (0, "s1", "C", "zz"), (0, "s1", "1 Part One", "yy"), (0, "s1", BODY, "ww")])
    terms = term_counts(rows.selectExpr("doc_id", "'alpha beta alpha' as text"), ["doc_id"], "text")
    assert sorted((r["rank"], r.term, r.n) for r in terms.collect()) == [(1, "alpha", 2)] * 5 + [(2, "beta", 1)] * 5
    for plan in (blocks, chunks, terms):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert section_blocks(rows.limit(0)).count() == assembled(with_blocks(rows.limit(0))).count() == 0


def test_very_many_headings_take_linear_time(spark):
    took = []
    for n in (4_000, 16_000):
        text = "\n".join(f"{'#' * (2 + k % 3)} H{k % 50}\nbody of {k}" for k in range(n))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert section_blocks(rows).count() == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 2


@pytest.mark.parametrize("line, level, title", [(" 2.1 Some Part ", 2, "2.1 Some Part"), ("Results:", 1, "Results"), ("引言", 1, "引言"), ("2 ab", 0, None), ("9 " + "A" * 90, 0, None), ("", 0, None)])
def test_headings_of_plain_text(spark, line, level, title):
    found = plain_heading(F.lit(line))
    got = spark.range(1).select(found[0].alias("level"), found[1].alias("title")).first()
    assert got.level == level and (not level or got.title == title)


def test_states_of_a_fold(spark):
    n = 2 * X.SCAN_GROUP + 3
    rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a"))
    assert rows.select(X.scanned(F.col("a"), F.lit(0), lambda s, x: s + x).alias("s")).first().s == [k * (k + 1) // 2 for k in range(1, n + 1)]
    assert rows.select(X.scanned(F.array().cast("array<int>"), F.lit(0), lambda s, x: s + x).alias("s")).first().s == []


@pytest.mark.parametrize("kind", ["tex", "pdf", "text"])
def test_chunks_of_papers_keep_digits_at_their_end(spark, kind):
    text = "word " * 400 + "is here! call +1 (409) 555-8231"
    rows = spark.createDataFrame([(1, kind, text)], "doc_id long, kind string, text string")
    got = assembled(with_blocks(rows)).orderBy("idx").collect()
    assert len(got) == 2 and got[-1]["text"].endswith("555-8231")
