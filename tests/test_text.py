"""Goldens of the text functions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folio.functions import editing as E
from folio.functions import style as S
from folio.functions import text as X
from folio.operators import documents as D
from folio.operators.editing import warned


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("a\r\n\r\n\r\n\r\nb  c\t\td ", "a\n\nb c d"), (None, ""), (" x \n y", "x\ny")])
def test_normalize(spark, text, want):
    assert value(spark, X.normalize_text(F.lit(text).cast("string"))) == want


def test_numbers_and_tokens(spark):
    assert {"41.8", "3.5"} <= set(value(spark, X.numbers(F.lit("BLEU 41.8，提升 0.92，显存 18.6 GB，3.5 天"))))
    assert value(spark, X.tokens(F.lit("The Graph graph of 模型训练"))) == ["graph", "graph", "模型", "型训", "训练"]


def test_chunks_keep_the_budget_and_the_text(spark):
    text = " ".join(f"Sentence {i} is here. And so on!" for i in range(400)) + "x" * 4000
    pieces = value(spark, X.split_by_budget(F.lit(text), 1600))
    assert all(0 < len(p) <= 1600 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_sentences_keep_digits_that_equal_their_place(spark):
    said = [f"{i} are {i * 111} of {i}!" for i in range(13)]
    assert value(spark, X.sentences(F.lit(" ".join(said)))) == said
    assert value(spark, X.split_by_budget(F.lit("a" * 9 + "! call +1 11"), 10)) == ["a" * 9 + "!", "call +1 11"]


def test_dates_and_rates(spark):
    assert value(spark, X.first_date(F.lit("published 12 Jun 2017"))) == "2017年6月"
    assert [value(spark, X.rate(F.lit(t))) for t in ("+8%", "-10%", "1.2", "x")] == [1.08, 0.9, 1.2, 1.0]
    assert value(spark, X.paper_id(F.lit("https://arxiv.org/abs/1706.03762v7"))) == "1706.03762"


def test_phrases_do_not_overlap(spark):
    counts = {p: value(spark, n) for p, n in X.count_phrases(F.lit("能够被视为"), ["被视为", "能够被"])}
    assert sum(counts.values()) == 1


def test_truncation(spark):
    assert value(spark, X.truncate_at_sentence(F.lit("甲乙。丙丁"), 4)) == "甲乙。"
    assert value(spark, X.truncate_visible(F.lit("a b c d"), 2)) == "a b"


def test_typography(spark):
    assert value(spark, E.typography(F.lit('使用GPU训练"模型"3次'))) == "使用 GPU 训练“模型”3 次"
    assert value(spark, E.typography(F.lit("`中a` \x01 https://a.b/c'd' ```中b```"))) == "`中a` \x01 https://a.b/c‘d’ ```中b```"
    assert value(spark, E.typography(F.lit(None).cast("string"))) == ""


def test_institutions(spark):
    assert value(spark, E.institutions(F.lit("Google Research and Google, Stanford University"))) == "Google Research、Stanford University"
    assert value(spark, E.institutions(F.lit(None).cast("string"))) == ""
    assert value(spark, E.institutions(F.lit("x" * 3000 + " IBM"))) == "" and value(spark, E.institutions(F.lit("x" * 3000 + " IBM"), front=None)) == "IBM"


@pytest.mark.parametrize(
    ("text", "name", "want"),
    [("真正的问题在于，真正关键的是首次做到。", "caution", [("真正", 2), ("首次", 1)]), ("能够被视为", "passive", [("被视为", 1)]), ("更能不仅能", "stock", [("不仅能", 1), ("更能", 1)]), (None, "voice", None)],
)
def test_word_hits(spark, text, name, want):
    if want is None:
        assert value(spark, S.word_hits(F.lit(None).cast("string"), "chatbot")) == []
    else:
        assert sorted(map(tuple, value(spark, S.word_hits(F.lit(text), name)))) == sorted(want)


def test_words_only(spark):
    assert value(spark, S.words_only(F.lit("## Head\n> a **b** [c](d)\n- `e` $x$"))) == "a b c\ne  "  # the rule for quotes takes the empty line before them


def test_warnings_of_a_profile(spark):
    rows = [(1, "真正。"), (2, "真正首次尤其革命。"), (3, "首次。"), (4, "随着赋能闭环抓手。")]
    metrics = D.with_style(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: {(w.rule, w.level) for w in r.warnings} for r in warned(metrics).where("profile = 'deepread'").collect()}
    assert found == {1: set(), 2: {("caution", "info"), ("boundary", "info")}, 3: {("boundary", "info")}, 4: {("stock", "warn")}}


def test_word_hits_as_by_taking_words_in_turn(spark):
    rng = random.Random(3)
    some = [w for words in S.WORD_LISTS.values() for w in words] + list("被认为被视真正的é的 ab\n\x01") + ["SOTA", "state-of-the-", "state-of-the-art", "关键在", "不是"]
    rows = [(i, "".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None)]
    frame = spark.createDataFrame(rows, "id long, t string").withColumn("outside", S.outside_ascii(F.col("t")))
    for r in frame.select("t", *(S.word_hits(F.col("t"), name, o).alias(f"{name}{k}") for name in S.WORD_LISTS for k, o in enumerate((None, F.col("outside"))))).collect():
        for name in S.WORD_LISTS:
            t, hits = r.t or "", []
            for pos, w in enumerate(S.in_order(name)):
                hits += [(-t.count(w), pos, w)] if w in t else []
                t = t if name == S.OVERLAPPING else t.replace(w, "\x01")
            want = [(w, -n) for n, _, w in sorted(hits)]
            assert [list(map(tuple, r[f"{name}{k}"])) for k in (0, 1)] == [want, want]


def test_word_hits_of_long_texts_take_few_passes(spark):
    words = "，".join(words[0] for words in S.WORD_LISTS.values())
    rows = spark.range(0, 64, 1, 4).select(F.concat(F.repeat(F.lit("plain words of it "), 20000), F.lit(words)).alias("t")).cache()
    outside = rows.withColumn("outside", S.outside_ascii(F.col("t")))
    hits = outside.select(*(S.word_hits(F.col("t"), name, F.col("outside")).alias(name) for name in S.WORD_LISTS))
    one = rows.select(F.length(F.regexp_replace("t", "[^a-z]+", "")))

    def seconds(frame):
        took = []
        for _ in range(3):
            began = time.time()
            frame.write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    rows.count()
    assert seconds(hits) < 6 * seconds(one)
