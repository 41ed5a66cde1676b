"""What a model is asked, under caps: ordered parts, each cut at its own cap, and all at the budget of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.documents import _date_sql, table

# How many characters of a part are kept.
TEXT_CAP, REVIEW_CAP, EXCERPT_CAP, SCRIPT_CAP, ABSTRACT_CAP = 6000, 4000, 300, 18_000, 1000
AUTHORS_CAP, INSTITUTION_CAP, DATE_CAP, CAPTION_CAP = 200, 120, 40, 200
# What stands before a part, and in place of one that is empty.
AUTHORS, INSTITUTION, DATE, ABSTRACT, BODY = "作者：", "机构：", "时间：", "摘要：", "正文（截断）："
TOPIC, CHECKED, NO_META, NO_FIGURES, NO_TITLE, NO_CAPTION = "主题：", "原文要点（用于核对数字与术语）：\n", "（暂无机构/时间元数据）", "（本文没有可用图片）", "（无）", "无图注"
FIGURE, FIGURE_CAPTION = "- 图片 ", "图注："
#: Budget of a whole prompt in the query.
BUDGET = 5000
FIGURE_EVERY = 7


def capped(text: Column, cap: int) -> Column:
    return F.left(X.text_or_empty(text), F.lit(cap))


def labelled(label: str, text: Column, cap: int) -> Column:
    """A part behind its label; null, and so no part, if there is no text."""
    return F.when(X.text_or_empty(text) != "", F.concat(F.lit(label), capped(text, cap)))


def meta_block(authors: Column, institution: Column, date: Column) -> Column:
    lines = F.array_compact(F.array(labelled(AUTHORS, authors, AUTHORS_CAP), labelled(INSTITUTION, institution, INSTITUTION_CAP), labelled(DATE, date, DATE_CAP)))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(NO_META)


def figure_lines(figures: Column) -> Column:
    """A line for each of figures (structs of num, page and caption)."""
    page = lambda f: F.coalesce(F.concat(F.lit("（第 "), f["page"].cast("string"), F.lit(" 页）")), F.lit(""))
    caption = lambda f: capped(F.regexp_replace(F.coalesce(F.nullif(f["caption"], F.lit("")), F.lit(NO_CAPTION)), r"\s+", " "), CAPTION_CAP)
    lines = F.transform(figures, lambda f: F.concat(F.lit(FIGURE), f["num"].cast("string"), page(f), F.lit(FIGURE_CAPTION), caption(f)))
    return F.when(F.size(figures) > 0, F.array_join(lines, "\n")).otherwise(NO_FIGURES)


def within_budget(parts: list[Column], budget: int) -> Column:
    """Parts that aren't null, a line each, until the budget is used up: the last one is cut, those behind it are left out."""

    def take(state: Column, part: Column) -> Column:
        room = F.greatest(F.lit(budget) - state["used"], F.lit(0))
        kept = F.when(room > 0, F.concat(state["kept"], F.array(F.left(part, room)))).otherwise(state["kept"])
        return F.struct((state["used"] + F.length(part) + 1).alias("used"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    return F.array_join(F.aggregate(F.array_compact(F.array(*parts)), start, take)["kept"], "\n")


def prompts(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """For each row (doc_id, title, authors, institution, date, abstract, figures, text) the prompts for a copy, titles, a review and a script."""
    c = F.col
    title = F.concat(F.lit(TOPIC), F.coalesce(F.nullif(c("title"), F.lit("")), F.lit(NO_TITLE)))
    excerpt = F.coalesce(F.nullif(c("abstract"), F.lit("")), c("text"))
    meta = meta_block(c("authors"), c("institution"), c("date"))
    forms = {
        "copy": [title, meta, F.concat(F.lit(BODY), capped(c("text"), TEXT_CAP))],
        "titles": [title, F.concat(F.lit(ABSTRACT), capped(excerpt, EXCERPT_CAP))],
        "review": [F.concat(F.lit(CHECKED), capped(c("text"), REVIEW_CAP))],
        "script": [title, meta, F.concat(F.lit(ABSTRACT), capped(c("abstract"), ABSTRACT_CAP)), figure_lines(c("figures")), F.concat(F.lit(BODY), capped(c("text"), SCRIPT_CAP))],
    }
    each = [F.struct(F.lit(form).alias("form"), within_budget(parts, budget).alias("prompt")) for form, parts in forms.items()]
    return rows.select("doc_id", F.explode(F.array(*each)).alias("p")).select("doc_id", "p.form", "p.prompt")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as papers: lines one to four are title, authors, institution and abstract, every seventh one is the caption of a figure."""
    lines = F.split(X.text_or_empty(F.col("text")), "\n")
    line = lambda k: F.get(F.col("lines"), F.lit(k))
    figures = F.filter(F.transform("lines", lambda t, i: F.struct(i.alias("num"), F.when(i % 2 == 0, i + 1).alias("page"), t.alias("caption"))), lambda f: f["num"] % FIGURE_EVERY == FIGURE_EVERY - 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", X.text_or_empty(F.col("text")).alias("text"), lines.alias("lines"))
    return docs.select("doc_id", line(0).alias("title"), line(1).alias("authors"), line(2).alias("institution"), X.first_date(F.col("text")).alias("date"), line(3).alias("abstract"), figures.alias("figures"), "text")


def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(materials(spark, sf_dir)).select("doc_id", "form", F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("prompt_md5"))


_LABELLED = "case when coalesce({t}, '') <> '' then '{label}' || left({t}, {cap}) end"
_META = ", ".join(_LABELLED.format(t=t, label=label, cap=cap) for t, label, cap in (("l[2]", AUTHORS, AUTHORS_CAP), ("l[3]", INSTITUTION, INSTITUTION_CAP), ("d", DATE, DATE_CAP)))
_FORMS = {
    "copy": f"[topic, meta, '{BODY}' || left(text, {TEXT_CAP})]",
    "titles": f"[topic, '{ABSTRACT}' || left(coalesce(nullif(l[4], ''), text), {EXCERPT_CAP})]",
    "review": f"['{CHECKED}' || left(text, {REVIEW_CAP})]",
    "script": f"[topic, meta, '{ABSTRACT}' || left(coalesce(l[4], ''), {ABSTRACT_CAP}), figures, '{BODY}' || left(text, {SCRIPT_CAP})]",
}
QUERIES = {"model_prompts": model_prompts}
SQL = {
    "model_prompts": rf"""with a as (select doc_id, coalesce(text, '') text, string_split(coalesce(text, ''), chr(10)) l from documents),
      b as (select *, {_date_sql("text")} d from a),
      f as (select doc_id, string_agg('{FIGURE}' || i || case when i % 2 = 0 then '（第 ' || (i + 1) || ' 页）' else '' end || '{FIGURE_CAPTION}' || left(regexp_replace(coalesce(nullif(c, ''), '{NO_CAPTION}'), '\s+', ' ', 'g'), {CAPTION_CAP}), chr(10) order by i) figures
        from (select doc_id, unnest(l) c, unnest(range(len(l))) i from a) where i % {FIGURE_EVERY} = {FIGURE_EVERY - 1} group by doc_id),
      m as (select b.doc_id, text, l, '{TOPIC}' || coalesce(nullif(l[1], ''), '{NO_TITLE}') topic, coalesce(nullif(array_to_string(list_filter([{_META}], lambda x: x is not null), chr(10)), ''), '{NO_META}') meta, coalesce(figures, '{NO_FIGURES}') figures from b left join f using (doc_id)),
      p as ({" union all ".join(f"select doc_id, '{form}' form, {parts} parts from m" for form, parts in _FORMS.items())}),
      q as (select doc_id, form, unnest(parts) part, unnest(range(len(parts))) k from p),
      r as (select *, {BUDGET} - coalesce(sum(length(part) + 1) over (partition by doc_id, form order by k rows between unbounded preceding and 1 preceding), 0) room from q),
      s as (select doc_id, form, string_agg(left(part, room::bigint), chr(10) order by k) prompt from r where room > 0 group by all)
      select doc_id, form, length(prompt)::bigint chars, md5(prompt) prompt_md5 from s""",
}
