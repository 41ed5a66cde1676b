"""Queries over what is taken out of texts: terms, titles, summaries, JSON of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import extracts as X
from folio.operators.documents import quoted, rules_sql, table
from folio.operators.structure import HOLE, _formed, _formed_sql, before_texts, nth, nth_sql

TERMS = ["We use BLEU and RL on Vision Transformer", "在GPU上 The Vision transformer VISION bleu A B Étude Paper Deep Learning", ""]
HEADS = [
    "arXiv:1706.03762v7 [cs.CL] 2 Aug 2023 Attention Is All You Need Ashish Vaswani",
    "递归循环 Transformer Recurrent Looped Transformer Yifan Zhang a@b.c 2024年1月2日 摘要",
    "LARGE MODELS FOR EVERYONE by us",
    "a short piece  and more of it",
    "中文标题 2024-01-02 abstract rest",
    "",
]
TITLES = [("Attention Is All You Need", 10), ("深度学习模型：方法与应用", 7), ("Short", 20), ("Supercalifragilistic", 5), ("  A  b, c", 2), ("", 3)]
SUMMARIES = [
    "## 一句话总结\n 很好的模型。真的！后面\n## 背景\n旧\n### 结果\n好\n\n## 论文链接\nhttps://x.y/z",
    "## 📖 背景\n## 局限与结论\n见 https://github.com/arXiv/html_feedback 和 https://github.com/a/b-c\n链接：https://x.y",
    "text\n\nhttps://x.y/z \n",
    "",
]
#: Answers with JSON in them; the words of a document stand in it or beside it.
ANSWERS = [
    '{"title": "a @@"}',
    'Sure!\n```json\n{"title": "b @@", "list": [1, 2,],}\n```\nDone',
    'Here {"title": "c"} it is @@',
    "List: [1, 2, 3,] end @@",
    "no json, {broken @@",
    "@@",
    '{"title": "d @@"} {"title": "e"}',
    '{"title": "f\ng", "text": "@@"}',
]
#: What isn't a plain word or stop may mean something in JSON.
NO_WORDS = "[^A-Za-z0-9 .]"


def named_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.terms(F.col("text"))).alias("pos", "term"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


def term_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _formed(spark, sf_dir, before_texts(TERMS)).select("id", F.posexplode(X.terms(F.col("text"))).alias("pos", "term"))
    return each.select("id", F.col("pos").cast("long").alias("pos"), "term")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.title(F.col("text")).alias("title"))


def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir, before_texts(HEADS)).select("id", X.title(F.col("text")).alias("title"))


def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents as titles of at most 20 visible characters, and their first two sentences."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_title(t, 20).alias("title"), F.md5(X.first_sentences(t, 2)).alias("lead_md5"), X.code_address(t).alias("code"))


def short_title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all documents behind titles of several kinds, each cut to a length of its own."""
    texts, most = map(list, zip(*TITLES, strict=True))
    rows = _formed(spark, sf_dir, before_texts(texts)).withColumn("most", nth(most, "id"))
    by_most = F.coalesce(*(F.when(F.col("most") == n, X.truncate_title(F.col("text"), n)) for n in sorted(set(most))))
    return rows.select("id", by_most.alias("title"))


def summary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _formed(spark, sf_dir, before_texts(SUMMARIES))
    return rows.select("id", X.with_signs(t).alias("signed"), X.without_link(t).alias("bare"), X.summary_line(t).alias("summary"), X.first_sentences(t, 2).alias("lead"), X.code_address(t).alias("code"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON in answers that hold the words of all documents."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), NO_WORDS, " ")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.replace(nth(ANSWERS), F.lit(HOLE), words).alias("text"))
    found = rows.select("id", X.loose_json(F.col("text")).alias("json"))
    return found.select("id", "json", F.get_json_object("json", "$.title").alias("title"))


def _one_line(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _terms_sql(source: str, key: str) -> str:
    found = " || ".join(f"regexp_extract_all(coalesce(text, ''), {quoted(p)})" for p in (X.ACRONYM, X.TITLED))
    stop = ", ".join(quoted(w) for w in X.NO_TERMS)
    return f"""select {key}, row_number() over (partition by {key} order by first_) - 1 pos, term from (select {key}, k, min(i) first_, arg_min(term, i) term from
      (select {key}, term, i, lower(term) k from (select {key}::bigint {key}, unnest(f) term, unnest(range(len(f))) i from (select {key}, {found} f from {source})))
      where length(k) >= 2 and k not in ({stop}) group by all) qualify pos < {X.MOST_TERMS}"""


def _titles_sql(source: str, key: str) -> str:
    t = rules_sql("coalesce(text, '')", [(p, "") for p in X.BEFORE_TITLE])
    head = rules_sql("string_split_regex(t, " + quoted(X.HEAD_END) + ")[1]", [(p, "") for p in (*X.HEAD_DATES, X.EDGES)])
    cased, upper = (f"nullif(regexp_extract(t, {quoted(p)}, 1), '')" for p in (X.CASED_TITLE, X.UPPER_TITLE))
    return rf"""with a as (select {key}::bigint {key}, regexp_replace({t}, '{X.EDGES}', '', 'g') t from {source}), b as (select *, {head} head from a),
      c as (select *, {_one_line(f"coalesce(nullif(regexp_extract(head, {quoted(X.CHINESE_TITLE)}, 1), ''), head)")} zh from b)
      select {key}, coalesce(case when regexp_matches(head, '[一-鿿]') and length(zh) between 2 and 80 then zh end, {cased}, {upper}, left(coalesce(list_filter(string_split_regex(t, '\s{{2,}}'), lambda s: length(s) > 2 and length(s) < 140)[1], t), 100)) title from c"""


def _short_sql(source: str, key: str, most: str, columns: str = "") -> str:
    """The cut text is grown word by word: its length is that of the longest start with at most `most` visible characters."""
    return rf"""with a as (select *, {_one_line("coalesce(text, '')")} t from {source}),
      b as (select *, case when length(replace(t, ' ', '')) <= {most} then t else left(t, list_min(list_filter(range(1, length(t) + 1), lambda i: length(replace(left(t, i::bigint), ' ', '')) = {most}))::bigint) end cut from (select * from a)),
      c as (select *, case when regexp_matches(substr(t, length(cut) + 1, 1), '[A-Za-z0-9]') and regexp_matches(right(cut, 1), '[A-Za-z0-9]') and contains(cut, ' ') then regexp_replace(cut, ' [^ ]*$', '') else cut end whole from b),
      d as (select *, trim(regexp_replace(trim(whole), '[，,、：:；;！!？?。]+$', '')) bare from c)
      select {key}::bigint {key}, case when cut = t then t when bare <> '' then bare else cut end title{columns} from d"""


def _lead_sql(n: int) -> str:
    parts = r"list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '([。！？!?；;])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"
    return f"trim(array_to_string({parts}[1:{n}], ''))"


_CODE = f"coalesce(list_filter(regexp_extract_all(coalesce(text, ''), {quoted(X.CODE_ADDRESS)}), lambda u: not regexp_matches(u, {quoted(X.NO_CODE)}))[1], '')"
#: DuckDB takes a comma before a closing bracket for valid JSON, which it isn't.
_TIDY = r"regexp_replace(regexp_replace(p, ',\s*([}\]])', '\1', 'g'), '[\x00-\x1f]+', ' ', 'g')"
_ANSWERS = f"(select doc_id id, replace({nth_sql(ANSWERS)}, '{HOLE}', regexp_replace(coalesce(text, ''), '{NO_WORDS}', ' ', 'g')) as text from documents)"
QUERIES = {f.__name__: f for f in (named_terms, term_forms, titles, title_forms, short_titles, short_title_forms, summary_forms, answers)}
SQL = {
    "named_terms": _terms_sql("documents", "doc_id"),
    "term_forms": _terms_sql(_formed_sql(before_texts(TERMS)), "id"),
    "titles": _titles_sql("documents", "doc_id"),
    "title_forms": _titles_sql(_formed_sql(before_texts(HEADS)), "id"),
    "short_titles": _short_sql("documents", "doc_id", "20", f", md5({_lead_sql(2)}) lead_md5, {_CODE} code").replace("range(1, length(t) + 1)", "range(1, least(length(t), 50) + 1)"),
    "short_title_forms": _short_sql(_formed_sql(before_texts([t for t, _ in TITLES]), more=f", {nth_sql([n for _, n in TITLES])} most"), "id", "most").replace("range(1, length(t) + 1)", "range(1, least(length(t), 50) + 1)"),
    "summary_forms": f"""select id::bigint id, {rules_sql("text", [(rf"(#{{2,3}}\s*){name}", f"$1{sign} {name}") for name, sign in X.SIGNS])} signed, regexp_replace({rules_sql("text", [(p, "") for p in X.LINK_ENDS])}, '\\s+$', '') bare,
      trim(regexp_extract(text, {quoted(X.SUMMARY)}, 1)) summary, {_lead_sql(2)} lead, {_CODE} code from {_formed_sql(before_texts(SUMMARIES))}""",
    "answers": rf"""with c as (select id, unnest([t, regexp_replace(regexp_extract(t, '(?i)```(?:json)?\s*([\s\S]*?)```', 1), '{X.EDGES}', '', 'g'), regexp_extract(t, '\{{[\s\S]*\}}'), regexp_extract(t, '\[[\s\S]*\]')]) p, unnest(range(4)) i from (select id, regexp_replace(text, '{X.EDGES}', '', 'g') t from {_ANSWERS})),
      v as (select id, p, 2 * i i from c union all select id, {_TIDY}, 2 * i + 1 from c), f as (select id, arg_min(p, i) j from v where json_valid(p) and not regexp_matches(p, ',\s*[}}\]]') group by id)
      select a.id::bigint id, j as json, case when json_valid(j) then json_extract_string(j, '$.title') end title from {_ANSWERS} a left join f using (id)""",
}
