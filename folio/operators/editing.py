"""Queries over edited texts: typography, institutions, and warnings of style by profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import editing as E
from folio.operators import documents
from folio.operators.documents import hits_of, hits_sql, quoted, rules_sql, table
from folio.operators.structure import _formed, _formed_sql, before_texts

TYPOGRAPHY = ['使用GPU训练"模型"3次', "见`GPU训练`与https://example.com/a训练 \"x\"", "```\n\"a\"中b\n``` 'q' ![图a](b\"c\") 中1", ""]
WORDS = [
    "真正的问题在于，真正关键的是首次做到。SOTA 与最强，被认为是被认为",
    "需要被认为是。随着不仅能更能闭环闭环\n\n> ## 标题\n- 希望对你有帮助，见[里程碑](http://a.b)",
    "```\n随着\n```\n## 首次\n$$赋能$$ the best method and ranking",
    "",
]
INSTITUTIONS = ["Google Research and Google, Stanford University", "在google工作 a.b@mit.edu Email: x 北京大学，清华大学 University of Old York", "none", "OpenAI openai IBM Intel Apple"]

# Limits of each profile, and how grave it is to pass them.
PROFILES = {
    "copy": {"paragraph_max": 150, "paragraph_mean": 110, "sentence_mean": 80, "exclaims": 1, "dashes": 2, "stock": 0},
    "deepread": {"paragraph_max": 180, "paragraph_mean": 130, "sentence_mean": 90, "exclaims": 2, "dashes": 3, "stock": 1},
    "podcast": {"paragraph_max": 130, "paragraph_mean": 120, "sentence_mean": 70, "exclaims": 1, "dashes": 2, "stock": 0},
}
LEVELS = {"paragraph_max": "warn", "paragraph_mean": "info", "sentence_mean": "info", "exclaims": "warn", "dashes": "info", "stock": "warn", "caution": "info", "boundary": "info", "voice": "info", "voice_per_1k": "info"}
# Limits that all profiles share, and the least length for which the last one holds.
SHARED = {"caution": 3, "boundary": 0, "voice": 2, "voice_per_1k": 2}
DENSE_FROM = 400


def typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.typography(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("text_md5"))


def typography_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir, before_texts(TYPOGRAPHY)).select("id", E.typography(F.col("text")).alias("text"))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", E.institutions(F.col("text"), front=None).alias("institutions"))


def institution_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir, before_texts(INSTITUTIONS)).select("id", E.institutions(F.col("text")).alias("institutions"))


def word_hit_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(_formed(spark, sf_dir, before_texts(WORDS)), "id")


def warned(metrics: DataFrame) -> DataFrame:
    """doc_id, profile and `warnings` (rule, level, value, bound) of style metrics: one row for each profile, without a shuffle."""

    def rule(name: str, bound: int):
        value = F.when(F.col("chars") >= DENSE_FROM, F.col(name)).otherwise(0.0) if name == "voice_per_1k" else F.col(name).cast("double")
        return F.struct(F.lit(name).alias("rule"), F.lit(LEVELS[name]).alias("level"), value.alias("value"), F.lit(float(bound)).alias("bound"))

    profiles = F.array(*(F.struct(F.lit(p).alias("profile"), F.array(*(rule(*x) for x in (limits | SHARED).items())).alias("rules")) for p, limits in PROFILES.items()))
    each = metrics.select("doc_id", F.explode(profiles).alias("p"))
    return each.select("doc_id", "p.profile", F.filter("p.rules", lambda r: r["value"] > r["bound"]).alias("warnings"))


def style_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warned(documents.style_metrics(spark, sf_dir)).select("doc_id", "profile", F.inline("warnings"))


def style_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many warnings each profile has, and whether none of them is grave."""
    rows = warned(documents.style_metrics(spark, sf_dir))
    return rows.select("doc_id", "profile", F.size("warnings").cast("long").alias("warnings"), (~F.exists("warnings", lambda w: w["level"] == "warn")).alias("ok"))


def _typography_sql(key: str, source: str) -> str:
    bare = rules_sql(f"regexp_replace(t, {quoted(E.PROTECTED)}, chr(1), 'g')", E.TYPOGRAPHY)
    return f"""(select {key}, list_aggregate(list_transform(list_zip(string_split(bare, chr(1)), kept), lambda z: z[1] || coalesce(z[2], '')), 'string_agg', '') t
      from (select {key}, regexp_extract_all(t, {quoted(E.PROTECTED)}) kept, {bare} bare from (select {key}, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') t from {source})))"""


def _institutions_sql(key: str, source: str, front: str) -> str:
    clean = "coalesce(text, '')"
    for pattern in E.CONTACTS:
        clean = f"regexp_replace({clean}, {quoted(pattern)}, ' ', 'g')"
    found = " || ".join(f"regexp_extract_all(t, {quoted(p)})" for p in E.INSTITUTIONS)
    return f"""with f as (select {key}, {found} names from (select {key}, {front.format(t=clean)} t from {source})),
      u as (select {key}, list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i) names from f)
      select {key}::bigint {key}, array_to_string(list_filter(names, lambda x: len(list_filter(names, lambda o: o <> x and contains(lower(o), lower(x)))) = 0)[1:3], '、') institutions from u"""


_LIMITS = "(values " + ", ".join(f"('{p}', '{rule}', '{LEVELS[rule]}', {bound}::double)" for p, limits in PROFILES.items() for rule, bound in (limits | SHARED).items()) + ") l(profile, rule, level, bound)"
_WARNED = f"""with m as ({documents.SQL["style_metrics"]}), v as (unpivot (select doc_id, {", ".join(f"{c}::double {c}" for c in LEVELS if c != "voice_per_1k")}, case when chars >= {DENSE_FROM} then voice_per_1k else 0 end::double voice_per_1k from m) on {", ".join(LEVELS)} into name rule value value),
  w as (select doc_id, profile, rule, level, value, bound from v join {_LIMITS} using (rule))
"""
QUERIES = {f.__name__: f for f in (typography, typography_forms, institutions, institution_forms, word_hit_forms, style_warnings, style_reports)}
SQL = {
    "typography": f"select doc_id, length(t)::bigint chars, md5(t) text_md5 from {_typography_sql('doc_id', 'documents')}",
    "typography_forms": f"select id::bigint id, t as text from {_typography_sql('id', _formed_sql(before_texts(TYPOGRAPHY)))}",
    "institutions": _institutions_sql("doc_id", "documents", "{t}"),
    "institution_forms": _institutions_sql("id", _formed_sql(before_texts(INSTITUTIONS)), f"substr({{t}}, 1, {E.FRONT})"),
    "word_hit_forms": hits_sql(_formed_sql(before_texts(WORDS)), "id"),
    "style_warnings": _WARNED + "select * from w where value > bound",
    "style_reports": _WARNED + "select doc_id, profile, (count(*) filter (value > bound))::bigint warnings, coalesce(not bool_or(value > bound and level = 'warn'), true) ok from w group by all",
}
