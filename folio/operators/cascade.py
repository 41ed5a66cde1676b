"""Searches that fall back: the first source that finds something for a key is used, and why the ones before it weren't is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.documents import table
from folio.operators.search import _ID, _ONE_LINE, feeds, hit_papers, work_papers
from folio.sources import search as S

# Classes of an edition's title and names, and how many names are kept.
TITLE, NAME, MOST_NAMES = r'(?is)<h1[^>]*class="[^"]*ltx_title_document[^"]*"[^>]*>(.*?)</h1>', r'(?s)class="[^"]*ltx_personname[^"]*"[^>]*>(.*?)</', 3
#: Names of the sources in their order.
STEPS = ("backend", "arxiv-api", "openalex", "semanticscholar")
NOTHING = "found nothing"


def cascade(keys: DataFrame, key: str, steps: list[tuple[str, DataFrame, DataFrame | None]]) -> DataFrame:
    """key, source, n_papers, first (the least of them) and reasons for each of keys (distinct).

    steps: name, what it found (key and `paper`, a struct; any number a key) and where it failed (key and `reason`), in order. A step
    that neither found anything nor failed says so. One shuffle by key, of a row a task and key at most: counts, the least paper and a
    reason of each step, so that nothing is collected.
    """
    ranked = []
    for rank, (_, found, failed) in enumerate(steps):
        ranked.append(found.select(F.col(key), F.lit(rank).alias("rank"), F.struct("paper").alias("one"), F.lit(None).cast("string").alias("reason")))
        if failed is not None:
            ranked.append(failed.select(F.col(key), F.lit(rank).alias("rank"), F.lit(None).cast(ranked[0].schema["one"].dataType).alias("one"), F.col("reason")))
    ranked.append(keys.select(F.col(key), F.lit(None).cast("int").alias("rank"), F.lit(None).cast(ranked[0].schema["one"].dataType).alias("one"), F.lit(None).cast("string").alias("reason")))
    rows = reduce(DataFrame.unionByName, ranked)
    has = F.col("one").isNotNull()
    by = rows.groupBy(key).agg(
        F.min(F.when(has, F.col("rank"))).alias("rank"),
        *[F.count_if(has & (F.col("rank") == k)).alias(f"n{k}") for k in range(len(steps))],
        *[F.min(F.when(has & (F.col("rank") == k), F.col("one.paper"))).alias(f"first{k}") for k in range(len(steps))],
        *[F.min(F.when(~has & (F.col("rank") == k), F.col("reason"))).alias(f"reason{k}") for k in range(len(steps))],
    )
    name = F.coalesce(*[F.when(F.col("rank") == k, F.lit(n)) for k, (n, _, _) in enumerate(steps)])
    told = [F.when(F.coalesce(F.col("rank"), F.lit(len(steps))) > k, F.concat(F.lit(f"{n}: "), F.coalesce(F.col(f"reason{k}"), F.lit(NOTHING)))) for k, (n, _, _) in enumerate(steps)]
    pick = lambda c: F.coalesce(*[F.when(F.col("rank") == k, F.col(f"{c}{k}")) for k in range(len(steps))])
    return by.select(key, name.alias("source"), F.coalesce(pick("n"), F.lit(0)).cast("long").alias("n_papers"), pick("first").alias("first"), F.array_compact(F.array(*told)).alias("reasons"))


def edition_meta(html: Column) -> Column:
    """title (the document's heading, else the page's title) and authors (at most MOST_NAMES) of an HTML edition; null without a title."""
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))
    page = X.text_or_empty(html)
    title = F.coalesce(F.nullif(bare(F.regexp_extract(page, TITLE, 1)), F.lit("")), F.nullif(bare(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
    clean = lambda n: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(n, r"<[^>]+>", ""), r"\s*[0-9]+\s*", " "), r"[\s,，、]+$", ""), r"\s+", " "))
    names = F.filter(F.transform(F.regexp_extract_all(page, F.lit(NAME), F.lit(1)), clean), lambda n: n != "")
    return F.when(title.isNotNull(), F.struct(title.alias("title"), F.array_join(F.slice(names, 1, MOST_NAMES), ", ").alias("authors")))


def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a search: its feed through a server that fails for most, or a proxy that not all have, then works and hits of catalogues."""
    i = F.col("doc_id")
    keys = table(spark, sf_dir, "documents").select("doc_id")
    atom = feeds(spark, sf_dir).select("doc_id", F.explode(S.atom_entries(F.col("feed"))).alias("paper"))
    packed = lambda df: df.select("doc_id", F.struct("paper", "title", "published", "authors", "url", "pdf_url").alias("paper"))
    steps = [
        (STEPS[0], atom.where(F.pmod(i, F.lit(4)) == 0), keys.where(F.pmod(i, F.lit(4)) != 0).withColumn("reason", F.concat(F.lit("HTTP 50"), F.pmod(i, F.lit(4))))),
        (STEPS[1], atom.where(F.pmod(i, F.lit(8)) == 1), keys.where(F.pmod(i, F.lit(8)) != 1).withColumn("reason", F.lit("no proxy"))),
        (STEPS[2], packed(work_papers(spark, sf_dir)), None),
        (STEPS[3], packed(hit_papers(spark, sf_dir)), keys.where(F.pmod(i, F.lit(2)) != 0).withColumn("reason", F.lit("HTTP 429"))),
    ]
    found = cascade(keys, "doc_id", steps)
    return found.select("doc_id", "source", "n_papers", "first.paper", F.md5("first.title").alias("title_md5"), F.array_join("reasons", "; ").alias("reasons"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and authors of pages as HTML editions: every other one has the classes, with its first words as names."""
    words = F.split(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), " ")
    names = F.array_join(F.transform(F.slice(words, 1, 5), lambda w: F.concat(F.lit('<span class="x ltx_personname">'), w, F.lit(" 1 , <sup>2</sup></span>"))), "\n")
    edition = F.concat(F.lit('<h1 class="ltx_title ltx_title_document">Of <i>'), F.get(words, F.lit(0)), F.lit("</i>\n all</h1>"), names, F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, edition).otherwise(F.col("html")).alias("html"))
    return rows.select("page_id", edition_meta(F.col("html")).alias("m")).select("page_id", "m.title", "m.authors")


_BARE = r"trim(regexp_replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
QUERIES = {"search_cascade": search_cascade, "page_meta": page_meta}
SQL = {
    "search_cascade": f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) k from documents),
      atom as (select doc_id, {_ID.format(i="doc_id + k")} paper, {_ONE_LINE.format(t="line")} title from l where line is not null and {_ONE_LINE.format(t="line")} <> ''),
      work as (select doc_id, {_ID.format(i="doc_id")} paper, {_ONE_LINE.format(t="text")} title from documents where doc_id % 3 < 2 and text is not null),
      hit as (select doc_id, {_ID.format(i="doc_id")} paper, {_ONE_LINE.format(t="coalesce(text, '')")} title from documents where doc_id % 2 = 0),
      r as (select *, 0 k from atom where doc_id % 4 = 0 union all select *, 1 from atom where doc_id % 8 = 1 union all select *, 2 from work union all select *, 3 from hit),
      b as (select *, min(k) over (partition by doc_id) best from r), c as (select doc_id, k, count(*) n, min((paper, title)) f from b where k = best group by all)
      select d.doc_id, {list(STEPS)}[k + 1] source, coalesce(n, 0)::bigint n_papers, f[1] paper, md5(f[2]) title_md5,
        array_to_string(list_filter([case when coalesce(k, 4) > 0 then '{STEPS[0]}: ' || case when d.doc_id % 4 <> 0 then 'HTTP 50' || (d.doc_id % 4) else '{NOTHING}' end end,
          case when coalesce(k, 4) > 1 then '{STEPS[1]}: ' || case when d.doc_id % 8 <> 1 then 'no proxy' else '{NOTHING}' end end,
          case when coalesce(k, 4) > 2 then '{STEPS[2]}: {NOTHING}' end, case when k is null then '{STEPS[3]}: ' || case when d.doc_id % 2 <> 0 then 'HTTP 429' else '{NOTHING}' end end], lambda x: x is not null), '; ') reasons
      from documents d left join c on c.doc_id = d.doc_id""",
    "page_meta": rf"""with a as (select page_id, {_BARE.format(t="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} title, string_split(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') w from pages)
      select page_id, case when page_id % 2 = 0 then 'Of ' || w[1] || ' all' else nullif(title, '') end title,
        case when page_id % 2 = 0 then array_to_string(list_filter(list_transform(w[1:5], lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x || ' 1 , ', '\s*[0-9]+\s*', ' ', 'g'), '[\s,，、]+$', ''), '\s+', ' ', 'g'))), lambda x: x <> '')[1:{MOST_NAMES}], ', ') else case when title <> '' then '' end end authors from a""",
}
