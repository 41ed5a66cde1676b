"""Queries over papers by the kind of their source: headings, sections and chunks, the best of several editions, and Markdown summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.text import bound
from folio.operators.documents import BUDGET, NORM, TYPE_SQL, chunks_sql, table
from folio.operators.records import SEGMENT, _page_text_sql, page_text
from folio.operators.structure import BODY, SEP, blocks_in, marked_heading, stands_alone

# Headings of plain text, numbered or named, and the longest line that is one.
NUMBERED_HEADING = r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,2})\.?\s+([A-Z][A-Za-z0-9\-图\s]{2,60})$"
NAMED_HEADING = r"^(?i)(abstract|introduction|related work|background|method|methods|approach|model|architecture|experiments?|evaluation|results?|analysis|ablations?|discussion|limitations?|conclusions?|references|appendix|摘要|引言|相关工作|背景|方法|模型|架构|实验|评估|结果|分析|消融|讨论|局限|结论|参考文献|附录)\s*[:：]?$"
HEADING_CHARS = 90
# Least lengths of an edition's text, HTML (more than), TeX and PDF (at least).
LEAST_HTML, LEAST_TEX, LEAST_PDF = 500, 500, 300
# Lines of a summary.
SUMMARY_NO_TITLE, SUMMARY_NO_COPY = "未命名内容", "（解读文案尚未生成：图片已就绪，可先下载；模型可用后在页面点「重新生成文案」补上）"
SUMMARY_TYPES = {"pdf": "论文 PDF", "text": "文章"}
SUMMARY_OTHER_TYPE = "网页"
SUMMARY_FIELDS = ("> 来源：", "> 类型：", "> 原文标题：", "> 机构：", "> 时间：")
SUMMARY_PARTS = ("## 解读文案", "## 备选标题", "## 图片清单")

KINDS = ("tex", "pdf", "text")
NAMES = ("Introduction", "Results:", "相关工作")


def plain_heading(line: Column) -> tuple[Column, Column]:
    """Level (0: none) and title of a line of plain text that is a heading."""
    number, name = lambda s: F.regexp_extract(s, NUMBERED_HEADING, 1), lambda s: F.trim(F.regexp_extract(s, NUMBERED_HEADING, 2))
    numbered = lambda s: (number(s) != "") & (X.count_matches(name(s), "[A-Za-z]") >= 3)
    level = lambda s: F.when(F.length(s) > HEADING_CHARS, 0).when(numbered(s), F.size(F.split(number(s), r"\."))).when(s.rlike(NAMED_HEADING), 1).otherwise(0)
    title = lambda s: F.when(F.length(s) > HEADING_CHARS, None).when(numbered(s), F.concat_ws(" ", number(s), name(s))).when(s.rlike(NAMED_HEADING), F.regexp_replace(s, "[:：]$", ""))
    return bound(X.trimmed(line), level), bound(X.trimmed(line), title)


BLOCKS = "array<struct<pos: int, path: string, type: string, text: string>>"


def with_blocks(rows: DataFrame) -> DataFrame:
    """doc_id, kind and the blocks (pos, path, type and text) of texts: of kind tex under Markdown-like headings, captions and formulas
    alone; of kind pdf under numbered or named headings; of any other kind whole and untyped. A text is worked on within its row."""
    clean = rows.select("doc_id", "kind", X.normalize_text(F.col("text")).alias("text"))
    tex = blocks_in(F.col("text"), marked_heading, stands_alone)
    pdf = blocks_in(F.col("text"), plain_heading, lambda _: F.lit(False))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.lit(BODY).alias("path"), F.lit(None).cast("string").alias("type"), F.col("text").alias("text")))
    none = F.array().cast(BLOCKS)
    blocks = F.when(F.col("text") == "", none).when(F.col("kind") == "tex", tex).when(F.col("kind") == "pdf", pdf).otherwise(whole)
    return clean.select("doc_id", "kind", blocks.alias("blocks"))


def chunks_in(blocks: Column, budget: int = BUDGET) -> Column:
    """Chunks of an array of blocks: section (from 1, by first appearance of its path), path, type and text. Headings are none.

    A block's path is looked for among the different ones of its row.
    """
    clean = F.transform(F.filter(blocks, lambda b: F.coalesce(b["type"], F.lit("")) != "heading"), lambda b: F.struct(b["path"].alias("path"), b["type"].alias("type"), X.normalize_text(b["text"]).alias("text")))
    kind = lambda b, t: F.coalesce(b["type"], bound(X.trimmed(t), X.trimmed_type))

    def numbered(clean: Column, paths: Column) -> Column:
        placed = F.transform(clean, lambda b: F.struct(F.array_position(paths, b["path"]).alias("section"), b.alias("b")))
        piece = lambda p, t: F.struct(p["section"].alias("section"), p["b"]["path"].alias("path"), kind(p["b"], t).alias("type"), t.alias("text"))
        return F.flatten(F.transform(placed, lambda p: F.transform(X.split_clean(p["b"]["text"], budget), lambda t: piece(p, t))))

    filled = F.filter(clean, lambda b: b["text"] != "")
    return bound(filled, lambda c: bound(F.array_distinct(F.transform(c, lambda b: b["path"])), lambda paths: numbered(c, paths)))


def assembled(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Chunks of rows of doc_id, kind and blocks: idx and section_id, path, type and text. No row meets another, whatever its id."""
    chunks = rows.select("doc_id", "kind", F.posexplode(chunks_in(F.col("blocks"), budget)).alias("idx", "c"))
    return chunks.select("doc_id", "kind", F.col("idx").cast("long").alias("idx"), F.concat(F.lit("s"), F.col("c.section")).alias("section_id"), "c.path", "c.type", "c.text")


def sections_of(chunks: DataFrame) -> DataFrame:
    """Sections with their chunks' ids in order, and their characters."""
    ids = F.transform(F.sort_array(F.collect_list("idx")), lambda i: F.concat(F.lit("c"), i + 1))
    by = chunks.groupBy("doc_id", "kind", "section_id", "path").agg(F.array_join(ids, ",").alias("chunk_ids"), F.sum(F.length("text")).cast("long").alias("chars"))
    return by.withColumn("level", F.size(F.split("path", SEP)).cast("long"))


def summaries_of(chunks: DataFrame) -> DataFrame:
    """How many sections, chunks and characters a paper has, as a line and by type of chunk."""
    counts = [F.count_if(F.col("type") == t).cast("long").alias(f"n_{t}") for t in ("formula", "figure", "table", "list", "paragraph")]
    by = chunks.groupBy("doc_id", "kind").agg(F.count_distinct("section_id").alias("sections"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), *counts)
    return by.withColumn("summary", F.format_string("%d 节 / %d chunks / %d 字", "sections", "chunks", "chars")).drop("sections", "chunks", "chars")


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as papers of a kind each, with headings of that kind before every fourth line."""
    depth = lambda i: F.pmod(F.floor(i / 4), F.lit(3)) + 1
    tex = lambda i: F.concat(F.repeat(F.lit("#"), (depth(i) + 1).cast("int")), F.lit(" Part "), i)
    number = lambda i: F.array_join(F.slice(F.array(*(F.lit(str(k)) for k in (7, 2, 1))), F.lit(1), depth(i).cast("int")), ".")
    pdf = lambda i: F.when(i % 8 == 4, F.element_at(F.array(*map(F.lit, NAMES)), depth(i).cast("int"))).otherwise(F.concat(number(i), F.lit(" Part "), i))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    head = lambda i: F.when(F.col("kind") == "tex", tex(i)).otherwise(pdf(i))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 4 == 0, F.concat(head(i), F.lit("\n"), line)).otherwise(line))
    return rows.select("doc_id", "kind", F.when(F.col("kind") == "text", F.col("text")).otherwise(F.array_join(lines, "\n")).alias("text"))


def paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = assembled(with_blocks(manuscripts(spark, sf_dir)))
    return chunks.select("doc_id", "kind", "idx", "section_id", "path", "type", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(assembled(with_blocks(manuscripts(spark, sf_dir))))


def paper_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries_of(assembled(with_blocks(manuscripts(spark, sf_dir))))


def best_edition(rows: DataFrame, key: str) -> DataFrame:
    """The edition of a paper that is used, its text and figures: HTML with enough text, whose figures may come from TeX; else TeX; else PDF; else none.

    rows: key, html_text, html_figures, tex_text, tex_figures, pdf_text; what is missing is null.
    """
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    figures = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    html, tex, pdf = size("html_text") > LEAST_HTML, size("tex_text") >= LEAST_TEX, size("pdf_text") >= LEAST_PDF
    borrowed = tex & (figures("html_figures") == 0) & (figures("tex_figures") > 0)
    kind = F.when(html & borrowed, "html+tex").when(html, "html").when(tex, "tex").when(pdf, "pdf").otherwise("none")
    text = F.when(html, F.col("html_text")).when(tex, F.col("tex_text")).when(pdf, F.col("pdf_text"))
    count = F.when(html & ~borrowed, figures("html_figures")).when((html & borrowed) | (~html & tex), figures("tex_figures")).otherwise(F.lit(0).cast("long"))
    return rows.select(key, kind.alias("edition"), text.alias("text"), count.alias("figures"))


def best_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edition used of each id: pages are its HTML, documents its TeX (full stops of theirs stand for figures), benchmark items its PDF."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), page_text(F.col("html")).alias("html_text"), X.count_matches(F.col("html"), r"(?i)<img\b").alias("html_figures"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("tex_text"), X.count_matches(F.col("text"), r"\.\n").alias("tex_figures"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("pdf_text"))
    found = best_edition(docs.join(pages, "id", "full").join(items, "id", "full"), "id")
    return found.select("id", "edition", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "figures")


def markdown_summary(meta: dict[str, Column], titles: Column, images: Column) -> Column:
    """A result as Markdown. meta: title, url, type, source_title, institution, date, copy; images: structs of name, label, width, height."""
    line = lambda sign, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(sign), c))
    filled = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), otherwise)
    kind = F.coalesce(*(F.when(meta["type"] == k, v) for k, v in SUMMARY_TYPES.items()), F.lit(SUMMARY_OTHER_TYPE))
    source, of_kind, original, institution, date = SUMMARY_FIELDS
    empty = F.lit("")
    head = F.array(
        F.concat(F.lit("# "), filled(meta["title"], filled(meta["source_title"], F.lit(SUMMARY_NO_TITLE)))),
        empty,
        F.concat(F.lit(source), F.coalesce(meta["url"], empty)),
        F.concat(F.lit(of_kind), kind),
        line(original, meta["source_title"]),
        line(institution, meta["institution"]),
        line(date, meta["date"]),
        empty,
        F.lit(SUMMARY_PARTS[0]),
        empty,
        filled(meta["copy"], F.lit(SUMMARY_NO_COPY)),
        empty,
        F.lit(SUMMARY_PARTS[1]),
        empty,
    )
    image = lambda i: F.concat(F.lit("- "), i["name"], F.lit(" — "), i["label"], F.lit("（"), i["width"], F.lit("×"), i["height"], F.lit("）"))
    lines = F.concat(head, F.transform(titles, lambda t: F.concat(F.lit("- "), t)), F.array(empty, F.lit(SUMMARY_PARTS[2]), empty), F.transform(images, image), F.array(empty))
    return F.array_join(lines, "\n")  # what is null is no line


def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's summary: its name, address and text, and its segments as images."""
    name = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("h"), name.alias("name"), page_text(F.col("html")).alias("copy"))
    segments = F.when(F.col("h") > 0, F.sequence(F.lit(0), F.col("h") - 1, F.lit(SEGMENT))).otherwise(F.array().cast("array<int>"))
    images = F.transform(segments, lambda y, i: F.struct(F.concat(F.lpad((i + 1).cast("string"), 3, "0"), F.lit(".png")).alias("name"), F.concat(F.lit("第"), i + 1, F.lit("屏")).alias("label"), F.lit(1080).alias("width"), F.least(F.lit(SEGMENT), F.col("h") - y).alias("height")))
    none = F.lit(None).cast("string")
    meta = {"title": F.col("name"), "url": F.col("url"), "type": F.lit("web"), "source_title": F.col("name"), "institution": none, "date": F.nullif(X.first_date(F.col("copy")), F.lit("")), "copy": F.col("copy")}
    text = markdown_summary(meta, F.array("name"), images)
    return pages.select("page_id", text.alias("t")).select("page_id", F.size(F.split("t", "\n")).cast("long").alias("lines"), F.md5("t").alias("text_md5"))


_TEX_HEAD = "repeat('#', (depth + 1)::int) || ' Part ' || (i - 1)"
_PDF_HEAD = f"case when (i - 1) % 8 = 4 then [{', '.join(repr(n) for n in NAMES)}][depth] else array_to_string(['7', '2', '1'][1:depth], '.') || ' Part ' || (i - 1) end"
_WITH = f"""x as (select doc_id, ['tex', 'pdf', 'text'][doc_id % 3 + 1] kind, coalesce(text, '') t from documents),
  y as (select doc_id, kind, unnest(string_split(t, chr(10))) line, unnest(range(1, len(string_split(t, chr(10))) + 1)) i from x where kind <> 'text'),
  w as (select *, ((i - 1) // 4) % 3 + 1 depth from y),
  v as (select doc_id, kind, string_agg(case when (i - 1) % 4 = 0 then case when kind = 'tex' then {_TEX_HEAD} else {_PDF_HEAD} end || chr(10) || line else line end, chr(10) order by i) text from w group by all),
  n as (select doc_id, kind, {NORM.format(t="text")} t from v),
  l as (select doc_id, kind, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) pos from n),
  s as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') z from l),
  g as (select *, case when kind = 'tex' then greatest(0, length(regexp_extract(line, '^(#{{2,4}})\\s+.+$', 1)) - 1)
      when length(z) <= {HEADING_CHARS} and regexp_extract(z, '{NUMBERED_HEADING}', 1) <> '' and len(regexp_extract_all(regexp_extract(z, '{NUMBERED_HEADING}', 2), '[A-Za-z]')) >= 3 then len(string_split(regexp_extract(z, '{NUMBERED_HEADING}', 1), '.'))
      when length(z) <= {HEADING_CHARS} and regexp_matches(z, '{NAMED_HEADING.replace("^(?i)", "(?i)^")}') then 1 else 0 end lv,
    kind = 'tex' and (regexp_matches(trim(line), '^图注[:：]') or (regexp_matches(trim(line), '^\\$\\$.*\\$\\$\\s*$') and length(trim(line)) < 1200)) alone from s),
  h as (select doc_id, lv, case when kind = 'tex' then trim(regexp_extract(line, '^#{{2,4}}\\s+(.+)$', 1)) when regexp_extract(z, '{NUMBERED_HEADING}', 1) <> '' then regexp_extract(z, '{NUMBERED_HEADING}', 1) || ' ' || trim(regexp_extract(z, '{NUMBERED_HEADING}', 2)) else regexp_replace(z, '[:：]$', '') end title,
    row_number() over (partition by doc_id order by pos) n from g where lv > 0),
  heads(doc_id, n, st) as (select doc_id, n, [title] from h where n = 1 union all select h.doc_id, h.n, list_append(heads.st[1:least(len(heads.st), h.lv - 1)], h.title) from heads join h on h.doc_id = heads.doc_id and h.n = heads.n + 1),
  o as (select *, count(*) filter (lv > 0) over (partition by doc_id order by pos) n, sum((lv > 0 or alone or coalesce(prev, false))::int) over (partition by doc_id order by pos) block from (select *, lag(alone) over (partition by doc_id order by pos) prev from g)),
  e as (select o.doc_id, kind, min(pos) pos, coalesce(array_to_string(any_value(st), '{SEP}'), '{BODY}') path, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') text from o left join heads on heads.doc_id = o.doc_id and heads.n = o.n where lv = 0 group by o.doc_id, kind, block),
  f as (select doc_id, kind, pos, path, {TYPE_SQL.format(t="text")} as type, text from e where text <> '' union all select doc_id, kind, 0, '{BODY}', null, t from x where kind = 'text'),
  u as (select doc_id * 1000000 + pos as doc_id, text from f), """
_PAPER = (
    chunks_sql("u", _WITH)
    + f""", parts as (select f.doc_id, kind, pos, path, coalesce(f.type, {TYPE_SQL.format(t="chunk.text")}) as type, chunk.text, idx part from chunk join f on chunk.doc_id = f.doc_id * 1000000 + pos),
  placed as (select *, min(pos) over (partition by doc_id, path) first_, row_number() over (partition by doc_id order by pos, part) - 1 idx from parts),
  paper as (select *, 's' || dense_rank() over (partition by doc_id order by first_) section_id from placed)
"""
)
_LINES = f"""['# ' || coalesce(nullif(name, ''), '{SUMMARY_NO_TITLE}'), '', '{SUMMARY_FIELDS[0]}' || coalesce(url, ''), '{SUMMARY_FIELDS[1]}{SUMMARY_OTHER_TYPE}', case when name <> '' then '{SUMMARY_FIELDS[2]}' || name end, case when d <> '' then '{SUMMARY_FIELDS[4]}' || d end,
  '', '{SUMMARY_PARTS[0]}', '', coalesce(nullif(x, ''), '{SUMMARY_NO_COPY}'), '', '{SUMMARY_PARTS[1]}', '', '- ' || name, '', '{SUMMARY_PARTS[2]}', ''] || list_transform(range(0, length(html), {SEGMENT}), lambda y: '- ' || lpad((y // {SEGMENT} + 1)::varchar, 3, '0') || '.png — 第' || (y // {SEGMENT} + 1) || '屏（1080×' || least({SEGMENT}, length(html) - y) || '）') || ['']"""


def _summary_sql() -> str:
    from folio.operators.documents import _date_sql

    return rf"""with a as (select *, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) name, {_page_text_sql("html")} x from pages),
      b as (select *, {_date_sql("x")} d from a), c as (select page_id, array_to_string(list_filter({_LINES}, lambda s: s is not null), chr(10)) t from b)
      select page_id, len(string_split(t, chr(10)))::bigint lines, md5(t) text_md5 from c"""


QUERIES = {f.__name__: f for f in (paper_chunks, paper_sections, paper_summaries, best_editions, page_summaries)}
SQL = {
    "paper_chunks": _PAPER + "select doc_id, kind, idx::bigint idx, section_id, path, type, length(text)::bigint chars, md5(text) text_md5 from paper",
    "paper_sections": _PAPER + f"select doc_id, kind, section_id, path, string_agg('c' || (idx + 1), ',' order by idx) chunk_ids, sum(length(text))::bigint chars, len(string_split(path, '{SEP}'))::bigint as level from paper group by doc_id, kind, section_id, path",
    "paper_summaries": _PAPER + f"""select doc_id, kind, count(distinct section_id) || ' 节 / ' || count(*) || ' chunks / ' || sum(length(text)) || ' 字' summary,
      {", ".join(f"(count(*) filter (type = '{t}'))::bigint n_{t}" for t in ("formula", "figure", "table", "list", "paragraph"))} from paper group by doc_id, kind""",
    "best_editions": rf"""with a as (select coalesce(d.doc_id, p.page_id, b.item_id) id, p.html, {_page_text_sql("p.html")} html_text, d.text tex_text, b.text pdf_text, len(regexp_extract_all(coalesce(p.html, ''), '(?i)<img\b')) hf, len(regexp_extract_all(coalesce(d.text, ''), '\.\n')) tf
        from documents d full join pages p on d.doc_id = p.page_id full join benchmark b on b.item_id = coalesce(d.doc_id, p.page_id)),
      c as (select *, coalesce(length(html_text), 0) > {LEAST_HTML} h, coalesce(length(tex_text), 0) >= {LEAST_TEX} x, coalesce(length(pdf_text), 0) >= {LEAST_PDF} f from a)
      select id, case when h and x and hf = 0 and tf > 0 then 'html+tex' when h then 'html' when x then 'tex' when f then 'pdf' else 'none' end edition,
        md5(coalesce(case when h then html_text when x then tex_text when f then pdf_text end, '')) text_md5, (case when h and not (x and hf = 0 and tf > 0) then hf when h or x then tf else 0 end)::bigint figures from c""",
    "page_summaries": _summary_sql(),
}
