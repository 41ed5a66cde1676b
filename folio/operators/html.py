"""Markdown as HTML with the styles of a theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.documents import quoted, table

# Colours of themes, and elements with their styles.
THEMES = {
    "orange": {"heading": "#E67E22", "accent": "#E67E22", "accentDark": "#B85C0F", "bg": "#FDF3E7", "border": "#F0D9BD"},
    "blue": {"heading": "#0F4C81", "accent": "#0F4C81", "accentDark": "#0A3559", "bg": "#EDF2F8", "border": "#C9D8EA"},
}
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
IMAGE = '<img src="$2" alt="$1" style="max-width:100%;border-radius:6px;display:block;margin:10px 0;" />'
STRONG = '<strong style="color:{accent};">$1</strong>'
CODE = '<code style="background:#f0f0f0;border-radius:4px;padding:1px 6px;font-size:0.9em;">$1</code>'
SHOWN_FORMULA = '<span style="font-family:Menlo,Consolas,monospace;background:#f6f7f8;padding:1px 6px;border-radius:4px;font-size:0.9em;">$1</span>'
FORMULA = '<span style="font-family:Menlo,Consolas,monospace;background:#f6f7f8;padding:1px 4px;border-radius:4px;font-size:0.9em;">$1</span>'
PARAGRAPH = ('<p style="margin:0 0 0.8em;line-height:1.8;">', "</p>")
DRAWING = '<p style="color:#888;font-size:13px;text-align:center;">（图解为 SVG，微信正文不支持内嵌，请在原文 .md 或网页预览中查看）</p>'
LISTING = ('<pre style="background:#f6f7f8;border:1px solid #e5e7eb;border-radius:6px;padding:12px 14px;overflow-x:auto;font-size:13px;line-height:1.6;"><code>', "</code></pre>")
TABLE = ('<table style="border-collapse:collapse;width:100%;margin:12px 0;font-size:14px;"><thead><tr>', "</tr></thead><tbody>", "</tbody></table>")
HEAD_CELL = ('<th style="background:{bg};color:{accentDark};border:1px solid #e0e0e0;padding:6px 10px;text-align:left;font-weight:700;">', "</th>")
CELL = ('<td style="border:1px solid #e0e0e0;padding:6px 10px;">', "</td>")
HEADING_STYLE = ' style="color:{heading};border-bottom:2px solid {border};padding-bottom:6px;margin:1.2em 0 0.6em;">'
LIST_STYLE = ' style="margin:0 0 0.8em;padding-left:1.4em;">'
ITEM = ('<li style="margin:4px 0;">', "</li>")
QUOTE = ('<blockquote style="border-left:4px solid {accent};background:{bg};color:#555;padding:10px 14px;border-radius:0 6px 6px 0;margin:1em 0;">', "</blockquote>")
DEEPEST = 4

# Lines of a heading, an item, a quotation, and a table's separator and edges.
HEADING, BULLET, NUMBER, QUOTED = r"^(#{1,4})\s+(.+)$", r"^[-*]\s+(.+)$", r"^[0-9]+[.)]\s+(.+)$", r"^>\s?(.+)$"
SEPARATOR = r"^\|?(?:\s*:?-{2,}:?\s*\|)*\s*:?-{2,}:?\s*\|?$"
CELL_ENDS = r"^\|?\s*|\s*\|?$"


def _inline_rules(colours: dict[str, str]) -> list[tuple[str, str]]:
    return [
        (r"!\[([^\]]*)\]\(([^)\s]+)\)", IMAGE),
        (r"\*\*([^*]+)\*\*", STRONG.format(**colours)),
        ("`([^`]+)`", CODE),
        (r"\$\$([^$]+?)\$\$", SHOWN_FORMULA),
        (r"\$([^$\n]+?)\$", FORMULA),
    ]


def escaped(t: Column) -> Column:
    for char, entity in ESCAPES:
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def inline(t: Column, colours: dict[str, str]) -> Column:
    t = escaped(t)
    for pattern, by in _inline_rules(colours):
        t = F.regexp_replace(t, pattern, by)
    return t


def _within(parts: tuple[str, str], t: Column, colours: dict[str, str]) -> Column:
    return F.concat(F.lit(parts[0].format(**colours)), t, F.lit(parts[1]))


def line_kinds(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, raw, t: trimmed) with their kind, block, and the list that is open at them and was before (ul, ol or empty).

    A line of three backticks turns a listing on or off. A table is a run of lines that start with a bar, from the first of them before a separator.
    A paragraph goes on with the next line of no other kind, also in a list; a list stays open until an empty line or another kind.
    """
    along = Window.partitionBy("doc_id").orderBy("pos")
    t = F.col("t")
    lines = lines.withColumn("fence", t.startswith("```")).withColumn("n_fence", F.sum(F.col("fence").cast("int")).over(along))
    lines = lines.withColumn("code", F.col("n_fence") % 2 == 1).withColumn("bar", t.startswith("|") & ~F.col("code"))
    heads = F.col("bar") & F.lead("bar", 1, False).over(along) & F.lead(t.rlike(SEPARATOR), 1, False).over(along)
    starts = F.col("bar") & ~F.lag("bar", 1, False).over(along)
    lines = lines.withColumns({"head_at": F.when(heads, F.col("pos")), "run_at": F.when(starts, F.col("pos"))})
    latest = lambda c: F.last(c, ignorenulls=True).over(along)
    in_table = F.col("bar") & F.coalesce(latest("head_at") >= latest("run_at"), F.lit(False))
    kind = F.when(F.col("code"), "code").when(F.col("fence"), "end").when(in_table, "table").when(t == "", "blank")
    for name, pattern in (("h", HEADING), ("ul", BULLET), ("ol", NUMBER), ("quote", QUOTED)):
        kind = kind.when(t.rlike(pattern), name)
    lines = lines.withColumn("kind", kind.otherwise("p"))
    goes_on = (F.col("kind") == F.lag("kind", 1, "").over(along)) & F.col("kind").isin("p", "code", "table") & ~F.col("fence")
    list_now = F.when(F.col("kind").isin("ul", "ol"), F.col("kind")).when(~F.col("kind").isin("p", "end"), "")
    lines = lines.withColumns({"starts": (~goes_on).cast("int"), "list": list_now})
    lines = lines.withColumns({"block": F.sum("starts").over(along), "list": F.coalesce(latest("list"), F.lit(""))})
    return lines.withColumn("before", F.lag("list", 1, "").over(along)).select("doc_id", "pos", "raw", "t", "kind", "block", "list", "before")


def markdown_to_html(rows: DataFrame, theme: str = "orange") -> DataFrame:
    """doc_id and html of Markdown (doc_id, text); an unknown theme is the first. Null text is empty and gives empty HTML.

    doc_id tells rows apart. A separator that starts without a bar makes no table.
    """
    colours = THEMES.get(theme, THEMES["orange"])
    text = F.regexp_replace(X.text_or_empty(F.col("text")), "\r\n?", "\n")
    lines = rows.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "raw")).withColumn("t", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    one = F.sort_array(F.collect_list(F.struct("pos", "raw", "t", "list", "before")))
    blocks = line_kinds(lines).groupBy("doc_id", "block").agg(F.first("kind").alias("kind"), one.alias("l"))
    first, t = F.col("l")[0], F.col("l")[0]["t"]
    texts = F.transform("l", lambda x: x["t"])
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, CELL_ENDS, ""), r"\|"), lambda c: F.trim(c))
    row = lambda line, parts: F.array_join(F.transform(cells(line), lambda c: _within(parts, inline(c, colours), colours)), "")
    body = F.transform(F.slice(texts, 3, F.greatest(F.size("l") - 2, F.lit(0))), lambda line: F.concat(F.lit("<tr>"), row(line, CELL), F.lit("</tr>")))
    level = F.least(F.length(F.regexp_extract(t, HEADING, 1)) + 1, F.lit(DEEPEST)).cast("string")
    listing = F.array_join(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x["raw"]), "\n")
    is_drawing = F.lower(F.trim(F.regexp_replace(t, "^```", ""))) == "svg"
    inner = lambda pattern, k: inline(F.regexp_extract(t, pattern, k), colours)
    html = (
        F.when(F.col("kind") == "p", _within(PARAGRAPH, inline(F.array_join(texts, " "), colours), colours))
        .when(F.col("kind") == "code", F.when(is_drawing, F.lit(DRAWING)).otherwise(_within(LISTING, escaped(listing), colours)))
        .when(F.col("kind") == "table", F.concat(F.lit(TABLE[0]), row(t, HEAD_CELL), F.lit(TABLE[1]), F.array_join(body, ""), F.lit(TABLE[2])))
        .when(F.col("kind") == "h", F.concat(F.lit("<h"), level, F.lit(HEADING_STYLE.format(**colours)), inner(HEADING, 2), F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "ul", _within(ITEM, inner(BULLET, 1), colours))
        .when(F.col("kind") == "ol", _within(ITEM, inner(NUMBER, 1), colours))
        .when(F.col("kind") == "quote", _within(QUOTE, inner(QUOTED, 1), colours))
        .otherwise("")
    )
    changes = first["list"] != first["before"]
    closes = F.when(changes & (first["before"] != ""), F.concat(F.lit("</"), first["before"], F.lit(">"))).otherwise("")
    opens = F.when(changes & (first["list"] != ""), F.concat(F.lit("<"), first["list"], F.lit(LIST_STYLE))).otherwise("")
    made = blocks.select("doc_id", "block", F.concat(closes, opens, html).alias("html"), first["list"].alias("list"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "html"))), lambda x: x["html"]), "")
    whole = made.groupBy("doc_id").agg(parts.alias("html"), F.max_by("list", "block").alias("list"))
    return whole.select("doc_id", F.concat("html", F.when(F.col("list") != "", F.concat(F.lit("</"), "list", F.lit(">"))).otherwise("")).alias("html"))


FORMS = ["# **{}**", "- {}", "* {}", "{}", "12. {}", "2) `{}`", "> {} $x<y$", "```py\n  {}\n```", "| a | **b** |\n|---|:--:|\n| {} | $$c$$ |", "", "{} ![a](b.png)", "| {} |", "```SVG\n{}\n```"]


def _fill(form: str, line: Column) -> Column:
    before, _, after = form.partition("{}")
    return F.concat(F.lit(before), line, F.lit(after)) if "{}" in form else F.lit(form)


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Markdown: each of their lines in a form by its place."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    form = lambda line, i: F.coalesce(*(F.when(F.pmod(F.col("doc_id") + i * 5, F.lit(len(FORMS))) == k, _fill(f, line)) for k, f in enumerate(FORMS)))
    made = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, form), "\n").alias("text"))
    html = markdown_to_html(made)
    return html.select("doc_id", F.length("html").cast("long").alias("chars"), F.md5("html").alias("html_md5"))


def _inline_sql(t: str) -> str:
    for char, entity in ESCAPES:
        t = f"replace({t}, {quoted(char)}, {quoted(entity)})"
    for pattern, by in _inline_rules(THEMES["orange"]):
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    return t


def _in_sql(parts: tuple[str, str], t: str) -> str:
    return f"{quoted(parts[0].format(**THEMES['orange']))} || {t} || {quoted(parts[1])}"


def _row_sql(line: str, parts: tuple[str, str]) -> str:
    return f"array_to_string(list_transform(string_split(regexp_replace({line}, {quoted(CELL_ENDS)}, '', 'g'), '|'), lambda c: {_in_sql(parts, _inline_sql('trim(c)'))}), '')"


def _html_sql() -> str:
    """Lines are taken one after the other, with what is open as state: nothing, a listing, a table."""
    forms = " ".join(f"when {k} then " + " || ".join(quoted(p) for p in f.split("{}")).replace(" || ", " || line || ") for k, f in enumerate(FORMS))
    escaped_code = "code"
    for char, entity in ESCAPES:
        escaped_code = f"replace({escaped_code}, {quoted(char)}, {quoted(entity)})"
    style = HEADING_STYLE.format(**THEMES["orange"])
    level = f"least(length(regexp_extract(t, '{HEADING}', 1)) + 1, {DEEPEST})"
    group = lambda pattern, k: _inline_sql(f"regexp_extract(t, {quoted(pattern)}, {k})")
    return rf"""with recursive a as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) i from documents),
      b as (select doc_id, string_split(string_agg(case (doc_id + i * 5) % {len(FORMS)} {forms} end, chr(10) order by i), chr(10)) ls from a group by doc_id),
      l as (select doc_id, unnest(ls) raw, unnest(range(len(ls))) pos from b),
      m as (select *, regexp_replace(raw, '^\s+|\s+$', '', 'g') t, lead(regexp_replace(raw, '^\s+|\s+$', '', 'g')) over (partition by doc_id order by pos) next from l),
      s as (select doc_id, pos, case when starts_with(t, '```') then 'code' when starts_with(t, '|') and starts_with(next, '|') and regexp_matches(next, '{SEPARATOR}') then 'table' else '' end state, starts_with(t, '```') opens from m where pos = 0
        union all select m.doc_id, m.pos, case when s.state = 'code' then case when starts_with(t, '```') then 'end' else 'code' end when starts_with(t, '```') then 'code' when s.state = 'table' and starts_with(t, '|') then 'table'
          when starts_with(t, '|') and starts_with(next, '|') and regexp_matches(next, '{SEPARATOR}') then 'table' else '' end, s.state <> 'code' and starts_with(t, '```') from s join m on m.doc_id = s.doc_id and m.pos = s.pos + 1),
      k as (select m.*, opens, case when state <> '' then state when t = '' then 'blank' when regexp_matches(t, '{HEADING}') then 'h' when regexp_matches(t, '{BULLET}') then 'ul' when regexp_matches(t, '{NUMBER}') then 'ol' when regexp_matches(t, '{QUOTED}') then 'quote' else 'p' end kind from m join s using (doc_id, pos)),
      o as (select *, coalesce(last_value(case when kind in ('ul', 'ol') then kind when kind not in ('p', 'end') then '' end ignore nulls) over (partition by doc_id order by pos), '') list,
        opens or kind not in ('p', 'code', 'table') or kind <> coalesce(lag(kind) over (partition by doc_id order by pos), '') starts from k),
      g as (select *, coalesce(lag(list) over (partition by doc_id order by pos), '') before_, sum(starts::int) over (partition by doc_id order by pos) block from o),
      h as (select doc_id, block, min(kind) kind, arg_min(list, pos) list, arg_min(before_, pos) before_, arg_min(t, pos) t, list(t order by pos) ts, coalesce(array_to_string((list(raw order by pos))[2:], chr(10)), '') code from g group by all),
      x as (select doc_id, block, list, case when list <> before_ and before_ <> '' then '</' || before_ || '>' else '' end || case when list <> before_ and list <> '' then '<' || list || '{LIST_STYLE}' else '' end ||
        case kind when 'p' then {_in_sql(PARAGRAPH, _inline_sql("array_to_string(ts, ' ')"))}
          when 'code' then case when lower(trim(t[4:])) = 'svg' then '{DRAWING}' else {_in_sql(LISTING, escaped_code)} end
          when 'table' then '{TABLE[0]}' || {_row_sql("t", HEAD_CELL)} || '{TABLE[1]}' || array_to_string(list_transform(ts[3:], lambda line: '<tr>' || {_row_sql("line", CELL)} || '</tr>'), '') || '{TABLE[2]}'
          when 'h' then '<h' || {level} || '{style}' || {group(HEADING, 2)} || '</h' || {level} || '>'
          when 'ul' then {_in_sql(ITEM, group(BULLET, 1))} when 'ol' then {_in_sql(ITEM, group(NUMBER, 1))} when 'quote' then {_in_sql(QUOTE, group(QUOTED, 1))} else '' end html from h),
      z as (select doc_id, string_agg(html, '' order by block) || case when arg_max(list, block) <> '' then '</' || arg_max(list, block) || '>' else '' end html from x group by doc_id)
      select doc_id, length(html)::bigint chars, md5(html) html_md5 from z"""


QUERIES = {"markdown_pages": markdown_pages}
SQL = {"markdown_pages": _html_sql()}
