"""Queries over Markdown, TeX, Chinese words, dates and captions. The shared tables have none of these, so all documents are put into forms of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.text import bound
from folio.operators.documents import NORM, TYPE_SQL, _date_sql, table

SEP, BODY = "›", "正文"
#: Where a form takes the text of a document.
HOLE = "@@"
MARKDOWN = [
    "# Title\n@@\n## 1 Intro\nWe start here.\n### 1.1 Goal\n@@\n#### 1.1.1 Deep\nDetail.\n## 2 Method\n图注：一张图\n$$x = y$$\nThe method.",
    "@@\nJust two lines.",
    "## A\n#### B\n@@\n#### C\nc\n#### D\nd\n## A\nagain",
    "@@",
]
BLOCKS = [r"$$L = @@ \theta_i$$", "图注：@@", "表 2：@@", "@@", "Figure 3 shows @@", "- a\n- b\n- @@", r"\frac{a}{b} and \sum x", "@@\n|a|b|\ny"]
#: Texts, and what stands for dates and rates beside them.
DATES = [("2023年8月发布\n@@", "2026-01-15T00:00@@", "D:20170612101010@@", "+8%"), ("@@ published 12 Jun 2017", "no @@", "x @@", "-10%"), ("on 2017-06, @@", "@@ 1999-12", "@@ D:20201231", "1.2"), ("@@", "@@", "@@", "x")]
TEX = [
    "\\documentclass[11pt]{article}\n  % a note\n\\begin{document}\n\\title{A \\textbf{bold} title}\\begin{abstract}\nShort @@ here.\n\\end{abstract}\n\\section{Intro} % more\nWe use \\emph{it}~\\cite{a,b}, \\citep{c} and \\eqref{d}; 50\\% of it.\n\n\n\n\\subsection*{More}\\label{s}\n\\subsubsection{Most}\n\\paragraph{Point} said",
    "\\begin{figure}[t]\n\\centering\n\\includegraphics[width=2cm]{figs/a.png}\n\\caption{A figure of @x@}\n\\end{figure}\n\\begin{itemize}\n\\item @@\n\\item[b] two {\\small words}\n\\end{itemize}\n\\href{http://a.b/c}{link} and \\url{http://d.e}",
    "\\begin{equation}x=1\\end{equation}\n\\begin{align*}\na &= b \\\\\n\\end{align*}\n\\begin{gather}c\\end{gather}\\begin{eqnarray}d\\end{eqnarray}\n\\[ e = f \\] with \\( g \\) and \\& \\_ \\# \\{ \\} \\\\ \\alpha \\foo*[x]{kept} \\@bar{@@}\\footnote{gone}",
    "@@ 50\\% text %%% gone\n\n% line",
]
PHRASES = ["真正", "首次", "不存在", "能够被", "被视为"]
PHRASE_TEXTS = ["真正的问题在于，@@真正关键的是首次做到。", "能够被视为@@", "@@"]
MARKED = ["## @@\r\n  ### two\r> quote\n  > more\n- item @@\n  * star\n12. ten\n 3) three\n##### five stays\n**bold\nover** and `code` and $x$ and $$y\nz$$ and $ a\nb $ \n", "@@", "  @@  ", "#### @@\n1.no\n-no\n$$@@$$"]

# Rules that make TeX text, in this order. Lines end at LF alone.
TEX_RULES = [
    (r"(?md)^\s*%[^\n]*$", ""),
    (r"(?md)(^|[^\\])%[^\n]*$", "$1"),
    (r"\\(?:sub)+section\*?\{([^{}]*)\}", "\n\n#### $1\n"),
    (r"\\section\*?\{([^{}]*)\}", "\n\n## $1\n"),
    (r"\\paragraph\*?\{([^{}]*)\}", "\n\n**$1**："),
    (r"\\caption\*?\{([^{}]*)\}", "\n图注：$1\n"),
    (r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", "\n\n## 摘要\n$1\n"),
    (r"(?s)\\begin\{(equation|equation\*|align|align\*|gather|gather\*|eqnarray)\}(.*?)\\end\{\1\}", "\n\n\\$$2\\$\n\n"),
    (r"(?s)\\\[(.*?)\\\]", "\n\n\\$$1\\$\n"),
    (r"\\\(([^\n]*?)\\\)", " \\$$1\\$ "),
    (r"\\item\s*", "\n- "),
    (r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}", "（图：$1）"),
    (r"\\href\{([^}]*)\}\{([^}]*)\}", "$2（$1）"),
    (r"\\(?:textbf|textit|emph|texttt|textrm|textsc|textsf|mbox|mathrm|mathbf|mathit|operatorname|url)\s*", ""),
    (r"\\(?:label|ref|eqref|autoref|cite|citep|citet|nocite|bibliography|bibliographystyle|footnote|thanks|vspace|hspace|noindent|centering|small|large|footnotesize|tiny|bigskip|medskip|smallskip|newpage|clearpage|index|protect|makeatletter|makeatother)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", ""),
    (r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", "\n"),
    (r"\\[a-zA-Z@]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1"),
    (r"\\[a-zA-Z@]+\*?(?:\[[^\]]*\])?", " "),
    (r"\\([\\%&_#{}])", "$1"),
    (r"[{}]", ""),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
    (r"^[ \t\n\r\f\x0B\u00a0]+|[ \t\n\r\f\x0B\u00a0]+\z", ""),
]


def nth(values: list, key: str = "doc_id") -> Column:
    """The values in turn, by the key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def nth_sql(values: list, key: str = "doc_id") -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"[{', '.join(map(cell, values))}][{key} % {len(values)} + 1]"


def before_texts(forms: list[str]) -> list[str]:
    """Forms that stand before a text, on lines of their own."""
    return [form + "\n" + HOLE for form in forms]


def _formed(spark: SparkSession, sf_dir: str, forms: list[str], key: str = "id") -> DataFrame:
    """All documents, their whole texts put into the forms in turn."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias(key), filled(forms).alias("text"))


def filled(forms: list[str]) -> Column:
    return F.replace(nth(forms), F.lit(HOLE), F.coalesce("text", F.lit("")))


def _formed_sql(forms: list[str], key: str = "id", more: str = "") -> str:
    return f"(select doc_id {key}, {filled_sql(forms)} as text{more} from documents) v"


def filled_sql(forms: list[str]) -> str:
    return f"replace({nth_sql(forms)}, '{HOLE}', coalesce(text, ''))"


def marked_heading(line: Column) -> tuple[Column, Column]:
    """Level (0: none) and title of a Markdown-like line that is a heading of two to four signs."""
    signs = F.length(F.regexp_extract(line, r"^(#{2,4})\s+.+$", 1))
    return F.when(signs > 0, signs - 1).otherwise(0), F.trim(F.regexp_extract(line, r"^#{2,4}\s+(.+)$", 1))


def stands_alone(line: Column) -> Column:
    """Whether a line is a caption or a formula that is a block of its own."""
    return bound(F.trim(line), lambda t: t.rlike("^图注[:：]") | (t.rlike(r"^\$\$.*\$\$\s*$") & (F.length(t) < 1200)))


def blocks_in(text: Column, heading: Callable[[Column], tuple[Column, Column]], alone: Callable[[Column], Column]) -> Column:
    """The blocks of a text in normal form within its row: an array of pos (its first line), path, type and text.

    A block ends before a heading, and before and behind a line that stands alone. A heading of level d leaves d - 1 of the open
    headings and stands behind those. Only these lines go through the fold; all else is slices of the lines.
    """

    def cut(lines: Column, first: Column, past: Column, path: Column) -> Column:
        body = X.trimmed(F.array_join(F.slice(lines, first + 1, F.greatest(past - first, F.lit(0))), "\n"))
        return F.struct(first.cast("int").alias("pos"), path.alias("path"), body.alias("text"))

    def named(lines: Column) -> Column:
        marks = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), heading(line)[0].alias("level"), alone(line).alias("alone")))
        marks = F.filter(marks, lambda m: (m["level"] > 0) | m["alone"])
        return F.transform(marks, lambda m: F.struct(m["pos"].alias("pos"), m["level"].alias("level"), F.when(m["level"] > 0, heading(F.get(lines, m["pos"]))[1]).alias("title")))

    def placed(lines: Column, marks: Column) -> Column:
        under = lambda open_, m: F.when(m["level"] > 0, F.concat(F.slice(open_, F.lit(1), m["level"] - 1), F.array(m["title"]))).otherwise(open_)
        opened = X.scanned(marks, F.array().cast("array<string>"), under)
        past = lambda i: F.coalesce(F.get(marks, i + 1)["pos"], F.size(lines))
        path = lambda open_: F.when(F.size(open_) == 0, BODY).otherwise(F.array_join(open_, SEP))
        each = F.transform(
            opened,
            lambda open_, i: bound(
                F.struct(F.get(marks, i).alias("m"), path(open_).alias("path")),
                lambda x: F.concat(
                    F.when(x["m"]["level"] == 0, F.array(cut(lines, x["m"]["pos"], x["m"]["pos"] + 1, x["path"]))).otherwise(F.array_repeat(cut(lines, F.lit(0), F.lit(0), F.lit("")), F.lit(0))),
                    F.array(cut(lines, x["m"]["pos"] + 1, past(i), x["path"])),
                ),
            ),
        )
        return F.concat(F.array(cut(lines, F.lit(0), past(F.lit(-1)), F.lit(BODY))), F.flatten(each))

    blocks = bound(F.split(text, "\n"), lambda lines: bound(named(lines), lambda marks: placed(lines, marks)))
    typed = lambda b: F.struct(b["pos"].alias("pos"), b["path"].alias("path"), X.trimmed_type(b["text"]).alias("type"), b["text"].alias("text"))
    return F.transform(F.filter(blocks, lambda b: b["text"] != ""), typed)


def section_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of Markdown-like text under their headings: doc_id, pos, path, type, text. Headings of depth d keep d - 2 of those above.

    Each text is worked on within its row, whatever its doc_id; null is empty and has none.
    """
    clean = rows.select("doc_id", X.normalize_text(F.col("text")).alias("text"))
    blocks = clean.select("doc_id", F.explode(blocks_in(F.col("text"), marked_heading, stands_alone)).alias("b"))
    return blocks.select("doc_id", F.col("b.pos").cast("long").alias("pos"), "b.path", "b.type", "b.text")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_blocks(_formed(spark, sf_dir, MARKDOWN, "doc_id"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by first appearance of their path; one that is entered again goes on."""
    by_path = markdown_blocks(spark, sf_dir).groupBy("doc_id", "path").agg(F.min("pos").alias("first"), F.count("*").cast("long").alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return by_path.select("doc_id", F.concat(F.lit("s"), rank).alias("section_id"), "path", F.size(F.split("path", SEP)).cast("long").alias("level"), "blocks", "chars")


def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir, BLOCKS).select("id", X.block_type(F.col("text")).alias("type"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of all documents with dates in several forms put beside their texts, and rates."""
    texts, isos, pdfs, rates = zip(*DATES, strict=True)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *[filled(list(c)).alias(name) for name, c in (("text", texts), ("iso", isos), ("pdf", pdfs))], nth(list(rates)).alias("rate"))
    return rows.select("id", X.first_date(F.col("text")).alias("found"), X.iso_month(F.col("iso")).alias("iso"), X.pdf_month(F.col("pdf")).alias("pdf"), X.rate(F.col("rate")).alias("rate"))


def tex_text(text: Column) -> Column:
    """TeX as text: headings, captions, lists and formulas keep marks, commands go."""
    text = X.text_or_empty(text)
    for pattern, by in TEX_RULES:
        text = F.regexp_replace(text, pattern, by)
    return text


def tex_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir, TEX).select("id", tex_text(F.col("text")).alias("text"))


def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure's caption by its file's name, or by that without its extension, or the name itself."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    # a third of the captions name the file without its extension, a third with it, and a third are missing
    ref = F.when(i % 3 == 0, F.concat(F.lit("figs/f"), i)).otherwise(F.concat(F.lit("f"), i, F.lit(".png")))
    captions = docs.where(i % 3 < 2).select(F.regexp_extract(ref, "([^/]*)$", 1).alias("ref"), F.col("text").alias("caption"))
    figures = docs.select(i.alias("num"), F.concat(F.lit("figs/f"), i, F.when(i % 3 == 1, ".png").otherwise(".pdf")).alias("path"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = figures.select("num", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    a, b = (captions.select(F.col("ref").alias(k), F.col("caption").alias(c)) for k, c in (("name", "by_name"), ("stem", "by_stem")))
    return rows.join(a, "name", "left").join(b, "stem", "left").select("num", F.coalesce("by_name", "by_stem", "name").alias("caption"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _formed(spark, sf_dir, PHRASE_TEXTS)
    hits = F.array(*(F.struct(F.lit(p).alias("phrase"), n.alias("n")) for p, n in X.count_phrases(F.col("text"), PHRASES)))
    return rows.select("id", F.explode(hits).alias("h")).select("id", "h.phrase", "h.n").where("n > 0")


def plain_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formed(spark, sf_dir, MARKED).select("id", X.plain_markdown(F.col("text")).alias("text"))


_BLOCKS_SQL = f"""with recursive v as (select * from {_formed_sql(MARKDOWN, 'doc_id')}),
  l as (select doc_id, unnest(string_split(n, chr(10))) line, unnest(range(len(string_split(n, chr(10))))) pos from (select doc_id, {NORM.format(t='text')} n from v)),
  m as (select *, length(regexp_extract(line, '^(#{{2,4}})\\s+.+$', 1)) lv, trim(regexp_extract(line, '^#{{2,4}}\\s+(.+)$', 1)) title, regexp_matches(trim(line), '^图注[:：]') or regexp_matches(trim(line), '^\\$\\$.*\\$\\$\\s*$') alone from l),
  r as (select doc_id, pos, case when lv > 0 then [title] else []::varchar[] end st from m where pos = 0
    union all select m.doc_id, m.pos, case when lv > 0 then list_append(r.st[1:least(len(r.st), lv - 2)], title) else r.st end from r join m on m.doc_id = r.doc_id and m.pos = r.pos + 1),
  b as (select m.*, r.st, sum((lv > 0 or alone or coalesce(prev, false))::int) over (partition by doc_id order by pos) block from (select *, lag(alone) over (partition by doc_id order by pos) prev from m) m join r using (doc_id, pos)),
  k as (select doc_id, min(pos)::bigint pos, case when len(first(st)) = 0 then '{BODY}' else array_to_string(first(st), '{SEP}') end path, trim(string_agg(line, chr(10) order by pos)) text from b where lv = 0 group by doc_id, block)
"""


def _steps(t: str, steps: list[tuple[str, str]]) -> str:
    """Rewriting in SQL; a replacement's line feeds are chr(10)."""
    for pattern, by in steps:
        pattern, by = ("'" + x.replace("'", "''") + "'" for x in (pattern, by))
        by = by.replace("\n", "' || chr(10) || '")
        t = f"regexp_replace({t}, {pattern}, {by}, 'g')"
    return t


def _tex_sql() -> str:
    """As in the survey: 1-2 comments, 3 headings, 4-6 paragraphs, captions, abstract, 7-9 formulas, 10-12 lists, pictures and links,
    13-16 commands that go with or without their argument, 17-18 any other command, 19-20 escapes and braces, then blanks. RE2 has no
    look-behind and no references, so each kind of formula is a step."""
    formulas = [(rf"(?s)\\begin\{{{name}\}}(.*?)\\end\{{{name}\}}", "\n\n$\\1$\n\n") for name in ("equation", r"equation\*", "align", r"align\*", "gather", r"gather\*", "eqnarray")]
    style = "textbf textit emph texttt textrm textsc textsf mbox mathrm mathbf mathit operatorname url".split()
    gone = "label ref eqref autoref cite citep citet nocite bibliography bibliographystyle footnote thanks vspace hspace noindent centering small large footnotesize tiny bigskip medskip smallskip newpage clearpage index protect makeatletter makeatother".split()
    steps = [(r"(?m)^\s*%.*$", ""), (r"(?m)(^|[^\\])%.*$", r"\1")]
    steps += [(r"\\(?:sub){1,}section[*]?\{([^{}]*)\}", "\n\n#### \\1\n"), (r"\\section[*]?\{([^{}]*)\}", "\n\n## \\1\n")]
    steps += [(r"\\paragraph[*]?\{([^{}]*)\}", "\n\n**\\1**："), (r"\\caption[*]?\{([^{}]*)\}", "\n图注：\\1\n"), (r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", "\n\n## 摘要\n\\1\n")]
    steps += formulas + [(r"(?s)\\\[(.*?)\\\]", "\n\n$\\1$\n"), (r"\\\((.*?)\\\)", " $\\1$ ")]
    steps += [(r"\\item\s*", "\n- "), (r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}", "（图：\\1）"), (r"\\href\{([^}]*)\}\{([^}]*)\}", "\\2（\\1）")]
    steps += [(rf"\\(?:{'|'.join(style)})\s*", ""), (rf"\\(?:{'|'.join(gone)})[*]?(?:\[[^\]]*\])?(?:\{{[^{{}}]*\}})?", ""), (r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", "\n")]
    steps += [(r"\\[a-zA-Z@]+[*]?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1"), (r"\\[a-zA-Z@]+[*]?(?:\[[^\]]*\])?", " "), (r"\\([\\%&_#{}])", r"\1"), ("[{}]", "")]
    return _steps("text", [*steps, ("[ \t]+", " "), ("\\n{3,}", "\n\n"), (r"^[ \t\n\r\f\v\x{00a0}]+|[ \t\n\r\f\v\x{00a0}]+$", "")])


def _marked_sql() -> str:
    """Line by line: heading of one to four signs, quote, item, number; then bold, code, and two kinds of formulas over the whole."""
    blank = r"[ \t\f\v\x{00a0}]"
    by_line = _steps("line", [(rf"^{blank}*#{{1,4}}{blank}+", ""), (rf"^{blank}*>{blank}?", ""), (rf"^{blank}*[-*]{blank}+", "• "), (rf"^{blank}*[0-9]+[.)]{blank}+", "")])
    lines = f"array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda line: {by_line}), chr(10))"
    return _steps(lines, [(r"\*\*([^*]+)\*\*", r"\1"), ("`([^`]+)`", r"\1"), (r"\$\$([^$]+?)\$\$", r"\1"), (r"\$([^$\n]+?)\$", r"\1"), (r"^[ \t\n\r\f\v\x{00a0}]+|[ \t\n\r\f\v\x{00a0}]+$", "")])


def _phrase_sql() -> str:
    text, out = "text", []
    for p in sorted(PHRASES, key=lambda p: -len(p)):
        out.append(f"select id, '{p}' phrase, ((length({text}) - length(replace({text}, '{p}', ''))) // {len(p)})::bigint n from {_formed_sql(PHRASE_TEXTS)}")
        text = f"replace({text}, '{p}', repeat(chr(1), {len(p)}))"
    return "select * from (" + " union all ".join(out) + ") where n > 0"


_MONTH = "case when regexp_extract({t}, '{p}', 1) = '' then '' else regexp_extract({t}, '{p}', 1)::int || '年' || regexp_extract({t}, '{p}', 2)::int || '月' end"
QUERIES = {f.__name__: f for f in (markdown_blocks, markdown_sections, block_types, date_forms, tex_to_text, figure_captions, phrase_hits, plain_markdown)}
SQL = {
    "markdown_blocks": _BLOCKS_SQL + f"select doc_id::bigint doc_id, pos, path, {TYPE_SQL.format(t='text')} as type, text from k where text <> ''",
    "markdown_sections": _BLOCKS_SQL + f"select doc_id::bigint doc_id, 's' || row_number() over (partition by doc_id order by first_) section_id, path, len(string_split(path, '{SEP}'))::bigint as level, blocks, chars from (select doc_id, path, min(pos) first_, count(*)::bigint blocks, sum(length(text))::bigint chars from k where text <> '' group by all)",
    "block_types": f"select id::bigint id, {TYPE_SQL.format(t='text')} as type from {_formed_sql(BLOCKS)}",
    "date_forms": f"""select id::bigint id, {_date_sql('text')} as found, {_MONTH.format(t='iso', p='([0-9]{4})-([0-9]{2})')} as iso, {_MONTH.format(t='pdf', p='D:([0-9]{4})([0-9]{2})[0-9]{2}')} as pdf,
      case when rate like '%\\%' escape '\\' then 1 + replace(rate, '%', '')::double / 100 when try_cast(rate as double) is not null then rate::double else 1.0 end::double rate from (select doc_id id, {filled_sql([d[0] for d in DATES])} as text, {filled_sql([d[1] for d in DATES])} as iso, {filled_sql([d[2] for d in DATES])} as pdf, {nth_sql([d[3] for d in DATES])} as rate from documents)""",
    "tex_to_text": f"select id::bigint id, {_tex_sql()} as text from {_formed_sql(TEX)}",
    "figure_captions": rf"""with c as (select regexp_extract(ref, '([^/]*)$', 1) ref, caption from (select case when doc_id % 3 = 0 then 'figs/f' || doc_id else 'f' || doc_id || '.png' end ref, text caption from documents where doc_id % 3 < 2)),
      f as (select doc_id num, regexp_extract('figs/f' || doc_id || case when doc_id % 3 = 1 then '.png' else '.pdf' end, '([^/]*)$', 1) name from documents)
      select num::bigint num, coalesce(a.caption, b.caption, name) caption from f left join c a on a.ref = name left join c b on b.ref = regexp_replace(name, '\.[^.]*$', '')""",
    "phrase_hits": "select id::bigint id, phrase, n from (" + _phrase_sql() + ")",
    "plain_markdown": f"select id::bigint id, {_marked_sql()} as text from {_formed_sql(MARKED)}",
}
