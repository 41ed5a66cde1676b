"""Queries over files as they come: lines of PDF pages, main TeX files with their inputs, authors of HTML editions, uploads of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.text import bound
from folio.operators.documents import _date_sql, table

# How far apart lines are, how many pages and characters of a PDF are read, lines that only draw a rule.
LINE_GAP, MOST_PAGES, MOST_CHARS = 3, 40, 120_000
RULE = r"^[-–—_=·.\s]+$"
# Signs behind names, and what stands before a list of them.
NAME_SIGNS, BEFORE_NAMES = r"[†‡*§¶]+\s*", r"(?i)^\s*Authors?\s*[:：]?\s*"
# How long an upload's title may be, where its date is looked for, and how many Chinese characters make a text Chinese.
TITLE_CHARS, DATE_CHARS, LEAST_CHINESE = 80, 1000, 20
CHINESE = "[\u4e00-\u9fff]"
INPUT = r"\\(?:input|include)\{([^}]+)\}"
EDGES = r"^\s+|\s+$"


ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescaped(t: Column) -> Column:
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def lines_in(items: Column) -> Column:
    """The lines of a page within its row: an array of text. items: array of str, y and eol, in order; not empty.

    A line ends before an item that ends it or lies LINE_GAP above or below the last height seen; an end forgets that height. Empty lines
    and rules are none.
    """

    def step(seen: Column, x: Column) -> Column:
        ends = F.coalesce(x["eol"], F.lit(False))
        opens = (seen["item"] < 0) | ends | F.coalesce(F.abs(x["y"] - seen["y"]) > LINE_GAP, F.lit(False))
        return F.struct(F.when(~ends, F.coalesce(x["y"], seen["y"])).alias("y"), (seen["item"] + 1).alias("item"), opens.alias("opens"))

    def cut(items: Column) -> Column:
        first = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("item"), F.lit(False).alias("opens"))
        opening = X.scanned(items, first, step, lambda at: at["opens"])
        strs = F.transform(items, lambda x: F.coalesce(x["str"], F.lit("")))
        line = lambda strs, opening, at, j: F.array_join(F.slice(strs, at["item"] + 1, F.coalesce(F.get(opening, j + 1)["item"], F.size(strs)) - at["item"]), "")
        return bound(strs, lambda strs: bound(opening, lambda opening: F.transform(opening, lambda at, j: line(strs, opening, at, j))))

    lines = F.transform(bound(items, cut), lambda t: F.regexp_replace(F.regexp_replace(t, "[ \t\u00a0]+", " "), EDGES, ""))
    return F.filter(lines, lambda t: (t != "") & ~t.rlike(RULE))


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line (from 1) and text of the lines of PDF pages: doc_id, page and its items as above, one row a page.

    Pages follow while those before have at most MOST_CHARS. Only the lines go through a shuffle.
    """
    # within a generator, as a filter on lines would make them twice
    filled = F.filter(F.array(lines_in(F.col("items"))), lambda lines: F.size(lines) > 0)
    lines = pages.where(F.col("page") <= MOST_PAGES).select("doc_id", "page", F.explode(filled).alias("lines"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 1)
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    read = F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.col("page") - 2
    kept = lines.withColumn("chars", chars).withColumn("read", read).where(F.col("read") <= MOST_CHARS)
    return kept.select("doc_id", "page", F.posexplode("lines").alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))


def pdf_lines(items: DataFrame) -> DataFrame:
    """The same, of items as rows: doc_id, page, item (its order), str, y and eol. Repeated rows are items of their own."""
    item = F.struct("item", F.coalesce("str", F.lit("")).alias("str"), F.col("y").cast("double").alias("y"), "eol")
    return page_lines(items.where(F.col("page") <= MOST_PAGES).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("items")))


def main_tex(files: DataFrame) -> DataFrame:
    """Each archive's main TeX file with the files that it names behind it: paper, main, parts and text.

    files: paper, path and content. The main file is the longest with a start of a document, else the longest (ties: least path).
    A name stands for the longest file whose path ends with it; a name of none is passed over, and one named twice comes twice.
    Files without a paper are left out.
    """
    tex = files.where(F.col("paper").isNotNull() & F.lower("path").endswith(".tex")).withColumn("content", F.coalesce("content", F.lit("")))
    # the greatest of whether a document starts, length and path turned around; contents are joined afterwards, so they don't go through it
    size = F.length("content")
    first = tex.groupBy("paper").agg(F.max(F.struct(F.contains("content", F.lit(r"\begin{document}")).alias("starts"), size.alias("size"))).alias("best"))
    chosen = tex.join(first, "paper").where((F.contains("content", F.lit(r"\begin{document}")) == F.col("best.starts")) & (size == F.col("best.size")))
    main = chosen.groupBy("paper").agg(F.min_by(F.struct("path", "content"), "path").alias("m")).select("paper", F.col("m.path").alias("main"), F.col("m.content").alias("content"))
    named = main.select("paper", "main", F.posexplode(F.regexp_extract_all("content", F.lit(INPUT), F.lit(1))).alias("pos", "name"))
    named = named.withColumn("name", F.trim("name")).withColumn("name", F.when(F.col("name").endswith(".tex"), F.col("name")).otherwise(F.concat("name", F.lit(".tex"))))
    others = tex.select("paper", "path", F.col("content").alias("part"))
    hits = named.join(others, "paper").where((F.col("path") != F.col("main")) & F.col("path").endswith(F.col("name")))
    hit = hits.groupBy("paper", "pos").agg(F.min_by("part", F.struct(-F.length("part"), "path")).alias("part"))
    parts = hit.groupBy("paper").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]).alias("parts"))
    whole = main.join(parts, "paper", "left").withColumn("parts", F.concat(F.array("content"), F.coalesce("parts", F.array().cast("array<string>"))))
    return whole.select("paper", "main", F.size("parts").cast("long").alias("parts"), F.array_join("parts", "\n\n").alias("text"))


def _element(tag: str, name: str) -> str:
    return rf'(?is)<({tag})\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</\1\s*>'


def author_names(html: Column) -> Column:
    """Names of an HTML edition's authors, without notes and signs: those marked as persons, else the whole list. An element ends at the first end tag of its kind."""
    bare = F.regexp_replace(X.text_or_empty(html), r"(?is)<sup\b[^>]*>.*?</sup\s*>", "")
    for note in ("ltx_note", "ltx_sup"):
        bare = F.regexp_replace(bare, _element(r"\w+", note), "")
    line = lambda t: F.regexp_replace(unescaped(F.regexp_replace(t, "(?s)<[^>]*>", "")), r"\s+", " ")
    signs = lambda t: F.trim(F.regexp_replace(t, NAME_SIGNS, ""))
    persons = lambda block: F.filter(F.transform(F.regexp_extract_all(block, F.lit(_element(r"\w+", "ltx_personname")), F.lit(2)), lambda t: signs(line(t))), lambda t: t != "")
    listed = lambda block: signs(F.regexp_replace(line(block), BEFORE_NAMES, ""))
    # each step is bound, or all before it would be done again for each use
    names = lambda block: bound(persons(block), lambda found: F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(listed(block)))
    return bound(F.regexp_extract(bare, _element(r"\w+", "ltx_authors"), 2), names)


def is_chinese(text: Column) -> Column:
    return X.count_matches(X.text_or_empty(text), CHINESE) >= LEAST_CHINESE


def upload(text: Column, filename: Column) -> dict[str, Column]:
    """Title, text on one line, and date of an upload: its title is its first line with words, without heading signs, or its file's name."""
    t = F.replace(X.text_or_empty(text), F.lit("\r\n"), F.lit("\n"))
    first = F.coalesce(F.get(F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != ""), 0), F.lit(""))
    title = F.left(F.coalesce(F.nullif(F.regexp_extract(first, r"^#+\s*(.*)", 1), F.lit("")), first), F.lit(TITLE_CHARS))
    name = F.regexp_replace(filename, r"(?i)\.(md|txt)$", "")
    return {
        "title": F.coalesce(F.nullif(title, F.lit("")), name),
        "text": F.trim(F.regexp_replace(t, r"\s+", " ")),
        "date": X.first_date(F.left(t, F.lit(DATE_CHARS))),
    }


PAGE_ITEMS = 120


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as PDF pages of items: a word each, with heights that change, are missing or stay, and rules."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))

    def item(w: Column, k: Column) -> Column:
        y = F.when(k % 5 > 0, 700 - 4 * (F.floor(k / 7) % 30)).cast("double")
        word = F.when((k % 40 >= 20) & (k % 40 < 33), "--").otherwise(F.concat(w, F.lit(" ")))
        return F.struct(word.alias("str"), y.alias("y"), (k % 11 == 10).alias("eol"))

    def page(words: Column, p: Column) -> Column:
        own = F.slice(words, p * PAGE_ITEMS + 1, F.lit(PAGE_ITEMS))
        return F.struct((p + 1).cast("long").alias("page"), F.transform(own, lambda w, i: item(w, p * PAGE_ITEMS + i)).alias("items"))

    numbers = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PAGE_ITEMS).cast("int"))
    return words.select("doc_id", F.inline(F.transform(numbers, lambda p: page(F.col("words"), p))))


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(pdf_pages(spark, sf_dir)).select("doc_id", "page", "line", F.md5("text").alias("text_md5"))


def tex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as TeX files, five a paper; in two of three papers the third one is the main file and names others."""
    part = F.pmod("doc_id", F.lit(5))
    names = F.lit("\n\\input{p1}\\include{ p3.tex }\\input{none}\\input{p2}")
    text = F.coalesce("text", F.lit(""))
    content = F.when((part == 2) & (F.floor(F.col("doc_id") / 5) % 3 > 0), F.concat(F.lit("\\begin{document}\n"), text, names)).otherwise(F.concat(text, F.when(part == 1, names).otherwise("")))
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("paper"), F.concat(F.lit("src/p"), part, F.when(part == 4, ".cls").otherwise(".tex")).alias("path"), content.alias("content"))


def main_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_tex(tex_files(spark, sf_dir)).select("paper", "main", "parts", F.md5("text").alias("text_md5"))


def edition_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authors of all lines of documents as HTML editions, by marked persons, as a list, or unnamed, a third each."""
    third, words = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(3)), F.split("line", r"\s+")
    noted = lambda i: F.when(i % 8 == 0, F.concat(F.lit("<b>"), i, F.lit('</b><sup>1</sup>† <em class="ltx_note">x</em>'))).otherwise(i.cast("string"))
    persons = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit('<span class="ltx_personname">'), w, F.lit(" "), noted(i), F.lit("</span>"))), "")
    listed = F.concat(F.lit("\n Authors: "), F.array_join(words, " &amp; "), F.lit("<sup>2</sup> ‡ "))
    html = F.when(third == 0, F.concat(F.lit('<div class="ltx_authors">'), persons, F.lit("</div>"))).when(third == 1, F.concat(F.lit('<div class="ltx_authors b">'), listed, F.lit("</div>"))).otherwise("<div>none</div>")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    # bound once, or the markup is made again for each use
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.transform(F.array(html), author_names)[0].alias("authors"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as uploads: some with a heading, some behind empty lines, some empty, some with Chinese words and a date."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    text = F.when(i % 50 == 0, F.lit(" \r\n ")).when(i % 3 == 0, F.concat(F.lit("## "), t)).when(i % 3 == 1, F.concat(F.lit("\r\n  \r\n"), F.replace(t, F.lit("\n"), F.lit("\r\n")))).otherwise(F.concat(F.lit("2024-03 "), t))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.repeat(F.lit("图"), (i % 40).cast("int"))).alias("t"), F.concat(F.lit("note"), i, F.lit(".MD")).alias("name"))
    got = upload(F.col("t"), F.col("name"))
    return rows.select("doc_id", got["title"].alias("title"), F.md5(got["text"]).alias("text_md5"), got["date"].alias("date"), is_chinese(F.col("t")).alias("chinese"))


_FILES = r"""f as (select doc_id // 5 paper, 'src/p' || (doc_id % 5) || case when doc_id % 5 = 4 then '.cls' else '.tex' end path,
    case when doc_id % 5 = 2 and (doc_id // 5) % 3 > 0 then '\begin{document}' || chr(10) || coalesce(text, '') || names when doc_id % 5 = 1 then coalesce(text, '') || names else coalesce(text, '') end content
    from documents, (select chr(10) || '\input{p1}\include{ p3.tex }\input{none}\input{p2}' names)),
  t as (select *, row_number() over (partition by paper order by length(content) desc, path) n from f where ends_with(path, '.tex')),
  m as (select * from t qualify row_number() over (partition by paper order by contains(content, '\begin{document}') desc, n) = 1),
  i as (select paper, path main, unnest(regexp_extract_all(content, '\\(?:input|include)\{([^}]+)\}', 1)) name, unnest(range(len(regexp_extract_all(content, '\\(?:input|include)\{([^}]+)\}')))) pos from m),
  j as (select paper, main, pos, case when ends_with(trim(name), '.tex') then trim(name) else trim(name) || '.tex' end name from i where name is not null),
  h as (select j.paper, pos, arg_min(t.content, n) part from j join t on t.paper = j.paper and t.path <> main and ends_with(t.path, j.name) group by j.paper, pos)"""
_WORDS = r"(select *, string_split_regex(line, '\s+') w from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) pos from documents))"
QUERIES = {f.__name__: f for f in (item_lines, main_files, edition_authors, uploads)}
SQL = {
    "item_lines": rf"""with w as (select doc_id, unnest(string_split(coalesce(text, ''), ' ')) w, unnest(range(len(string_split(coalesce(text, ''), ' ')))) k from documents),
      i as (select doc_id, k // 120 + 1 page, k, case when k % 40 >= 20 and k % 40 < 33 then '--' else w || ' ' end s, case when k % 5 > 0 then 700 - 4 * ((k // 7) % 30) end y, k % 11 = 10 eol from w where k // 120 < {MOST_PAGES}),
      p as (select *, coalesce(count(*) filter (eol) over (partition by doc_id, page order by k rows between unbounded preceding and 1 preceding), 0) part from i),
      l as (select *, last_value(y ignore nulls) over (partition by doc_id, page, part order by k rows between unbounded preceding and 1 preceding) last_y from p),
      g as (select *, count(*) filter (eol or abs(y - last_y) > {LINE_GAP}) over (partition by doc_id, page order by k rows between unbounded preceding and current row) line from l),
      t as (select doc_id, page, line, regexp_replace(regexp_replace(string_agg(s, '' order by k), '[ \t\x{{a0}}]+', ' ', 'g'), '{EDGES}', '', 'g') text from g group by all),
      k as (select * from t where text <> '' and not regexp_matches(text, '{RULE}')),
      z as (select doc_id, page, coalesce(sum(c) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) + page - 2 read from (select doc_id, page, sum(length(text) + 1) c from k group by all))
      select doc_id, page, row_number() over (partition by doc_id, page order by line) as line, md5(text) text_md5 from k join z using (doc_id, page) where read <= {MOST_CHARS}""",
    "main_files": f"with {_FILES} select m.paper, m.path main, count(h.pos)::bigint + 1 parts, md5(m.content || coalesce(string_agg(chr(10) || chr(10) || part, '' order by pos), '')) text_md5 from m left join h using (paper) group by m.paper, m.path, m.content",
    "edition_authors": rf"""select doc_id, pos, case (doc_id + pos) % 3 when 0 then array_to_string(list_transform(w, lambda x, i: trim(regexp_replace(x || ' ' || (i - 1), '{NAME_SIGNS}', '', 'g'))), ', ')
      when 1 then trim(regexp_replace(array_to_string(w, ' & '), '{NAME_SIGNS}', '', 'g')) else '' end authors from {_WORDS}""",
    "uploads": rf"""with a as (select doc_id, case when doc_id % 50 = 0 then ' ' || chr(13) || chr(10) || ' ' when doc_id % 3 = 0 then '## ' || coalesce(text, '') when doc_id % 3 = 1 then chr(13) || chr(10) || '  ' || chr(13) || chr(10) || replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) else '2024-03 ' || coalesce(text, '') end || repeat('图', doc_id % 40) t from documents),
      b as (select *, replace(t, chr(13) || chr(10), chr(10)) u from a),
      c as (select *, list_filter(list_transform(string_split(u, chr(10)), lambda x: regexp_replace(x, '{EDGES}', '', 'g')), lambda x: x <> '')[1] first_, left(u, {DATE_CHARS}) head from b)
      select doc_id, coalesce(nullif(left(coalesce(nullif(regexp_extract(first_, '^#+\s*(.*)', 1), ''), first_), {TITLE_CHARS}), ''), 'note' || doc_id) title, md5(trim(regexp_replace(u, '\s+', ' ', 'g'))) text_md5, {_date_sql("head")} date, len(regexp_extract_all(t, '{CHINESE}')) >= {LEAST_CHINESE} chinese from c""",
}
