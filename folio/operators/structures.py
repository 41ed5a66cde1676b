"""One plan for the structure of papers of any source: what is given, else HTML, else TeX, else lines of a PDF, else plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.documents import NORM, TOP_TERMS, _terms_sql, table
from folio.operators.pages import block_lists
from folio.operators.papers import _PAPER, assembled, manuscripts, with_blocks
from folio.operators.structure import BODY
from folio.sources.atom import escaped

#: A structure that is given has so many chunks, or is none.
LEAST_CHUNKS = 3
GIVEN = "chunks array<struct<section_id: string, path: string, type: string, text: string>>"


def branch_of(chunks: Column) -> Column:
    """Which source of a row is used."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) >= LEAST_CHUNKS, "given").when((F.col("kind") == "html") & filled("html"), "html").when(F.col("kind") == "tex", "tex").when(filled("text_lines"), "pdf").otherwise("text")


def structures(rows: DataFrame) -> DataFrame:
    """The chunks of each row of rows (id, kind, text, text_lines, html, structure: JSON), by the one source that is used.

    id, kind (of the source), idx, section_id, path, type, text, numbers and terms. No row meets another, whatever its id; a structure
    that can't be read is none.
    """
    given = F.from_json("structure", GIVEN)["chunks"]
    rows = rows.select(F.col("id").alias("doc_id"), branch_of(given).alias("branch"), F.coalesce("text", F.lit("")).alias("text"), "text_lines", "html", given.alias("chunks"))
    of = lambda name: rows.where(F.col("branch") == name)
    kept = of("given").select("doc_id", F.lit("given").alias("kind"), F.posexplode("chunks").alias("idx", "c"))
    kept = kept.select("doc_id", "kind", F.col("idx").cast("long").alias("idx"), "c.section_id", "c.path", "c.type", "c.text")
    pages = of("html").select("doc_id", "html")
    placed = F.transform("blocks", lambda b, i: F.struct(i.alias("pos"), b["path"].alias("path"), b["type"].alias("type"), b["text"].alias("text")))
    html = block_lists(pages, "doc_id").select("doc_id", F.lit("html").alias("kind"), placed.alias("blocks"))
    texts = rows.where(F.col("branch").isin("tex", "pdf", "text")).select("doc_id", F.col("branch").alias("kind"), F.when(F.col("branch") == "pdf", F.col("text_lines")).otherwise(F.col("text")).alias("text"))
    chunks = assembled(with_blocks(texts).unionByName(html)).unionByName(kept)
    return chunks.select(F.col("doc_id").alias("id"), "kind", "idx", "section_id", "path", "type", "text", X.numbers(F.col("text")).alias("numbers"), X.terms_of(F.col("text"), TOP_TERMS).alias("terms"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as papers of five kinds: with a structure of their lines as chunks, as HTML, TeX, lines of a PDF, and text."""
    fifth, lines = F.pmod("doc_id", F.lit(5)), F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunk = lambda line: F.struct(F.lit("s1").alias("section_id"), F.lit("Given").alias("path"), F.lit("paragraph").alias("type"), line.alias("text"))
    html = F.array_join(F.transform(lines, lambda line, i: F.concat(F.when(i % 4 == 0, F.concat(F.lit("<h2>Part "), i, F.lit("</h2>"))).otherwise(""), F.lit("<p>"), escaped(line), F.lit("</p>"))), "\n")
    plain = docs.where(fifth.isin(0, 1, 4)).select(
        F.col("doc_id").alias("id"), F.when(fifth == 1, "html").otherwise("text").alias("kind"), "text", F.lit(None).cast("string").alias("text_lines"),
        F.when(fifth == 1, html).alias("html"), F.when(fifth == 0, F.to_json(F.struct(F.transform(lines, chunk).alias("chunks")))).alias("structure"),
    )
    none = F.lit(None).cast("string")
    third = manuscripts(spark, sf_dir)  # of kind tex or pdf by another rule, so its rows are chosen by both
    marked = third.where(fifth.isin(2, 3) & F.col("kind").isin("tex", "pdf")).select(F.col("doc_id").alias("id"), "kind", F.when(F.col("kind") == "tex", F.col("text")).alias("text"), F.when(F.col("kind") == "pdf", F.col("text")).alias("text_lines"), none.alias("html"), none.alias("structure"))
    rest = third.where(fifth.isin(2, 3) & (F.col("kind") == "text")).select(F.col("doc_id").alias("id"), "kind", "text", none.alias("text_lines"), none.alias("html"), none.alias("structure"))
    return plain.unionByName(marked).unionByName(rest)


def paper_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structures(sources(spark, sf_dir))
    joined = lambda c: F.array_join(c, " ")
    return rows.select(F.col("id").alias("doc_id"), "kind", "idx", "section_id", "path", "type", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"), F.size("numbers").cast("long").alias("n_numbers"), F.md5(joined("numbers")).alias("numbers_md5"), F.md5(joined("terms")).alias("terms_md5"))


def _sql() -> str:
    lines = "len(string_split(coalesce(text, ''), chr(10)))"
    kind = f"case when doc_id % 5 = 0 and {lines} >= {LEAST_CHUNKS} then 'given' when doc_id % 5 = 1 then 'html' when doc_id % 5 in (0, 4) then 'text' else ['tex', 'pdf', 'text'][doc_id % 3 + 1] end"
    paper = _PAPER.replace("['tex', 'pdf', 'text'][doc_id % 3 + 1] kind", f"{kind} kind").replace("from x where kind <> 'text')", "from x where kind in ('tex', 'pdf'))")
    html = f"""union all select doc_id, kind, pos, path, 'paragraph', text from (select doc_id, kind, i pos, 'Part ' || (i // 4 * 4) path, {NORM.format(t="line")} text from
      (select doc_id, kind, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) i from x where kind = 'html')) where length(text) >= 2"""
    paper = paper.replace(f"union all select doc_id, kind, 0, '{BODY}', null, t from x where kind = 'text')", f"union all select doc_id, kind, 0, '{BODY}', null, t from x where kind = 'text' {html})")
    numbers = r"regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?\s*(?:%|％|万|亿|k|K|M|B|x|×|倍)?')"
    return (
        paper
        + f""", records as (select doc_id, kind, idx::bigint idx, section_id, path, type, text from paper
      union all select doc_id, kind, i, 's1', 'Given', 'paragraph', line from (select doc_id, kind, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) i from x where kind = 'given')),
  ranked as ({_terms_sql("records", "doc_id, idx", TOP_TERMS)}),
  termed as (select doc_id, idx, string_agg(term, ' ' order by rank) terms from ranked group by all),
  counted as (select doc_id, idx, unnest({numbers}) number, unnest(range(len({numbers}))) i from records),
  numbered as (select doc_id, idx, count(*) n, string_agg(number, ' ' order by i) numbers from (select doc_id, idx, regexp_replace(number, '\\s+', '', 'g') number, min(i) i from counted group by all) group by all)
  select doc_id, kind, idx, section_id, path, type, length(text)::bigint chars, md5(text) text_md5, coalesce(n, 0)::bigint n_numbers, md5(coalesce(numbers, '')) numbers_md5, md5(coalesce(terms, '')) terms_md5
  from records left join termed using (doc_id, idx) left join numbered using (doc_id, idx)"""
    )


QUERIES = {"paper_structures": paper_structures}
SQL = {"paper_structures": _sql()}
