"""Queries over results of searches, and scripts of scenes with their pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.documents import table
from folio.sources import search as S

MOST_RESULTS = 60
DAYS = 30
# A script is long enough with so many characters or scenes, and how long its title may be.
TITLE_CHARS = 40


def _day(i: Column) -> Column:
    return F.concat(F.lit("2024-"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.pmod(i, F.lit(28)) + 1).cast("string"), 2, "0"))


def _own_id(i: Column) -> Column:
    digits = F.lpad(F.pmod(i, F.lit(100_000)).cast("string"), 5, "0")
    return F.concat(F.lit("24"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("."), digits)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Atom feeds: an entry for each line, by authors named by its words."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def entry(line: Column, k: Column) -> Column:
        names = F.transform(F.split(line, " "), lambda w: F.concat(F.lit("<author><name>"), w, F.lit("</name></author>")))
        return F.concat(
            F.lit("<entry>\n<id>http://arxiv.org/abs/"), _own_id(F.col("doc_id") + k), F.lit("v"), k + 1, F.lit("</id>\n<published>"), _day(F.col("doc_id")), F.lit("T01:02:03Z</published>\n<title>"), line, F.lit("\n  </title>"), F.array_join(names, "\n"), F.lit("</entry>")
        )

    feed = F.concat(F.lit("<feed><title>all</title>"), F.array_join(F.transform(lines, entry), "\n"), F.lit("</feed>"))
    return table(spark, sf_dir, "documents").select("doc_id", feed.alias("feed"))


def atom_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds(spark, sf_dir).select("doc_id", F.posexplode(S.atom_entries(F.col("feed"))).alias("pos", "p")).select("doc_id", F.col("pos").cast("long").alias("pos"), "p.*")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as works of a catalogue in JSON: a third is named by its DOI, a third by an address, a third not at all."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    third = F.pmod(i, F.lit(3))
    place = lambda a, b: F.struct(a.alias("landing_page_url"), b.alias("pdf_url"))
    work = F.struct(
        F.when(third == 0, F.concat(F.lit("https://doi.org/10.48550/arXiv."), _own_id(i))).otherwise(F.lit("https://doi.org/10.1/x")).alias("doi"),
        F.when(third == 1, F.col("text")).alias("display_name"),
        F.col("text").alias("title"),
        F.when(i % 7 > 0, _day(i)).alias("publication_date"),
        F.array(place(F.lit("https://example.org/a"), none), place(none, F.when(third == 1, F.concat(F.lit("http://arxiv.org/pdf/"), _own_id(i), F.lit("v2"))))).alias("locations"),
        F.transform(F.split("text", " "), lambda w: F.struct(F.struct(w.alias("display_name")).alias("author"))).alias("authorships"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.to_json(work).alias("work"))


def work_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_papers(works(spark, sf_dir), ["doc_id"], S.work_paper(F.col("work")))


def recent_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest papers of each source among its works of the last DAYS before its newest one, or among all if it has none that is recent; MOST_RESULTS at most."""
    papers = S.with_papers(works(spark, sf_dir), ["doc_id", "source"], S.work_paper(F.col("work"))).select("source", "doc_id", "paper", "published")
    return newest_of(papers)


def newest_of(papers: DataFrame) -> DataFrame:
    """source, rank, doc_id, paper and published as above, of rows of source, doc_id, paper and published ('' if it has no date).

    What counts is among the first MOST_RESULTS of a source's rows with a date and of those without. These are made in one pass; the
    newest of all and what follows see only them.
    """
    order = [F.desc("published"), F.desc("doc_id"), F.desc("paper")]
    undated = F.col("published") == ""
    few = papers.withColumn("undated", undated).withColumn("k", F.row_number().over(Window.partitionBy("source", "undated").orderBy(*order))).where(F.col("k") <= MOST_RESULTS)
    since = F.date_format(F.date_sub(F.max("published").try_cast("date"), DAYS), "yyyy-MM-dd")
    marked = few.crossJoin(F.broadcast(few.agg(since.alias("since")))).withColumn("recent", F.coalesce(S.recent_or_any(F.col("published"), F.col("since")), F.lit(False)))
    kept = marked.withColumn("any", F.max("recent").over(Window.partitionBy("source"))).where("recent or not any")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= MOST_RESULTS).select("source", "rank", "doc_id", "paper", "published")


def hit_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    names = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("name")))
    hit = F.struct(F.col("text").alias("title"), F.when(i % 5 > 0, _day(i)).alias("publicationDate"), names.alias("authors"), F.struct(F.when(i % 2 == 0, F.concat(_own_id(i), F.lit("v1"))).alias("ArXiv")).alias("externalIds"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(hit).alias("hit"))
    return S.with_papers(rows, ["doc_id"], S.hit_paper(F.col("hit")))


def checked_scenes(scenes: DataFrame, figures: DataFrame) -> DataFrame:
    """Scenes with words, numbered anew, whose figure is null unless it is there. scenes: conv_id, turn, narration and figure; figures: conv_id and num."""
    told = scenes.withColumn("narration", F.trim(F.coalesce("narration", F.lit("")))).where("narration <> ''")
    there = figures.select("conv_id", F.col("num").alias("figure")).distinct().withColumn("_there", F.lit(True))
    joined = told.join(there, ["conv_id", "figure"], "left")
    order = Window.partitionBy("conv_id").orderBy("turn")
    return joined.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "narration", F.when(F.col("_there"), F.col("figure")).alias("figure"))


def visuals(scenes: DataFrame, pages: DataFrame) -> DataFrame:
    """The picture of each scene: a title, its figure, a page by place, its words, or an end. pages: conv_id and pages, how many there are."""
    last = Window.partitionBy("conv_id")
    rows = scenes.withColumn("_last", F.max("pos").over(last)).join(pages, "conv_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    kind = F.when(F.col("pos") == 0, "title").when((F.col("pos") == F.col("_last")) & F.col("figure").isNull(), "end").when(F.col("figure").isNotNull(), "figure").when(F.col("pages") > 0, "page").otherwise("words")
    page = F.when(kind == "page", F.least(F.col("pos") - 1, F.col("pages") - 1))
    return rows.select("conv_id", "pos", kind.alias("kind"), "figure", page.cast("long").alias("page"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as scenes that ask for the figure of their turn; the user's turns have figures; every third conversation has pages."""
    rows = table(spark, sf_dir, "conversations")
    scenes = rows.select("conv_id", "turn", F.col("text").alias("narration"), F.when(F.col("turn") % 3 < 2, F.col("turn")).alias("figure"))
    figures = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("num"))
    return scenes, figures, rows.where("conv_id % 3 = 0").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("pages"))


def scene_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes, figures, pages = _parts(spark, sf_dir)
    return visuals(checked_scenes(scenes, figures), pages)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each script's title, scenes, figures and characters; one without scenes is none."""
    scenes, figures, _ = _parts(spark, sf_dir)
    by = checked_scenes(scenes, figures).groupBy("conv_id").agg(
        F.min_by("narration", "pos").alias("first"),
        F.count("*").cast("long").alias("scenes"),
        F.count("figure").cast("long").alias("with_figure"),
        F.sum(X.count_matches(F.col("narration"), "[一-鿿]")).cast("long").alias("chinese"),
        F.sum(F.length("narration")).cast("long").alias("chars"),
    )
    return by.select("conv_id", F.md5(F.left("first", F.lit(TITLE_CHARS))).alias("title_md5"), "scenes", "with_figure", "chinese", "chars")


_ID = "'24' || lpad((({i}) % 12 + 1)::varchar, 2, '0') || '.' || lpad((({i}) % 100000)::varchar, 5, '0')"
_DAY = "'2024-' || lpad((({i}) % 12 + 1)::varchar, 2, '0') || '-' || lpad((({i}) % 28 + 1)::varchar, 2, '0')"
_ONE_LINE = r"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
_URLS = f"'{S.ABSTRACT}' || paper url, '{S.PDF}' || paper pdf_url"
_AUTHORS = f"array_to_string(list_filter(string_split({{t}}, ' '), lambda w: w <> '')[1:{S.MOST_AUTHORS}], ', ')"
_WORKS = f"""works as (select doc_id, source, {_ID.format(i="doc_id")} paper, {_ONE_LINE.format(t="text")} title, case when doc_id % 7 > 0 then {_DAY.format(i="doc_id")} else '' end published, {_AUTHORS.format(t="text")} authors
  from documents where doc_id % 3 < 2 and text is not null)"""
_SCENES = """a as (select conv_id, turn, trim(coalesce(text, '')) narration, case when turn % 3 < 2 then turn end fig from conversations where trim(coalesce(text, '')) <> ''),
  b as (select a.conv_id, row_number() over (partition by a.conv_id order by turn) - 1 pos, narration, case when exists (select 1 from conversations f where f.conv_id = a.conv_id and f.turn = a.fig and f.role = 'user') then fig end figure from a)"""
QUERIES = {f.__name__: f for f in (atom_papers, work_papers, recent_papers, hit_papers, scene_visuals, scripts)}
SQL = {
    "atom_papers": f"""with a as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) k from documents),
      b as (select doc_id, k, line, {_ID.format(i="doc_id + k")} paper, {_ONE_LINE.format(t="line")} title, {_DAY.format(i="doc_id")} published, {_AUTHORS.format(t="line")} authors from a where line is not null)
      select doc_id, row_number() over (partition by doc_id order by k) - 1 pos, paper, title, published, authors, {_URLS} from b where title <> ''""",
    "work_papers": f"with {_WORKS} select doc_id, paper, title, published, authors, {_URLS} from works",
    "recent_papers": f"""with {_WORKS}, m as (select *, published = '' or published >= strftime((select max(published) from works)::date - interval {DAYS} day, '%Y-%m-%d') recent from works),
      n as (select *, bool_or(recent) over (partition by source) any_ from m)
      select source, rank, doc_id, paper, published from (select *, row_number() over (partition by source order by published desc, doc_id desc) rank from n where recent or not any_) where rank <= {MOST_RESULTS}""",
    "hit_papers": f"""with a as (select doc_id, {_ID.format(i="doc_id")} paper, {_ONE_LINE.format(t="coalesce(text, '')")} title, case when doc_id % 5 > 0 then {_DAY.format(i="doc_id")} else '' end published, {_AUTHORS.format(t="coalesce(text, '')")} authors from documents where doc_id % 2 = 0)
      select doc_id, paper, title, published, authors, {_URLS} from a""",
    "scene_visuals": f"""with {_SCENES}, p as (select conv_id, count(*) filter (role = 'assistant') pages from conversations where conv_id % 3 = 0 group by conv_id),
      c as (select b.*, max(pos) over (partition by b.conv_id) last_, coalesce(pages, 0) pages from b left join p using (conv_id)),
      d as (select *, case when pos = 0 then 'title' when pos = last_ and figure is null then 'end' when figure is not null then 'figure' when pages > 0 then 'page' else 'words' end kind from c)
      select conv_id, pos, kind, figure, case when kind = 'page' then least(pos - 1, pages - 1) end page from d""",
    "scripts": f"""with {_SCENES} select conv_id, md5(left(arg_min(narration, pos), {TITLE_CHARS})) title_md5, count(*)::bigint scenes, count(figure)::bigint with_figure, sum(len(regexp_extract_all(narration, '[一-鿿]')))::bigint chinese, sum(length(narration))::bigint chars from b group by conv_id""",
}
