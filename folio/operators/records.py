"""Queries over pages, events and conversations: extraction, bounded stores, job states, scene timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.documents import table

HISTORY = 50
CHARS_PER_SECOND = 4.2
FPS, FADE = 25, 0.6
SEGMENT = 2000
JOB_TTL = "10 minutes"

# What a page's markup leaves behind, in this order.
_DROP = (r"(?is)<!--.*?-->", r"(?is)<(?:script|style|nav|header|footer|aside|noscript)\b[^>]*>.*?</(?:script|style|nav|header|footer|aside|noscript)\s*>")
_TAG, _SPACE = r"(?s)<[^>]*>", r"\s+"


def page_text(html: Column) -> Column:
    for pattern in (*_DROP, _TAG):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, _SPACE, " "))


def web_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_text(F.col("html"))
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), _SPACE, " "))
    heading = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), _SPACE, " "))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", title.alias("t"), heading.alias("h"), t.alias("x"))
    return rows.select("page_id", F.coalesce(F.nullif("h", F.lit("")), F.nullif("t", F.lit("")), "url").alias("title"), F.length("x").cast("long").alias("chars"), F.md5("x").alias("text_md5"), (F.length("x") >= 80).alias("enough"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    host, path = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1), F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    base = F.regexp_extract(path, "([^/]*)/?$", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(host).alias("host"), F.lower(path).endswith(".pdf").alias("is_pdf"), base.alias("base_name"), X.paper_id(url).alias("paper"))


def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut into segments of a fixed height, the last one shorter; the height is that of the markup, a pixel a character."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("h")).where("h > 0")
    cut = rows.select("page_id", "h", F.posexplode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(SEGMENT))).alias("n", "y"))
    return cut.select("page_id", (F.col("n") + 1).cast("long").alias("page"), F.col("y").cast("long").alias("y"), F.least(F.lit(SEGMENT), F.col("h") - F.col("y")).cast("long").alias("height"), F.concat(F.lpad((F.col("n") + 1).cast("string"), 3, "0"), F.lit(".png")).alias("name"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, newest first, HISTORY at most."""
    rows = table(spark, sf_dir, "events")
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").orderBy(F.desc("ts"), F.desc("event_id")).limit(HISTORY)
    return kept.select("user_id", "event_id", "event_type")


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user's job by its events: the last stage named, the first end, and the number of events."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    ends = F.col("event_type").isin("purchase", "error")
    grouped = rows.groupBy("user_id").agg(
        F.count("*").cast("long").alias("events"),
        F.max_by(F.when(~ends, F.col("event_type")), F.when(~ends, F.col("at"))).alias("stage"),
        F.min_by(F.when(ends, F.col("event_type")), F.when(ends, F.col("at"))).alias("ended_by"),
    )
    return grouped.select("user_id", "events", "stage", F.when(F.col("ended_by").isNull(), "running").when(F.col("ended_by") == "error", "error").otherwise("done").alias("state"))


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the events' JSON; broken JSON gives null."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").cast("long").alias("events"), F.count("k").cast("long").alias("with_k"), F.sum("k").cast("long").alias("k_sum"))


def recent_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type the events of its last 30 days before the newest event of any, or all if there are none; the 60 newest of a type."""
    rows = table(spark, sf_dir, "events")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("newest"))))
    rows = rows.withColumn("recent", F.col("ts") >= F.col("newest") - F.expr("interval 30 days"))
    # a row for each type; the ranks below are taken within each partition first
    some = rows.groupBy("event_type").agg(F.max("recent").alias("any"))
    rows = rows.join(some, "event_type")
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.where("recent or not any").withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 60").select("event_type", "rank", "event_id")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with words are scenes."""
    rows = table(spark, sf_dir, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.select("conv_id", "turn", "role", F.length("text").alias("chars"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each scene and where it starts, neighbours overlapping by the fade."""
    frames = F.greatest(F.lit(1), F.floor(F.col("chars") / CHARS_PER_SECOND * FPS + 0.5)).cast("long")
    rows = scenes(spark, sf_dir).withColumn("frames", frames)
    along = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum("frames").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pos = F.row_number().over(along)
    fade = int(FADE * FPS)
    start = F.greatest(F.lit(0), before - (pos - 1) * fade)
    count = F.count("*").over(Window.partitionBy("conv_id"))
    kind = F.when(pos == 1, "title").when(pos == count, "end").otherwise("page")
    return rows.select("conv_id", "turn", pos.cast("long").alias("pos"), "frames", start.cast("long").alias("start_frame"), kind.alias("kind"))


def narration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).groupBy("conv_id").agg(F.count("*").cast("long").alias("scenes"), (F.sum("frames") - (F.count("*") - 1) * int(FADE * FPS)).cast("long").alias("total_frames"))
    return rows.withColumn("too_long", F.col("total_frames") > 310 * FPS)


def used_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of turns as titles: newest first, each once, 80 at most."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("title")).where("title <> ''")
    newest = rows.groupBy("title").agg(F.max(F.struct("conv_id", "turn")).alias("at"))
    return newest.orderBy(F.desc("at"), "title").limit(80).select(F.md5("title").alias("title_md5"), F.col("at.conv_id").alias("conv_id"), F.col("at.turn").alias("turn"))


def orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest record of each key by its time, joined to the dimension it names, or a default."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    latest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"), F.count("*").cast("long").alias("orders"))
    joined = customers.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.col("last.o_orderkey").alias("last_order"), F.coalesce("orders", F.lit(0)).alias("orders"))


def _page_text_sql(t: str) -> str:
    for pattern in (*_DROP, _TAG):
        t = f"regexp_replace({t}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{_SPACE}', ' ', 'g'))"


QUERIES = {f.__name__: f for f in (web_extract, url_parts, page_segments, history, job_states, event_fields, recent_or_all, timeline, narration_totals, used_titles, orders_of_customers)}
_TIMELINE = f"""s as (select conv_id, turn, greatest(1, floor(length(text) / {CHARS_PER_SECOND}::double * {FPS} + 0.5))::bigint frames from conversations where trim(coalesce(text, '')) <> ''),
  t as (select *, row_number() over w pos, coalesce(sum(frames) over (w rows between unbounded preceding and 1 preceding), 0) before_, count(*) over (partition by conv_id) n from s window w as (partition by conv_id order by turn))"""
SQL = {
    "web_extract": rf"""select page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), url) title,
      length(x)::bigint chars, md5(x) text_md5, length(x) >= 80 enough from (select *, {_page_text_sql('html')} x from pages)""",
    "url_parts": r"""select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, ends_with(lower(p), '.pdf') is_pdf, regexp_extract(p, '([^/]*)/?$', 1) base_name, regexp_extract(url, '([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?', 1) paper
      from (select *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) p from pages)""",
    "page_segments": f"select page_id, (y // {SEGMENT} + 1)::bigint page, y::bigint y, least({SEGMENT}, h - y)::bigint height, lpad((y // {SEGMENT} + 1)::varchar, 3, '0') || '.png' as name from (select page_id, length(html) h, unnest(range(0, length(html), {SEGMENT})) y from pages)",
    "history": f"select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1 order by ts desc, event_id desc limit {HISTORY}",
    "job_states": """select user_id, count(*)::bigint events, arg_max(event_type, (ts, event_id)) filter (event_type not in ('purchase', 'error')) stage,
      case arg_min(event_type, (ts, event_id)) filter (event_type in ('purchase', 'error')) when 'error' then 'error' when 'purchase' then 'done' else 'running' end state from events group by user_id""",
    "event_fields": "select event_type, count(*)::bigint events, count(k)::bigint with_k, sum(k)::bigint k_sum from (select event_type, try_cast(props::json ->> 'k' as bigint) k from events) group by all",
    "recent_or_all": "select event_type, rank, event_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) rank from (select *, bool_or(recent) over (partition by event_type) any_ from (select *, ts >= (select max(ts) from events) - interval 30 days recent from events)) where recent or not any_) where rank <= 60",
    "timeline": f"with {_TIMELINE} select conv_id, turn, pos, frames, greatest(0, before_ - (pos - 1) * {int(FADE * FPS)})::bigint start_frame, case when pos = 1 then 'title' when pos = n then 'end' else 'page' end kind from t",
    "narration_totals": f"with {_TIMELINE} select conv_id, count(*)::bigint scenes, (sum(frames) - (count(*) - 1) * {int(FADE * FPS)})::bigint total_frames, sum(frames) - (count(*) - 1) * {int(FADE * FPS)} > {310 * FPS} too_long from t group by conv_id",
    "used_titles": "select md5(title) title_md5, newest.c conv_id, newest.t turn from (select title, max({'c': conv_id, 't': turn}) newest from (select conv_id, turn, trim(string_split(coalesce(text, ''), chr(10))[1]) title from conversations) where title <> '' group by title) order by newest desc, title limit 80",
    "orders_of_customers": "select c_custkey, o.k last_order, coalesce(n, 0)::bigint orders from customer left join (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) k, count(*) n from orders group by all) o on o_custkey = c_custkey",
}
