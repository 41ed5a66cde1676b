"""URL filters: rules by host and path, and for the rest a ratio of character language models of accepted and rejected URLs.

The rules that fit label their URLs. Three quarters of these (by a digest of the URL) teach two Markov models of variable order: the
symbols behind every context of up to `ORDER` characters that holds at least one in `CONTEXTS` of all taught symbols, each smoothed
by its shorter contexts. So there are at most ORDER * CONTEXTS + 1 contexts, whatever the table's size, and the models and
the step from context to context are one array, indexed by context and symbol. A URL's score folds its symbols over that array: the mean
difference of log-likelihoods a symbol, in ten-thousandths. The other quarter sets the threshold, where the shares of
wrongly rejected and wrongly accepted URLs sum least. All of it is column functions and aggregates.

A null URL is empty, and so scored by its end alone; host and path of a URL without `://` are empty and no rule fits. Without
taught URLs all scores are 0, and without both labels in the other quarter the threshold is 0: both allow. Equal URLs are judged alike.
A column named as one of the results is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import checkpointed

ORDER = 3
#: A context is kept if it holds at least one in so many taught symbols.
CONTEXTS = 1024
#: What shorter contexts weigh in a longer one, in symbols.
PRIOR = 8
#: Scores are whole numbers of this part of a natural logarithm.
UNIT = 10_000
#: Scores beyond this are as good as it for the threshold.
MOST_SCORE = 2 * UNIT
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
#: What stands before a URL, for all other characters, and behind it.
START, OTHER, END = "<", "^", "|"
SYMBOLS = LETTERS + OTHER + END
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits of a URL's digest that keep it for the threshold.
THRESHOLD_DIGITS = ("0", "1", "2", "3")
#: A fold's state: the context above these bits, the sum in them.
SUM_BITS = 50


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """text and verdict of the longest rule that fits; of equally long ones the one that blocks, then the first; null for none."""
    fits = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block"), reverse=False):
        whole = F.concat(F.lit("."), host).endswith("." + rule.host) & path.startswith(rule.path)
        fits = F.when(whole, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(fits)
    return fits


def symbols_of(url: Column) -> Column:
    """The symbols of a URL and its end, as an array."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    quoted = "".join("\\" + c if c in "[]^-&" else c for c in LETTERS)
    return F.split(F.concat(F.regexp_replace(plain, f"[^{quoted}]", OTHER), F.lit(END)), "")


def for_threshold(url: Column) -> Column:
    return F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 1).isin(*THRESHOLD_DIGITS)


def _grams(labelled: DataFrame) -> DataFrame:
    """How often each symbol (at the end of gram) follows the ORDER before it, in accepted and in rejected URLs."""
    padded = F.concat(F.array(*[F.lit(START)] * ORDER), F.col("symbols"))
    rows = labelled.select("accepted", padded.alias("padded"))
    grams = F.transform(F.slice("padded", ORDER + 1, F.size("padded") - ORDER), lambda c, i: F.concat(*[F.get("padded", i + k) for k in range(ORDER)], c))
    one = F.explode(grams).alias("gram")
    return rows.select("accepted", one).groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))


def contexts_and_steps(grams: DataFrame) -> DataFrame:
    """One row: `steps`, an array by context and symbol, and `start`, the number of the context before a URL.

    A step holds the context that follows (above SUM_BITS) plus the symbol's score.
    """
    spark = grams.sparkSession
    by_order = grams.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("gram", ORDER - k + 1, k).alias("context")) for k in range(ORDER + 1)])).alias("at"), F.substring("gram", ORDER + 1, 1).alias("symbol"), "a", "r")
    counts = checkpointed(by_order.groupBy("at.k", "at.context", "symbol").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    sums = counts.groupBy("k", "context").agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
    taught = counts.where("k = 0").agg(F.coalesce(F.sum(F.col("a") + F.col("r")), F.lit(0)).alias("n"))
    shortest = spark.createDataFrame([(0, "", 0, 0)], "k int, context string, all_a long, all_r long")
    some = sums.withColumn("n", taught.scalar()).where((F.col("k") > 0) & ((F.col("all_a") + F.col("all_r")) * CONTEXTS >= F.col("n"))).drop("n")
    kept = some.unionByName(sums.where("k = 0")).unionByName(shortest).groupBy("k", "context").agg(F.max("all_a").alias("all_a"), F.max("all_r").alias("all_r"))
    # at most ORDER * CONTEXTS + 1 of them, so that one array numbers them
    ids = kept.agg(F.array_sort(F.collect_list("context")).alias("contexts")).select(F.posexplode("contexts").alias("id", "context"))
    kept = checkpointed(kept.join(ids, "context"))

    symbol = F.explode(F.array(*map(F.lit, SYMBOLS))).alias("symbol")
    level = None
    levels = []
    for k in range(ORDER + 1):
        own = kept.where(F.col("k") == k).select("id", "context", "all_a", "all_r", symbol).join(counts.where(F.col("k") == k).select("context", "symbol", "a", "r"), ["context", "symbol"], "left").fillna(0, ["a", "r"])
        if level is None:
            own = own.withColumns({f"p_{x}": (F.col(x) + 1) / (F.col(f"all_{x}") + len(SYMBOLS)) for x in "ar"})
        else:
            shorter = level.select(F.col("context").alias("shorter"), "symbol", F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r"))
            own = own.withColumn("shorter", F.substring("context", 2, ORDER)).join(shorter, ["shorter", "symbol"])
            own = own.withColumns({f"p_{x}": (F.col(x) + PRIOR * F.col(f"q_{x}")) / (F.col(f"all_{x}") + PRIOR) for x in "ar"})
        level = own.select("id", "context", "symbol", "p_a", "p_r")
        levels.append(level)
    scored = levels[0]
    for level in levels[1:]:
        scored = scored.unionByName(level)
    scored = scored.withColumns({"score": F.round((F.log("p_a") - F.log("p_r")) * UNIT).cast("long"), "after": F.concat("context", "symbol")})
    longest = scored.select("id", "symbol", "score", F.explode(F.array(*[F.when(F.length("after") >= k, F.substring(F.col("after"), -k, k)) if k else F.lit("") for k in range(ORDER + 1)])).alias("suffix"))
    follow = longest.join(kept.select(F.col("context").alias("suffix"), F.col("id").alias("follows")), "suffix")
    steps = follow.groupBy("id", "symbol", "score").agg(F.max_by("follows", F.length("suffix")).alias("follows"))
    slot = F.col("id") * len(SYMBOLS) + F.instr(F.lit(SYMBOLS), F.col("symbol")) - 1
    step = F.shiftleft(F.col("follows").cast("long"), SUM_BITS) + F.col("score")
    start = kept.where(F.col("context").isin(*[START * k for k in range(ORDER + 1)])).agg(F.max_by("id", "k"))
    steps = steps.agg(F.transform(F.array_sort(F.collect_list(F.struct(slot.alias("slot"), step.alias("step")))), lambda x: x.step).alias("steps"))
    return checkpointed(steps.withColumn("start", start.scalar().cast("long")))


def _score(steps: Column, start: Column, symbols: Column) -> Column:
    """The mean difference of log-likelihoods a symbol, rounded down."""
    low, zero = (1 << SUM_BITS) - 1, 1 << (SUM_BITS - 1)

    def step(state: Column, symbol: Column) -> Column:
        context = F.shiftrightunsigned(state, SUM_BITS).cast("int")
        return F.get(steps, context * len(SYMBOLS) + F.instr(F.lit(SYMBOLS), symbol) - 1) + state.bitwiseAND(F.lit(low))

    total = F.aggregate(symbols, F.shiftleft(start, SUM_BITS) + F.lit(zero), step).bitwiseAND(F.lit(low)) - F.lit(zero)
    return F.floor(total / F.size(symbols)).cast("long")


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls (with `symbols`) and their `score`."""
    columns = urls.columns
    # the model is a scalar of the plan: one array, which every task shares
    rows = urls.select("*", model.select("steps").scalar().alias("_steps"), model.select("start").scalar().alias("_start"))
    return rows.select(*columns, _score(F.col("_steps"), F.col("_start"), F.col("symbols")).alias("score"))


def threshold_of(rows: DataFrame) -> DataFrame:
    """One row: the score from which the shares of accepted URLs below and of rejected ones above it sum least; the least such score."""
    clipped = F.greatest(F.least("score", F.lit(MOST_SCORE)), F.lit(-MOST_SCORE)).alias("score")
    bins = rows.select(clipped, "accepted").groupBy("score").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    # at most 2 * MOST_SCORE + 1 bins
    ordered = bins.agg(F.array_sort(F.collect_list(F.struct("score", "a", "r"))).alias("bins"), F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
    empty = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"), F.lit(None).cast("double").alias("wrong"), F.lit(0).cast("long").alias("score"))

    def take(seen: Column, one: Column) -> Column:
        wrong = seen.a.cast("double") * F.col("all_r") + (F.col("all_r") - seen.r).cast("double") * F.col("all_a")
        better = seen.wrong.isNull() | (wrong < seen.wrong)
        return F.struct((seen.a + one.a).alias("a"), (seen.r + one.r).alias("r"), F.when(better, wrong).otherwise(seen.wrong).alias("wrong"), F.when(better, one.score).otherwise(seen.score).alias("score"))

    both = (F.col("all_a") > 0) & (F.col("all_r") > 0)
    return ordered.select(F.coalesce(F.when(both, F.aggregate("bins", empty, take).score), F.lit(0)).cast("long").alias("threshold"))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score (in ten-thousandths a symbol)."""
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score", "symbols", "_rule", "_steps", "_start") or c == url]
    rows = pages.select(*rest).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("symbols", symbols_of(F.col(url)))
    labelled = rows.where(F.col("_rule").isNotNull()).select("symbols", (F.col("_rule.verdict") == "allow").alias("accepted"), for_threshold(F.col(url)).alias("kept"))
    model = contexts_and_steps(_grams(labelled.where(~F.col("kept"))))
    threshold = threshold_of(scored(labelled.where("kept"), model))
    by_model = F.when(F.col("score") >= threshold.scalar(), "allow").otherwise("block")
    return scored(rows, model).select(*rest, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_model).alias("verdict"), "score")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


OP12_SQL = f"""
with u as (
  select page_id, coalesce(url, '') as url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), v as (
  select *, case
    when ('.' || host) like '%.example.org' and starts_with(path, '/en/1') then 'example.org/en/1'
    when ('.' || host) like '%.example.org' and starts_with(path, '/es/') then 'example.org/es/'
    when ('.' || host) like '%.com' and starts_with(path, '/fr/') then 'com/fr/'
    when ('.' || host) like '%.com' and starts_with(path, '/de/') then 'com/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/') then 'org/' end as rule,
    repeat('{START}', {ORDER}) || regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '[^a-z0-9\\-._~:/?#\\[\\]@!$&''()*+,;=%]', '{OTHER}', 'g') || '{END}' as padded,
    md5(url)[1] in ('0', '1', '2', '3') as kept
  from u
), w as (
  select *, rule in ('org/', 'com/fr/') as accepted from v
), texts as (
  select padded, any_value(kept) as kept, any_value(rule) as rule, any_value(accepted) as accepted, count(*) as n from w group by padded, url
), places as (
  select padded, kept, rule, accepted, n, unnest(range({ORDER + 1}, length(padded)::bigint + 1)) as i from texts
), grams as (
  select substr(padded, i - {ORDER}, {ORDER + 1}) as gram, sum(n) filter (accepted) as a, sum(n) filter (not accepted) as r
  from places where rule is not null and not kept group by gram
), counts as (
  select k, substr(gram, {ORDER + 1} - k, k) as context, gram[{ORDER + 1}] as symbol, coalesce(sum(a), 0) as a, coalesce(sum(r), 0) as r
  from grams, (select unnest(range(0, {ORDER + 1})) as k) group by all
), sums as (
  select k, context, sum(a) as all_a, sum(r) as all_r from counts group by all
  union all select 0, '', 0, 0 where not exists (from counts)
), kept as (
  select * from sums where k = 0 or (all_a + all_r) * {CONTEXTS} >= (select sum(a + r) from counts where k = 0)
), symbols as (
  select unnest(string_split('{SYMBOLS.replace("'", "''")}', '')) as symbol
), own as (
  select k, context, symbol, coalesce(a, 0)::double as a, coalesce(r, 0)::double as r, all_a::double as all_a, all_r::double as all_r
  from kept cross join symbols left join counts using (k, context, symbol)
), p0 as (
  select context, symbol, (a + 1) / (all_a + {len(SYMBOLS)}) as pa, (r + 1) / (all_r + {len(SYMBOLS)}) as pr from own where k = 0
), p1 as (
  select o.context, symbol, (a + {PRIOR} * pa) / (all_a + {PRIOR}) as pa, (r + {PRIOR} * pr) / (all_r + {PRIOR}) as pr
  from own o join p0 q using (symbol) where k = 1
), p2 as (
  select o.context, symbol, (a + {PRIOR} * pa) / (all_a + {PRIOR}) as pa, (r + {PRIOR} * pr) / (all_r + {PRIOR}) as pr
  from own o join p1 q using (symbol) where k = 2 and q.context = substr(o.context, 2)
), p3 as (
  select o.context, symbol, (a + {PRIOR} * pa) / (all_a + {PRIOR}) as pa, (r + {PRIOR} * pr) / (all_r + {PRIOR}) as pr
  from own o join p2 q using (symbol) where k = 3 and q.context = substr(o.context, 2)
), told as (
  select context, symbol, round((ln(pa) - ln(pr)) * {UNIT})::bigint as score
  from (from p0 union all from p1 union all from p2 union all from p3)
), used as (
  select padded, i, max_by(score, length(context)) as score
  from places join told on symbol = padded[i] and context = substr(padded, i - length(context), length(context))
  group by padded, i
), scores as (
  select padded, floor(sum(score)::double / count(*))::bigint as score from used group by padded
), bins as (
  select greatest(least(score, {MOST_SCORE}), -{MOST_SCORE}) as score, coalesce(sum(n) filter (accepted), 0)::double as a, coalesce(sum(n) filter (not accepted), 0)::double as r
  from texts join scores using (padded) where rule is not null and kept group by all
), wrong as (
  select score, (sum(a) over (order by score) - a) * (select sum(r) from bins) + ((sum(r) over (order by score desc))) * (select sum(a) from bins) as wrong from bins
), threshold as (
  select case when (select sum(a) > 0 and sum(r) > 0 from bins) then (select score from wrong order by wrong, score limit 1) else 0 end as t
)
select page_id, host, path, rule,
  case when rule is not null then if(accepted, 'allow', 'block') when score >= (select t from threshold) then 'allow' else 'block' end as verdict, score
from w join scores using (padded)
"""
