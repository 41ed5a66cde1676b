"""Mixing of sources to target weights, with a token budget handed down a domain-language-source tree.

At every node the budget goes to the children by weight, none getting more than its subtree holds over all
allowed epochs; what a child can't take goes to its siblings by weight, and only a wholly exhausted subtree passes a
shortage on, because its own capacity then bounds what its parent gave it. That water level has a closed form over
the children in order of capacity per weight, so each level is a window over the tree's nodes. A leaf with a
budget of several times its tokens takes whole epochs, and of its next epoch the prefix of so many tokens in the
order of a seeded hash. Where that prefix ends is found digit by digit of the hash: sums over its 256 buckets, then over those
within the one that it ends in, and so on, so a leaf with a third of all rows is never in one task.

Null text counts as empty and is never taken; null domain, lang or source are nodes of their own, named "(none)". A node that the
weights don't name weighs 1; a weight of 0 shuts a subtree out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import checkpointed, documents

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
SEED = 20
EPOCHS = 2
#: The budget as a share of all tokens.
BUDGET_SHARE = 0.9
#: Weights by the names from the root down; others weigh 1.
WEIGHTS: dict[tuple[str, ...], float] = {("web",): 3.0, ("books",): 2.0, ("web", "en"): 4.0, ("web", "en", "src0"): 2.0, ("books", "fr"): 2.0, ("code", "en"): 3.0}
#: Sources by domain, for tables without such a column.
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"], "books": ["src8", "src9", "src10", "src11", "src12", "src13"]}
OTHER_DOMAIN = "code"
#: Hash digits of the buckets at each step: at the last one a bucket has a 16-millionth of its leaf's rows.
BUCKET_DIGITS = (2, 4, 6)
#: With no more leaves than this, their table is broadcast.
BROADCAST_LEAVES = 10_000
_TOKEN = "[^ \\t\\n\\r\\f\\v]+"


def domain_of(source: Column) -> Column:
    out = F
    for name, members in DOMAINS.items():
        out = out.when(source.isin(members), name)
    return out.otherwise(OTHER_DOMAIN)


@F.pandas_udf(T.LongType())
def n_tokens(text: pd.Series) -> pd.Series:
    """Runs of characters that are no ASCII white space; null has none."""
    return text.map(lambda t: len(t.encode().split()) if t else 0).astype("int64")


def _weight(*names: Column) -> Column:
    out = F.lit(1.0)
    for path, weight in WEIGHTS.items():
        if len(path) == len(names):
            out = F.when(F.concat_ws("\x1f", *names) == "\x1f".join(path), float(weight)).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, budget: Column, weight=_weight) -> DataFrame:
    """leaves (domain, lang, source, tokens, capacity; a row each) with the tokens that each is given, rounded down."""
    given = leaves.withColumn("given", budget)
    for depth in range(1, len(LEVELS) + 1):
        node, parent = LEVELS[:depth], LEVELS[: depth - 1]
        nodes = given.groupBy(*node).agg(F.sum("capacity").cast("double").alias("room"), F.first("given").alias("above"))
        nodes = nodes.withColumn("weight", weight(*map(F.col, node))).where(F.col("weight") > 0)
        order = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), *node)
        nodes = (
            nodes.withColumn("before", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", (F.col("above") - F.col("before")) / F.col("rest"))
            # the first child whose room the level doesn't exceed sets the level of all after it
            .withColumn("water", F.min(F.when(F.col("level") <= F.col("room") / F.col("weight"), F.struct("before", "rest", "level"))).over(order.rowsBetween(Window.unboundedPreceding, 0))["level"])
            .select(*node, F.least(F.col("room"), F.coalesce(F.col("water") * F.col("weight"), F.col("room"))).alias("given"))
        )
        given = given.drop("given").join(nodes, list(node))
    return given.withColumn("given", F.floor(F.col("given") + 1e-6).cast("long")).withColumn("given", F.least("given", "capacity"))


def _keys(names: dict[str, str]) -> dict[str, Column]:
    """The leaf's keys from columns that go by other names."""
    domain = F.col(names["domain"]) if "domain" in names else domain_of(F.col(names["source"]))
    return {f"_{k}": F.coalesce(c, F.lit(NONE)) for k, c in zip(LEVELS, (domain, F.col(names["lang"]), F.col(names["source"])), strict=True)}


def _hash(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))


def plan(light: DataFrame, budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED, weight=_weight) -> DataFrame:
    """A row for each leaf: its whole epochs, and the last row (hash, id, tokens) of its partial one with what that takes.

    light: _id, _tokens and the leaf's keys, read several times.
    """
    keys = [f"_{k}" for k in LEVELS]
    leaves = light.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")).toDF(*LEVELS, "tokens").withColumn("capacity", F.col("tokens") * epochs)
    leaves = checkpointed(leaves)
    budget = float((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    leaves = leaf_budgets(leaves, F.lit(budget), weight)
    leaves = leaves.withColumn("_full", F.floor(F.col("given") / F.col("tokens")).cast("long")).withColumn("_part", F.col("given") - F.col("_full") * F.col("tokens"))
    leaves = checkpointed(leaves.select(*(F.col(a).alias(b) for a, b in zip(LEVELS, keys, strict=True)), "_full", "_part"))

    # the bucket in which a leaf's prefix ends, by the buckets' sums at each step; then the row, by the sums within the last one
    hashed = light.join(few(leaves.where("_part > 0")), keys).withColumn("_h", _hash(seed))
    by_row = [F.col("_h"), F.col("_id"), F.col("_tokens")]
    along = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda tokens, order: F.coalesce(F.sum(tokens).over(along.orderBy(*order)), F.lit(0))
    ends = leaves.where("_part > 0").select(*keys, F.lit("").alias("_bucket"), F.lit(0).cast("long").alias("_before"))
    for digits in BUCKET_DIGITS:
        inside = _within(hashed, ends, keys)
        buckets = inside.groupBy(*keys, "_part", "_before", F.substring("_h", 1, digits).alias("_bucket")).agg(F.sum("_tokens").alias("_sum"))
        buckets = buckets.withColumn("_before", F.col("_before") + before("_sum", ["_bucket"]))
        ends = checkpointed(buckets.where("_before < _part and _before + _sum >= _part").select(*keys, "_bucket", "_before"))
    last = _within(hashed, ends, keys).groupBy(*keys, *by_row, "_part", "_before").agg(F.count("*").alias("_copies"))
    last = last.withColumn("_before", F.col("_before") + before(F.col("_tokens") * F.col("_copies"), by_row))
    last = last.where("_before < _part and _before + _tokens * _copies >= _part")
    last = last.select(*keys, F.struct(*by_row).alias("_last"), F.floor((F.col("_part") - F.col("_before")) / F.col("_copies")).cast("long").alias("_last_tokens"))
    return checkpointed(leaves.drop("_part").join(last, keys, "left"))


def _within(hashed: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each leaf's bucket in ends, with what lies before it."""
    return hashed.join(few(ends), keys).where(F.col("_h").startswith(F.col("_bucket"))).drop("_bucket")


def few(leaves: DataFrame) -> DataFrame:
    """The table of leaves, broadcast if it is no longer than BROADCAST_LEAVES."""
    return F.broadcast(leaves) if len(leaves.take(BROADCAST_LEAVES + 1)) <= BROADCAST_LEAVES else leaves


def _taken(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    place = F.struct(_hash(seed).alias("_h"), "_id", "_tokens")
    prefix = F.when(place < F.col("_last"), F.col("_tokens")).when(place == F.col("_last"), F.col("_last_tokens")).otherwise(F.lit(0))
    return rows.join(few(leaves), [f"_{k}" for k in LEVELS]).withColumn("_prefix", prefix.cast("long")).where("_full + _prefix > 0")


def _mixed(docs: DataFrame, seed: int, with_text: bool, options: dict) -> tuple[DataFrame, dict[str, str]]:
    """The rows that are taken with _domain, _tokens, _full and _prefix; the columns of docs go by the names returned, so that docs may have any."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    rows = rows.withColumns(_keys(names) | {"_id": F.col(names["doc_id"]), "_tokens": n_tokens(F.col(names["text"]))}).where("_tokens > 0")
    light = checkpointed(rows.select("_id", *(f"_{k}" for k in LEVELS), "_tokens", *(names[c] for c in ("doc_id", "lang", "source"))))
    return _taken(rows if with_text else light, plan(light.select("_id", *(f"_{k}" for k in LEVELS), "_tokens"), seed=seed, **options), seed), names


def mix(docs: DataFrame, seed: int = SEED, with_text: bool = True, **options) -> DataFrame:
    """One row for each row that is taken: its columns, and domain, n_tokens, full_epochs and prefix_tokens.

    full_epochs: how often it is taken whole; prefix_tokens: how many of its first tokens the leaf's last, partial epoch
    takes, short of all of them only where the prefix ends. Rows of equal id and length there share what is left.
    docs: doc_id, text, lang, source and any more; a `domain` column is used if there is one, and columns of the other new names
    are replaced. Without the text, which isn't read again then, only doc_id, lang and source are returned beside the new columns.
    """
    new = {"domain": "_domain", "n_tokens": "_tokens", "full_epochs": "_full", "prefix_tokens": "_prefix"}
    taken, names = _mixed(docs, seed, with_text, options)
    own = [c for c in docs.columns if c not in new] if with_text else ["doc_id", "lang", "source"]
    return taken.select(*(F.col(names[c]).alias(c) for c in own), *(F.col(b).alias(a) for a, b in new.items()))


def mixed_texts(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, the last one of a prefix cut to its tokens; n_chars follows the text.

    All columns of docs are kept, whatever their names. Rows with null or empty text, which have no tokens, go.
    """
    taken, names = _mixed(docs, seed, True, options)
    text = F.col(names["text"])
    first = F.regexp_extract(text, "^[ \\t\\n\\r\\f\\x0B]*", 0)
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+[ \\t\\n\\r\\f\\x0B]*"), 0), F.lit(1), F.col("_prefix").cast("int")), "")
    cut = F.concat(first, part)
    whole = F.col("_full") + F.when(F.col("_prefix") == F.col("_tokens"), 1).otherwise(0)
    copies = F.flatten(F.array(F.array_repeat(text, whole.cast("int")), F.when((F.col("_prefix") > 0) & (F.col("_prefix") < F.col("_tokens")), F.array(cut)).otherwise(F.array().cast("array<string>"))))
    own = {c: F.col(n) for c, n in names.items()} | {"text": F.col("_text")}
    if "n_chars" in names:
        own["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return taken.withColumn("_text", F.explode(copies)).select(*(own[c].alias(c) for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), with_text=False)
    return taken.select("doc_id", "domain", "lang", "source", "n_tokens", "full_epochs", "prefix_tokens")


def _sql_weight(depth: int) -> str:
    cases = " ".join("when " + " and ".join(f"{c} = '{v}'" for c, v in zip(LEVELS, path, strict=False)) + f" then {w}" for path, w in WEIGHTS.items() if len(path) == depth)
    return f"case {cases} else 1.0 end"


def _sql_level(depth: int) -> str:
    node, parent = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1])
    by, on = f"partition by {parent} " if parent else "", " using (" + node + ")"
    return f"""
  n{depth} as (select {node}, sum(capacity)::double room, first(given) above, {_sql_weight(depth)} weight from g{depth - 1} group by {node}),
  w{depth} as (select *, coalesce(sum(room) over (o rows between unbounded preceding and 1 preceding), 0) before_, sum(weight) over (o rows between current row and unbounded following) rest
    from n{depth} window o as ({by}order by room / weight, {node})),
  l{depth} as (select *, (above - before_) / rest as level_ from w{depth}),
  f{depth} as (select *, first_value(case when level_ <= room / weight then level_ end ignore nulls) over ({by}order by room / weight, {node} rows between unbounded preceding and current row) water from l{depth}),
  g{depth} as (select g.* exclude (given), least(room, coalesce(water * weight, room)) given from g{depth - 1} g join f{depth}{on})"""


OP1_SQL = f"""
with d as (select doc_id, lang, source, case {" ".join(f"when source in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in DOMAINS.items())} else '{OTHER_DOMAIN}' end as domain,
    len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'))::bigint n_tokens from documents),
  t as (select doc_id, domain, lang as lang_, source as source_, coalesce(lang, '{NONE}') lang, coalesce(source, '{NONE}') source, n_tokens from d where n_tokens > 0),
  g0 as (select *, tokens * {EPOCHS} capacity, sum(tokens) over () * {BUDGET_SHARE}::double given from (select domain, lang, source, sum(n_tokens)::bigint tokens from t group by all)),{_sql_level(1)},{_sql_level(2)},{_sql_level(3)},
  leaf as (select domain, lang, source, tokens, least(floor(given + 1e-6)::bigint, capacity::bigint) given from g3),
  b as (select *, given // tokens full_epochs, given % tokens part from leaf),
  h as (select t.*, b.full_epochs, b.part, md5('{SEED}:' || b.full_epochs || ':' || doc_id) h from t join b using (domain, lang, source)),
  r as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by h, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0)::bigint before_ from h)
select doc_id, domain, lang_ as lang, source_ as source, n_tokens, full_epochs::bigint full_epochs, least(n_tokens, greatest(0, part - before_))::bigint prefix_tokens
from r where full_epochs + least(n_tokens, greatest(0, part - before_)) > 0
"""
