"""Queries over document texts: normal forms, terms, chunks, style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import style as S
from folio.functions import text as X

BUDGET = 1600
TOP_TERMS = 24
# Marks that style counts.
STYLE_MARKS = {"periods": "[。]", "commas": "[，,]", "exclaims": "[!！]", "questions": "[？?]", "dashes": "——|—", "first_person": "我们|我"}
BOLD = r"\*\*[^*\n]+\*\*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("text_md5"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.visible_length(t).alias("visible"), X.style_length(t).alias("style"), X.count_matches(t, "[\u4e00-\u9fff]").alias("chinese"))


def number_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.numbers(F.col("text"))).alias("pos", "number"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "number")


def term_counts(rows: DataFrame, key: list[str], text: str, limit: int = TOP_TERMS) -> DataFrame:
    """Terms of each row by count, then length, then first place; the rank starts at 1. Rows are counted on their own, whatever their key."""
    each = rows.select(*key, F.posexplode(X.ranked_terms(F.col(text), limit)).alias("pos", "t"))
    return each.select(*key, (F.col("pos") + 1).cast("long").alias("rank"), "t.term", "t.n")


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def chunked(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    clean = rows.select("doc_id", X.normalize_text(F.col("text")).alias("clean"))
    pieces = clean.select("doc_id", F.posexplode(X.split_clean(F.col("clean"), budget)).alias("idx", "text"))
    return pieces.select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = chunked(table(spark, sf_dir, "documents"))
    return piece.select("doc_id", "idx", F.concat(F.lit("c"), F.col("idx") + 1).alias("chunk_id"), F.length("text").cast("long").alias("chars"), X.block_type(F.col("text")).alias("type"), F.md5("text").alias("text_md5"))


def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(chunked(table(spark, sf_dir, "documents")), ["doc_id", "idx"], "text", 5)


def structure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_doc = chunked(table(spark, sf_dir, "documents")).groupBy("doc_id")
    return by_doc.agg(F.count("*").cast("long").alias("chunk_count"), F.sum(F.length("text")).cast("long").alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term"))
    return terms.groupBy(F.trim("term").alias("term")).agg(F.count("*").cast("long").alias("n"))


#: Documents are dealt to so many parts by id, so that a term that very many share is joined in as many tasks.
SALT = 32
TITLE_CHARS = 100


def first_line(text: Column) -> Column:
    return F.left(F.split(F.coalesce(text, F.lit("")), "\n")[0], F.lit(TITLE_CHARS))


def title_words(title: Column) -> Column:
    """Distinct lower-case words of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9一-鿿]+"), lambda w: F.length(w) >= 3))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark item the three documents with the highest score: two points for each shared top term, one for each word of the
    item's first line that is in the document's."""
    bench, rows = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    items = term_counts(bench, ["item_id"], "text").select("item_id", "term", salts)
    docs = term_counts(rows, ["doc_id"], "text").select("doc_id", "term", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"))
    by_term = items.join(docs, ["term", "salt"]).select("item_id", "doc_id", F.lit(2).alias("points"))
    # a word within a title shares its first three characters with a place in it
    words = bench.select("item_id", F.explode(title_words(first_line(F.col("text")))).alias("word")).select("item_id", "word", F.left("word", F.lit(3)).alias("head"), salts)
    titles = rows.select("doc_id", F.lower(first_line(F.col("text"))).alias("title"), F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("title") - 2), lambda i: F.substring(F.col("title"), i, F.lit(3))))
    titles = titles.where(F.length("title") >= 3).select("doc_id", "title", "salt", F.explode(places).alias("head"))
    by_title = words.join(titles, ["head", "salt"]).where(F.contains("title", "word")).select("item_id", "doc_id", F.lit(1).alias("points"))
    scored = by_term.unionByName(by_title).groupBy("item_id", "doc_id").agg(F.sum("points").cast("long").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3").select("item_id", "rank", "doc_id", "score")


def with_style(rows: DataFrame) -> DataFrame:
    """Metrics of texts by doc_id. Words without Markdown are counted; marks of emphasis are counted as written."""
    # Each step names what the next one uses several times, so that it is computed once.
    t = F.col("words")
    parts = lambda pattern, least: F.filter(F.transform(F.split(t, pattern), X.style_length), lambda n: n > least)
    words = rows.select("doc_id", X.text_or_empty(F.col("text")).alias("text"), S.words_only(F.col("text")).alias("words"))
    split = words.select("*", S.outside_ascii(t).alias("outside"), parts(r"\n\s*\n", 0).alias("p"), parts(r"[。！？!?；;\n]+", 1).alias("s"))
    mean = lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.floor(F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y) / F.size(a) * 10 + 0.5) / 10)
    lengths = []
    for name, a in (("paragraph", F.col("p")), ("sentence", F.col("s"))):
        lengths += [F.size(a).cast("long").alias(name + "s"), mean(a).cast("double").alias(name + "_mean"), F.coalesce(F.array_max(a), F.lit(0)).cast("long").alias(name + "_max")]
    counted = split.select(
        "doc_id",
        X.style_length(t).alias("chars"),
        *lengths,
        *(X.count_matches(t, pattern).alias(name) for name, pattern in STYLE_MARKS.items()),
        X.count_matches(F.col("text"), BOLD).alias("bold"),
        *(S.total(S.word_hits(t, name, F.col("outside"))).alias(name) for name in S.WORD_LISTS),
    )
    per = lambda n, unit, digits: F.when(F.col("chars") == 0, 0.0).otherwise(F.floor(n / F.col("chars") * unit * digits + 0.5) / digits)
    counted = counted.withColumn("voice", sum((F.col(c) for c in S.VOICE), F.lit(0).cast("long")))
    return counted.withColumns({"first_person_per_100": per(F.col("first_person"), 100, 10), "voice_per_1k": per(F.col("voice"), 1000, 100)})


def style_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_style(table(spark, sf_dir, "documents"))


def with_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with words of the lists behind them, as their invented prose has none: by id, of each list some and some twice."""
    rows = table(spark, sf_dir, "documents")
    pick = lambda name, k: F.element_at(F.array(*map(F.lit, S.WORD_LISTS[name])), (F.pmod(F.floor(F.col("doc_id") / k), F.lit(len(S.WORD_LISTS[name]))) + 1).cast("int"))
    added = [F.when(F.pmod("doc_id", F.lit(i + 2)) == 0, F.concat(pick(name, 1), F.lit("，"), pick(name, 3), F.lit("。"), pick(name, 1))).otherwise("") for i, name in enumerate(S.WORD_LISTS)]
    return rows.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), *added).alias("text"))


def word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each list in each text, most frequent first."""
    return hits_of(with_phrases(spark, sf_dir), "doc_id")


#: How many words of a list a warning shows.
PREVIEWS = {"stock": 5, "caution": 6, "boundary": 6} | dict.fromkeys(S.VOICE, 3)


def hit_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a warning shows of each list's hits: the most frequent words with their counts, and how many hits there are in all."""
    words = with_phrases(spark, sf_dir).select("doc_id", S.words_only(F.col("text")).alias("t"))
    lists = F.array(*(F.struct(F.lit(name).alias("list"), S.word_hits(F.col("t"), name, F.col("outside")).alias("hits"), F.lit(n).alias("most")) for name, n in PREVIEWS.items()))
    each = words.withColumn("outside", S.outside_ascii(F.col("t"))).select("doc_id", F.explode(lists).alias("l")).where(F.size("l.hits") > 0)
    shown = F.transform(F.slice(F.col("l.hits"), F.lit(1), F.col("l.most")), lambda h: F.concat(h["word"], F.lit("×"), h["n"]))
    return each.select("doc_id", "l.list", F.array_join(shown, "、").alias("preview"), S.total(F.col("l.hits")).alias("total"))


def hits_of(rows: DataFrame, key: str) -> DataFrame:
    lists = F.array(*(F.struct(F.lit(name).alias("list"), S.word_hits(F.col("t"), name, F.col("outside")).alias("hits")) for name in S.WORD_LISTS))
    each = rows.select(key, S.words_only(F.col("text")).alias("t")).withColumn("outside", S.outside_ascii(F.col("t"))).select(key, F.explode(lists).alias("l"))
    each = each.select(key, "l.list", F.posexplode("l.hits").alias("pos", "h"))
    return each.select(key, "list", (F.col("pos") + 1).cast("long").alias("rank"), "h.word", "h.n")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First date and paper id in each text."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.first_date(t).alias("date"), X.paper_id(t).alias("paper"), F.md5(X.truncate_visible(t, 100)).alias("head_md5"), F.md5(X.truncate_at_sentence(t, 300)).alias("lead_md5"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of good quality that aren't toxic: a semi-join, then an anti-join."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").join(labels.where("toxic = 1"), "doc_id", "left_anti")
    return kept.select("doc_id", "source", F.length("text").cast("long").alias("text_length"))


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").cast("long").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("doc_id").cast("long").alias("latest"))


NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({t},''), '\r\n?', chr(10), 'g'), '[ \t\x{{00a0}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10)||chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = "list_filter(regexp_extract_all(lower({t}), '[a-z][a-z0-9+#_.-]+'), lambda w: length(w) > 2 and w not in (" + _STOP + "))"


def _terms_sql(source: str, key: str, limit: int) -> str:
    return f"""select {key}, rank, term, n from (select *, row_number() over (partition by {key} order by n desc, length(term) desc, first_) rank from (
      select {key}, term, count(*) n, min(pos) first_ from (select {key}, unnest(w) term, unnest(range(len(w))) pos from (select {key}, {_TOKENS.format(t='text')} w from {source})) group by all)) where rank <= {limit}"""


# Sentences are found by marks put behind them, then packed by a recursion over their positions.
def chunks_sql(source: str, before: str = "") -> str:
    return f"""with recursive {before}d as (select doc_id, {NORM.format(t='text')} t from {source}),
  long_ as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([。！？!?；;：:])\\s*', '\\1' || chr(1), 'g'), '\\.\\s+([A-Z(])', '.' || chr(1) || '\\1', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') s from d where length(t) > {BUDGET}),
  p(doc_id, i, n, s, buf, done) as (
    select doc_id, 0, len(s), s, '', []::varchar[] from long_
    union all
    select doc_id, i + 1, n, s,
      case when length(s[i + 1]) > {BUDGET} then '' when buf <> '' and length(buf) + length(s[i + 1]) > {BUDGET} then s[i + 1] else buf || s[i + 1] end,
      case when length(s[i + 1]) > {BUDGET} then (case when buf <> '' then [buf] else [] end) || list_transform(range(0, ((length(s[i + 1]) - 1) // {BUDGET} + 1)::bigint), lambda k: substr(s[i + 1], (k * {BUDGET} + 1)::bigint, {BUDGET}))
        when buf <> '' and length(buf) + length(s[i + 1]) > {BUDGET} then [buf] else [] end
    from p where i < n),
  q as (select doc_id, i, unnest(done) piece, unnest(range(len(done))) j from p union all select doc_id, n + 1, buf, 0 from p where i = n and buf <> ''),
  r as (select doc_id, piece, row_number() over (partition by doc_id order by i, j) k, count(*) over (partition by doc_id) m from q),
  z(doc_id, k, m, buf, done) as (
    select doc_id, k, m, piece, null::varchar from r where k = 1
    union all
    select z.doc_id, r.k, z.m, case when length(z.buf) + length(r.piece) + 1 > {BUDGET} then r.piece else z.buf || chr(10) || r.piece end, case when length(z.buf) + length(r.piece) + 1 > {BUDGET} then z.buf end
    from z join r on r.doc_id = z.doc_id and r.k = z.k + 1),
  c as (select doc_id, k, done text from z where done is not null union all select doc_id, m + 1, buf from z where k = m
    union all select doc_id, 0, t from d where t <> '' and length(t) <= {BUDGET}),
  chunk as (select doc_id, row_number() over (partition by doc_id order by k) - 1 idx, regexp_replace(text, '^[ \\n]+|[ \\n]+$', '', 'g') text from c)
"""


_CHUNKS = chunks_sql("documents")
_MACROS = r"\\(?:frac|sum|argmax|argmin|mathbb|mathcal|hat|theta|alpha|beta|nabla|prod|int|sqrt|log|exp|softmax)\b"
TYPE_SQL = rf"""case when trim({{t}}) = '' then 'paragraph' when regexp_matches({{t}}, '(?s)\$\$.*\$\$|\\begin\{{{{(?:equation|align|gather|eqnarray)') or (len(regexp_extract_all({{t}}, '{_MACROS}')) >= 2 and length({{t}}) < 600) then 'formula'
  when regexp_matches(trim({{t}}), '^图注[:：]|^Figure\s*[0-9]+|^图\s*[0-9]+\s*[:：]') then 'figure' when regexp_matches(trim({{t}}), '^表\s*[0-9]+|(?i:^Table\s*[0-9]+)|(?m:^\|.+\|$)') then 'table'
  when regexp_matches({{t}}, '(?m)^\s*[-*·]\s+') and len(string_split({{t}}, chr(10))) > 2 then 'list' else 'paragraph' end"""


def _date_sql(t: str) -> str:
    month = lambda p: f"case when regexp_extract({t}, '{p}', 1) = '' then null else regexp_extract({t}, '{p}', 1)::int || '年' || regexp_extract({t}, '{p}', 2)::int || '月' end"
    named = rf"(?i)[0-9]{{1,2}}\s+({'|'.join(X.MONTHS)})[a-z]*\s+(20[0-9]{{2}})"
    names = ", ".join(f"'{m}'" for m in X.MONTHS)
    by_name = f"case when regexp_extract({t}, '{named}', 2) = '' then null else regexp_extract({t}, '{named}', 2) || '年' || list_position([{names}], lower(regexp_extract({t}, '{named}', 1))) || '月' end"
    return f"coalesce({month(r'(20[0-9]{2})\s*年\s*([0-9]{1,2})\s*月')}, {by_name}, {month(r'(20[0-9]{2})[-/.]([0-9]{1,2})')}, '')"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rules_sql(t: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    return t


def _counts_sql(name: str) -> tuple[str, list[str]]:
    """Select list that takes the words of a list from w0 one after the other, and how often each was there."""
    steps, counts, at = [], [], "w0"
    for i, w in enumerate(S.in_order(name)):
        counts.append(f"((length({at}) - length(replace({at}, {quoted(w)}, ''))) // {len(w)})")
        if name != S.OVERLAPPING:
            steps.append(f"replace({at}, {quoted(w)}, chr(1)) w{i + 1}")
            at = f"w{i + 1}"
    return "".join(", " + x for x in steps), counts


def hits_sql(source: str, key: str) -> str:
    out = []
    for name in S.WORD_LISTS:
        steps, counts = _counts_sql(name)
        hits = ", ".join(f"{{'word': {quoted(w)}, 'n': {n}, 'pos': {i}}}" for i, (w, n) in enumerate(zip(S.in_order(name), counts, strict=True)))
        out.append(f"select {key}, '{name}' list, unnest([{hits}]) h from (select {key}, w0{steps} from w)")
    ranked = f"select {key}, list, row_number() over (partition by {key}, list order by h.n desc, h.pos) rank, h.word word, h.n::bigint n from ({' union all '.join(out)}) where h.n > 0"
    return f"with w as (select {key}::bigint {key}, {rules_sql("coalesce(text, '')", S.PLAIN_RULES)} w0 from {source}) {ranked}"


def _phrases_sql() -> str:
    pick = lambda name, k: f"[{', '.join(map(quoted, S.WORD_LISTS[name]))}][doc_id // {k} % {len(S.WORD_LISTS[name])} + 1]"
    added = " || ".join(f"case when doc_id % {i + 2} = 0 then {pick(name, 1)} || '，' || {pick(name, 3)} || '。' || {pick(name, 1)} else '' end" for i, name in enumerate(S.WORD_LISTS))
    return f"(select doc_id, coalesce(text, '') || chr(10) || chr(10) || {added} as text from documents)"


def _metrics_sql() -> str:
    style = lambda q: _STYLE.format(t=q)
    mean = lambda a: f"case when len({a}) = 0 then 0.0 else floor(list_sum({a}) / len({a}) * 10 + 0.5) / 10 end::double"
    marks = ", ".join(f"len(regexp_extract_all(w0, {quoted(p)}))::bigint {name}" for name, p in STYLE_MARKS.items())
    lists = ", ".join(f"coalesce((select sum(n) from h where h.doc_id = x.doc_id and list = '{name}'), 0)::bigint {name}" for name in S.WORD_LISTS)
    return rf"""with h as ({hits_sql("documents", "doc_id")}), x as (select doc_id, text, w0, list_filter(list_transform(string_split_regex(w0, '\n\s*\n'), lambda q: {style("q")}), lambda n: n > 0) p,
        list_filter(list_transform(string_split_regex(w0, '[。！？!?；;\n]+'), lambda q: {style("q")}), lambda n: n > 1) s from (select doc_id, text, {rules_sql("coalesce(text, '')", S.PLAIN_RULES)} w0 from documents)),
      m as (select doc_id, {style("w0")}::bigint chars, len(p)::bigint paragraphs, {mean("p")} paragraph_mean, coalesce(list_max(p), 0)::bigint paragraph_max, len(s)::bigint sentences, {mean("s")} sentence_mean, coalesce(list_max(s), 0)::bigint sentence_max,
        {marks}, len(regexp_extract_all(coalesce(text, ''), {quoted(BOLD)}))::bigint bold, {lists} from x)
      select *, {" + ".join(S.VOICE)} voice, case when chars = 0 then 0.0 else floor(first_person / chars * 100 * 10 + 0.5) / 10 end::double first_person_per_100,
        case when chars = 0 then 0.0 else floor(({" + ".join(S.VOICE)}) / chars * 1000 * 100 + 0.5) / 100 end::double voice_per_1k from m"""


_STYLE = r"length(regexp_replace({t}, '[\s*_#>`~|]', '', 'g'))"
QUERIES = {f.__name__: f for f in (normalized, lengths, number_mentions, top_terms, chunks, chunk_terms, structure_stats, glossary, related, style_metrics, word_hits, hit_previews, mentions, manifest, source_summary)}
SQL = {
    "normalized": f"select doc_id, length(t)::bigint chars, md5(t) text_md5 from (select doc_id, {NORM.format(t='text')} t from documents)",
    "lengths": rf"select doc_id, length(regexp_replace(text, '\s', '', 'g'))::bigint visible, {_STYLE.format(t='text')}::bigint style, len(regexp_extract_all(text, '[一-鿿]'))::bigint chinese from documents",
    "number_mentions": r"select doc_id, pos - 1 pos, number from (select doc_id, number, row_number() over (partition by doc_id order by first_) pos from (select doc_id, number, min(i) first_ from (select doc_id, regexp_replace(unnest(m), '\s+', '', 'g') number, unnest(range(len(m))) i from (select doc_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?\s*(?:%|％|万|亿|k|K|M|B|x|×|倍)?') m from documents)) group by all))",
    "top_terms": _terms_sql("documents", "doc_id", TOP_TERMS),
    "chunks": _CHUNKS + f"select doc_id, idx::bigint idx, 'c' || (idx + 1) chunk_id, length(text)::bigint chars, {TYPE_SQL.format(t='text')} as type, md5(text) text_md5 from chunk",
    "chunk_terms": _CHUNKS + _terms_sql("chunk", "doc_id, idx", 5),
    "structure_stats": _CHUNKS + "select doc_id, count(*)::bigint chunk_count, sum(length(text))::bigint chars, max(length(text))::bigint longest from chunk group by doc_id",
    "glossary": f"select term, count(*)::bigint n from (select unnest({_TOKENS.format(t='text')}) term from documents) group by term",
    "related": f"""with a as ({_terms_sql('benchmark', 'item_id', TOP_TERMS)}), b as ({_terms_sql('documents', 'doc_id', TOP_TERMS)}),
      w as (select item_id, unnest(list_distinct(list_filter(string_split_regex(lower(left(string_split(coalesce(text, ''), chr(10))[1], {TITLE_CHARS})), '[^a-z0-9一-鿿]+'), lambda w: length(w) >= 3))) word from benchmark),
      t as (select doc_id, lower(left(string_split(coalesce(text, ''), chr(10))[1], {TITLE_CHARS})) title from documents),
      s as (select item_id, doc_id, sum(points) score from (select item_id, doc_id, 2 points from a join b using (term) union all select item_id, doc_id, 1 from w join t on contains(title, word)) group by all)
      select item_id, rank, doc_id, score::bigint score from (select *, row_number() over (partition by item_id order by score desc, doc_id desc) rank from s) where rank <= 3""",
    "style_metrics": _metrics_sql(),
    "word_hits": hits_sql(_phrases_sql(), "doc_id"),
    "hit_previews": f"""select doc_id, list, string_agg(word || '×' || n, '、' order by rank) filter (rank <= case list {" ".join(f"when '{k}' then {v}" for k, v in PREVIEWS.items())} end) preview, sum(n)::bigint total
      from ({hits_sql(_phrases_sql(), "doc_id")}) group by all""",
    "mentions": rf"""with x as (select doc_id, text, regexp_extract(text, '^(?:\s*\S){{0,100}}') h, regexp_extract(text, '^(?:\s*\S){{0,300}}') c, {_date_sql('text')} as date from documents)
      select doc_id, date, regexp_extract(text, '([0-9]{{4}}\.[0-9]{{4,5}})(?:v[0-9]+)?', 1) paper, md5(h) head_md5, md5(case when c = text then text when regexp_extract(c, '(?s)^.*[。！？!?；;\n]') <> '' and length(c) - length(regexp_extract(c, '(?s)^.*[。！？!?；;\n]')) < 80 then regexp_extract(c, '(?s)^.*[。！？!?；;\n]') else c end) lead_md5 from x""",
    "manifest": "select doc_id, source, length(text)::bigint text_length from documents where doc_id in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)",
    "source_summary": "select source, lang, count(*)::bigint docs, sum(length(text))::bigint chars, max(doc_id)::bigint latest from documents group by all",
}
