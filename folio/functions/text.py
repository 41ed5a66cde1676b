"""Column functions over text: lengths, sentences, tokens, terms, dates. Null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms of a text.
STOP_WORDS = "the a an and or of to in for with on at by from as is are was were be been this that these those we our it its their they them he she his her not but also can may".split()
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_text(text: Column) -> Column:
    """Line ends as LF, runs of blanks as one, none beside LF, at most one empty line."""
    t = F.regexp_replace(text_or_empty(text), "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t\u00a0]+", " ")
    t = F.regexp_replace(t, " *\n *", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, "^[ \n]+|[ \n]+$", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it, also within lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


#: So many states are found together, so that adding one to those found copies few.
SCAN_GROUP = 256


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """The states of a fold over an array, one behind each item, or those that `keep` tells. `items` is named in lambdas: bind it first."""
    none = F.filter(F.array(start), lambda _: F.lit(False))

    def along(group: Column, state: Column) -> Column:
        first = F.struct(state.alias("at"), none.alias("out"))
        return F.aggregate(group, first, lambda s, x: bound(step(s["at"], x), lambda at: F.struct(at.alias("at"), out(s["out"], at).alias("out"))))

    def out(before: Column, at: Column) -> Column:
        more = F.concat(before, F.array(at))
        return F.when(keep(at), more).otherwise(before) if keep else more

    starts = F.sequence(F.lit(0), F.floor(F.size(items) / SCAN_GROUP).cast("int"))
    groups = F.transform(starts, lambda k: F.slice(items, k * SCAN_GROUP + 1, F.lit(SCAN_GROUP)))
    whole = F.struct(start.alias("at"), F.filter(F.array(none), lambda _: F.lit(False)).alias("out"))
    add = lambda s, group: bound(along(group, s["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))
    return F.flatten(F.aggregate(groups, whole, add)["out"])


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text_or_empty(text), r"\s", "")).cast("long")


def style_length(text: Column) -> Column:
    """Length without white space and Markdown signs."""
    return F.length(F.regexp_replace(text_or_empty(text), r"[\s*_#>`~|]", "")).cast("long")


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.lit(0)).cast("long")


def numbers(text: Column) -> Column:
    """Distinct numbers with their unit, in order of appearance."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(r"[0-9]+(?:[.,][0-9]+)?\s*(?:%|％|万|亿|k|K|M|B|x|×|倍)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def tokens(text: Column) -> Column:
    """Latin words of three letters or more that are no stop words, then pairs of neighbouring Chinese characters."""
    low = F.lower(text_or_empty(text))
    latin = F.filter(F.regexp_extract_all(low, F.lit("[a-z][a-z0-9+#_.-]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    runs = F.regexp_extract_all(low, F.lit("[\u4e00-\u9fff]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin, pairs)


def sentences(text: Column) -> Column:
    """Parts behind sentence signs, and behind a full stop before a capital or bracket."""
    return clean_sentences(normalize_text(text))


def clean_sentences(text: Column) -> Column:
    """As above, of text in normal form."""
    parts = F.split(text, r"(?<=[。！？!?；;：:])\s*|(?<=\.)\s+(?=[A-Z(])")
    # not F.trim by itself: a place in the array would go to it as the characters to take off
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def pack_sentences(text: Column, budget: int) -> Column:
    """Consecutive sentences of text in normal form joined into pieces of at most `budget` characters; a longer sentence is cut."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), F.lit("").alias("buf"))

    def add(state: Column, s: Column) -> Column:
        out, buf = state["out"], state["buf"]
        flushed = F.when(buf != "", F.concat(out, F.array(buf))).otherwise(out)
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / budget).cast("int")), lambda i: F.substring(s, i * budget + 1, F.lit(budget)))
        return (
            F.when(F.length(s) > budget, F.struct(F.concat(flushed, slices).alias("out"), F.lit("").alias("buf")))
            .when((buf != "") & (F.length(buf) + F.length(s) > budget), F.struct(flushed.alias("out"), s.alias("buf")))
            .otherwise(F.struct(out.alias("out"), F.concat(buf, s).alias("buf")))
        )

    return F.aggregate(clean_sentences(text), start, add, lambda z: F.when(z["buf"] != "", F.concat(z["out"], F.array(z["buf"]))).otherwise(z["out"]))


def join_pieces(pieces: Column, budget: int) -> Column:
    """Consecutive pieces joined by LF while they fit the budget."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(state: Column, s: Column) -> Column:
        out, buf = state["out"], state["buf"]
        full = (buf != "") & (F.length(buf) + F.length(s) + 1 > budget)
        return F.struct(
            F.when(full, F.concat(out, F.array(F.regexp_replace(buf, "^[ \n]+|[ \n]+$", "")))).otherwise(out).alias("out"),
            F.when((buf == "") | full, s).otherwise(F.concat(buf, F.lit("\n"), s)).alias("buf"),
        )

    return F.aggregate(pieces, start, add, lambda z: F.when(z["buf"] != "", F.concat(z["out"], F.array(F.regexp_replace(z["buf"], "^[ \n]+|[ \n]+$", "")))).otherwise(z["out"]))


def split_by_budget(text: Column, budget: int) -> Column:
    return split_clean(normalize_text(text), budget)


def split_clean(clean: Column, budget: int) -> Column:
    """As above, of text in normal form: name that in a projection of its own first, or it is computed for each use."""
    blocks = F.filter(F.split(clean, "\n{2,}"), lambda b: b != "")
    cut = join_pieces(F.flatten(F.transform(blocks, lambda b: pack_sentences(b, budget))), budget)
    return F.when(clean == "", F.array().cast("array<string>")).when(F.length(clean) <= budget, F.array(clean)).otherwise(cut)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), r"^\s+|\s+$", "")


def block_type(text: Column, otherwise: str = "paragraph") -> Column:
    """formula, figure, table or list by its marks, in this order."""
    return trimmed_type(trimmed(text), otherwise)


def trimmed_type(t: Column, otherwise: str = "paragraph") -> Column:
    """As above, of text without white space around it."""
    macros = r"\\(?:frac|sum|argmax|argmin|mathbb|mathcal|hat|theta|alpha|beta|nabla|prod|int|sqrt|log|exp|softmax)\b"
    formula = t.rlike(r"(?s)\$\$.*\$\$|\\begin\{(?:equation|align|gather|eqnarray)") | ((count_matches(t, macros) >= 2) & (F.length(t) < 600))
    return (
        F.when(t == "", otherwise)
        .when(formula, "formula")
        .when(t.rlike(r"^图注[:：]|^Figure\s*[0-9]+|^图\s*[0-9]+\s*[:：]"), "figure")
        .when(t.rlike(r"^表\s*[0-9]+|(?i)^Table\s*[0-9]+|(?m)^\|.+\|$"), "table")
        .when(t.rlike(r"(?m)^\s*[-*·]\s+") & (F.size(F.split(t, "\n")) > 2), "list")
        .otherwise(otherwise)
    )


def iso_month(text: Column) -> Column:
    """`2026-01...` as 2026年1月; empty without a date."""
    return _month(text_or_empty(text), "([0-9]{4})-([0-9]{2})")


def pdf_month(text: Column) -> Column:
    return _month(text_or_empty(text), "D:([0-9]{4})([0-9]{2})[0-9]{2}")


def _month(t: Column, pattern: str) -> Column:
    year, month = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    return F.when(year == "", "").otherwise(F.concat(year.try_cast("int").cast("string"), F.lit("年"), month.try_cast("int").cast("string"), F.lit("月")))


def first_date(text: Column) -> Column:
    """The first date in the forms 2023年8月, 12 Jun 2017 and 2017-06, tried in this order."""
    t = text_or_empty(text)
    named = rf"(?i)[0-9]{{1,2}}\s+({'|'.join(MONTHS)})[a-z]*\s+(20[0-9]{{2}})"
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(t, named, 1)))
    by_name = F.when(F.regexp_extract(t, named, 2) == "", "").otherwise(F.concat(F.regexp_extract(t, named, 2), F.lit("年"), number.cast("string"), F.lit("月")))
    tries = [_month(t, r"(20[0-9]{2})\s*年\s*([0-9]{1,2})\s*月"), by_name, _month(t, r"(20[0-9]{2})[-/.]([0-9]{1,2})")]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in tries), F.lit(""))


def rate(text: Column) -> Column:
    """`+8%` as 1.08, a plain number as itself, anything else as 1."""
    t = F.trim(text_or_empty(text))
    share = F.regexp_extract(t, r"^([+-]?[0-9]+(?:\.[0-9]+)?)%$", 1)
    plain = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)$", 1)
    return F.when(share != "", 1 + share.try_cast("double") / 100).when(plain != "", plain.try_cast("double")).otherwise(F.lit(1.0))


def truncate_visible(text: Column, n: int) -> Column:
    """The first n characters that are no white space, with the white space before each."""
    return F.regexp_extract(text_or_empty(text), rf"^(?:\s*\S){{0,{n}}}", 0)


def truncate_at_sentence(text: Column, n: int) -> Column:
    """As above, and back to the last sentence sign if that loses less than 80 characters."""
    t, cut = text_or_empty(text), truncate_visible(text, n)
    ended = F.regexp_extract(cut, r"(?s)^.*[。！？!?；;\n]", 0)
    return F.when(cut == t, t).when((ended != "") & (F.length(cut) - F.length(ended) < 80), ended).otherwise(cut)


def paper_id(url: Column) -> Column:
    """`1706.03762` from addresses of abstracts, PDFs and HTML editions, or from any text; without a version."""
    return F.regexp_extract(text_or_empty(url), r"([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?", 1)


# Rules that take marks of Markdown away, in this order. Lines end at LF alone.
_BLANK = r"[ \t\f\x0B\u00a0]"
PLAIN_MARKDOWN = [
    ("\r\n?", "\n"),
    (rf"(?md)^{_BLANK}*#{{1,4}}{_BLANK}+", ""),
    (rf"(?md)^{_BLANK}*>{_BLANK}?", ""),
    (rf"(?md)^{_BLANK}*[-*]{_BLANK}+", "• "),
    (rf"(?md)^{_BLANK}*[0-9]+[.)]{_BLANK}+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\$\$([^$]+?)\$\$", "$1"),
    (r"\$([^$\n]+?)\$", "$1"),
    (r"^[ \t\n\r\f\x0B\u00a0]+|[ \t\n\r\f\x0B\u00a0]+\z", ""),
]


def plain_markdown(text: Column) -> Column:
    """Headings of up to four signs, quotes, list marks and numbers, emphasis, code and formula marks removed."""
    t = text_or_empty(text)
    for pattern, by in PLAIN_MARKDOWN:
        t = F.regexp_replace(t, pattern, by)
    return t


def count_phrase(text: Column, phrase: str) -> Column:
    """How often the phrase occurs, without overlaps, as it is written."""
    t = text_or_empty(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def count_phrases(text: Column, phrases: list[str]) -> list[tuple[str, Column]]:
    """Counts of phrases where a longer phrase's places don't count for those inside it."""
    t, out = text_or_empty(text), []
    for p in sorted(phrases, key=lambda p: -len(p)):
        out.append((p, count_phrase(t, p)))
        t = F.replace(t, F.lit(p), F.lit("\x01" * len(p)))
    return out


def ranked_terms(text: Column, limit: int) -> Column:
    """The most frequent terms within a text as structs of term and n, by count, then length, then first place: runs of its sorted
    tokens, no shuffle."""

    def counted(sorted_: Column) -> Column:
        size = F.size(sorted_)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(sorted_, i)["term"] != F.get(sorted_, i - 1)["term"]))
        return bound(starts, lambda s: F.transform(F.slice(F.sort_array(runs(sorted_, s)), 1, limit), lambda r: F.struct(r["term"].alias("term"), (-r["n"]).cast("long").alias("n"))))

    def runs(sorted_: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(sorted_)))
        return F.zip_with(starts, ends, lambda a, b: bound(F.get(sorted_, a), lambda x: F.struct((a - b).alias("n"), (-F.length(x["term"])).alias("size"), x["pos"].alias("pos"), x["term"].alias("term"))))

    placed = F.sort_array(F.transform(tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    # bound once; an array without tokens has no runs
    return F.flatten(F.transform(F.filter(F.array(placed), lambda s: F.size(s) > 0), lambda s: counted(s)))


def terms_of(text: Column, limit: int) -> Column:
    return F.transform(ranked_terms(text, limit), lambda r: r["term"])
