"""Column functions that take something out of a text: terms, titles, headings, summaries, JSON. Null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import bound, text_or_empty, truncate_visible, visible_length

# Words that are no terms when they stand alone.
NO_TERMS = (
    "the and for with are was were this that these those from into over under between during before after above below their them they our your its but not can may will would should could been being have has had "
    "does did where when which while figure table section equation abstract introduction method methods related work works results result conclusion conclusions references appendix available code data we propose "
    "proposed based show shows shown our new first second finally however moreover therefore thus also yet using used use provides provided compared comparison experiments experimental benchmark benchmarks state art "
    "university institute google microsoft openai deepmind meta email one two three four five both each all some such other another same different several many most more less only very just too present paper study "
    "author authors et al following figure fig tab table tables"
).split()
# Acronyms and words in title case, and how many terms are kept.
ACRONYM = r"\b[A-Z]{2,8}\b"
TITLED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"
MOST_TERMS = 60

# What a paper's first page has before its title, where a Chinese head ends, and what is cut from it.
BEFORE_TITLE = [r"(?i)^arxiv\s*:\s*[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?\s*(\[[^\]]*\])?[^A-Za-z一-鿿]*", r"(?i)provided proper attribution is provided[^.]*\.\s*"]
HEAD_END = r"(?i)[\w.+-]+@[\w.-]+|\babstract\b|摘要|关键词|arxiv\s*:|https?://"
HEAD_DATES = [r"\b[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日", r"\b[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b"]
CHINESE_TITLE = r"^([一-鿿\s·、，,：:]*[A-Za-z][\w-]*)(?:\s+[\s\S]*)?$"
CASED_TITLE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){2,4})\b"
UPPER_TITLE = r"\b([A-Z]{3,}(?:\s+[A-Z]{3,}){1,12})\b"

# Sections of a summary with their signs, and forms of a link at its end.
SIGNS = [("一句话总结", "🎯"), ("背景", "📖"), ("核心方法", "⚙️"), ("结果", "📊"), ("局限与结论", "⚖️")]
LINK_ENDS = [r"(?i)\n*\s*#{2,3}\s*论文链接[\s\S]*$", r"(?i)\n*\s*(?:链接|原文链接|论文地址)\s*[:：]?\s*https?://\S+\s*$", r"(?i)\n*\s*https?://\S+\s*$"]
SUMMARY = r"一句话总结[^\n]*\n\s*([^\n]+)"
CODE_ADDRESS, NO_CODE = r"(?i)https?://github\.com/[A-Za-z0-9_.\-/]+", r"(?i)github\.com/arXiv/|html_feedback|LaTeXML"

EDGES = r"^\s+|\s+$"


def ascii_words(pattern: str) -> str:
    """`\\b` beside ASCII words alone, as other engines take it: Java counts all letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def letter_words(pattern: str) -> str:
    """As above, of a pattern that starts and ends with letters: half of each border is plain then."""
    return r"(?<!\w)" + pattern.removeprefix(r"\b").removesuffix(r"\b") + r"(?!\w)"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, EDGES, "")


def one_line(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def terms(text: Column, most: int = MOST_TERMS) -> Column:
    """Acronyms, then words or phrases in title case; each once whatever its case, in its first form."""
    t = text_or_empty(text)
    found = F.concat(*(F.regexp_extract_all(t, F.lit(ascii_words(p)), F.lit(0)) for p in (ACRONYM, TITLED)))

    def first_forms(both: Column) -> Column:
        kept = F.slice(F.filter(F.array_distinct(both["keys"]), lambda k: (F.length(k) >= 2) & ~k.isin(NO_TERMS)), 1, most)
        return F.transform(kept, lambda k: F.element_at(both["found"], F.array_position(both["keys"], k).cast("int")))

    # Within a lambda a column would be computed again for each element, a field of its variable isn't.
    return F.transform(F.array(F.struct(found.alias("found"), F.transform(found, F.lower).alias("keys"))), first_forms)[0]


def title(text: Column) -> Column:
    """A title from a paper's text: its Chinese head, else three to five words in title case, else words in capitals, else its first piece."""
    t = text_or_empty(text)
    for pattern in BEFORE_TITLE:
        t = F.regexp_replace(t, pattern, "")

    def head_of(t: Column) -> Column:
        # an address is looked for at the starts of runs of its signs alone, where the first one is found
        head = F.split(t, ascii_words(HEAD_END.replace(r"[\w.+-]+@", r"(?<![\w.+-])[\w.+-]++@", 1)), 2)[0]
        for pattern in HEAD_DATES:
            head = F.regexp_replace(head, ascii_words(pattern), "")
        # only a head with Chinese in it is a title
        return F.when(t.rlike("[一-鿿]"), bound(head, lambda head: F.when(head.rlike("[一-鿿]"), strip(head))))

    def chosen(both: Column) -> Column:
        t, head = both["t"], both["head"]
        cut = bound(F.regexp_extract(head, CHINESE_TITLE, 1), lambda cut: one_line(F.when(cut != "", cut).otherwise(head)))
        chinese = bound(cut, lambda c: F.when(F.length(c).between(2, 80), c))
        found = [bound(F.regexp_extract(t, letter_words(p), 1), lambda w: F.when(w != "", w)) for p in (CASED_TITLE, UPPER_TITLE)]
        piece = F.filter(F.split(t, r"\s{2,}"), lambda s: (F.length(s) > 2) & (F.length(s) < 140))
        # each form is tried where those before it found nothing
        return F.coalesce(chinese, *found, F.left(F.coalesce(F.get(piece, F.lit(0)), t), F.lit(100)))

    # Bound, the text and its head are computed once rather than for each of their uses.
    return bound(strip(t), lambda t: bound(F.struct(t.alias("t"), head_of(t).alias("head")), chosen))


def truncate_title(text: Column, most: int) -> Column:
    """At most `most` visible characters, without a torn Latin word or a sign at the end."""
    t = one_line(text_or_empty(text))
    cut = truncate_visible(t, most)
    torn = F.substring(t, F.length(cut) + 1, F.lit(1)).rlike("[A-Za-z0-9]") & cut.rlike(r"\s\S*[A-Za-z0-9]$")
    whole = F.trim(F.when(torn, F.regexp_replace(cut, r"\s\S*$", "")).otherwise(cut))
    bare = F.trim(F.regexp_replace(whole, "[，,、：:；;！!？?。]+$", ""))
    return F.when(visible_length(t) <= most, t).when(bare != "", bare).otherwise(cut)


def first_sentences(text: Column, n: int) -> Column:
    parts = F.filter(F.split(F.regexp_replace(text_or_empty(text), r"\s+", " "), "(?<=[。！？!?；;])"), lambda s: F.trim(s) != "")
    return F.trim(F.array_join(F.slice(parts, 1, n), ""))


def with_signs(text: Column) -> Column:
    """Headings of known sections get their sign; those that have it stay."""
    t = text_or_empty(text)
    for name, sign in SIGNS:
        t = F.regexp_replace(t, rf"(#{{2,3}}\s*){name}", f"$1{sign} {name}")
    return t


def without_link(text: Column) -> Column:
    """Without a section of links or a bare address at the end."""
    t = text_or_empty(text)
    for pattern in LINK_ENDS:
        t = F.regexp_replace(t, pattern, "")
    return F.regexp_replace(t, r"\s+$", "")


def summary_line(text: Column) -> Column:
    return F.trim(F.regexp_extract(text_or_empty(text), SUMMARY, 1))


def code_address(text: Column) -> Column:
    """The first address of a repository of code that isn't a tool's own; empty if there is none."""
    found = F.filter(F.regexp_extract_all(text_or_empty(text), F.lit(CODE_ADDRESS), F.lit(0)), lambda u: ~u.rlike(NO_CODE))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def loose_json(text: Column) -> Column:
    """The first part of an answer that is JSON: all of it, what a fence holds, from the first brace or bracket to the last; each
    tried again without commas before a closing one and without control characters. Null if there is none, or if an object
    names a key twice."""
    t = strip(text_or_empty(text))
    parts = [t, strip(F.regexp_extract(t, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1)), F.regexp_extract(t, r"\{[\s\S]*\}", 0), F.regexp_extract(t, r"\[[\s\S]*\]", 0)]
    tidy = lambda p: F.regexp_replace(F.regexp_replace(p, r",\s*([}\]])", "$1"), r"[\x00-\x1f]+", " ")
    tries = F.array(*(x for p in parts for x in (p, tidy(p))))

    def valid(p: Column) -> Column:
        listed = F.concat(F.lit("["), p, F.lit("]"))  # what follows the first value would go unseen
        return F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1)

    return F.get(F.filter(tries, valid), F.lit(0))
