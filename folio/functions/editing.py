"""Column functions for edited texts: typography and names of institutions. Null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import text_or_empty

# What typography leaves alone and what it rewrites.
#: Fenced code, pictures, addresses, code in a line; and the mark that stands for them meanwhile.
MARK = "\x01"
PROTECTED = r"```[\s\S]*?```|!\[[^\]]*\]\([^)]+\)|https?://[^\s\"'<>()]+|`[^`\n]+`|" + MARK
_CHINESE, _PLAIN = "[㐀-䶿一-鿿]", "[A-Za-z0-9]"
TYPOGRAPHY = [(f"({_CHINESE})({_PLAIN})", "$1 $2"), (f"({_PLAIN})({_CHINESE})", "$1 $2"), ('"([^"\n]{1,80})"', "“$1”"), ("'([^'\n]{1,40})'", "‘$1’")]

# Words that end a name of an institution in English, and in Chinese, and names known without one.
INSTITUTION_ENDS = "University Institute College Academy Laboratory Labs School Research".split()
INSTITUTION_ENDS_CHINESE = "大学 学院 研究院 研究所 实验室 科学院".split()
KNOWN_INSTITUTIONS = "Google Microsoft OpenAI DeepMind Meta Facebook Amazon IBM NVIDIA Huawei Tencent Alibaba Baidu ByteDance Apple Anthropic Mistral Cohere Intel Samsung Adobe Salesforce".split()
INSTITUTIONS = [
    rf"\b[A-Z][\w-]*(?:\s+[A-Z][\w-]*){{0,2}}\s+(?:{'|'.join(INSTITUTION_ENDS)})\b",
    r"\b(?:University|Institute)\s+of\s+[A-Z][\w-]*(?:\s+[A-Z][\w-]*){0,3}",
    rf"(?i)\b(?:{'|'.join(KNOWN_INSTITUTIONS)})\b",
    f"[一-鿿]{{2,12}}(?:{'|'.join(INSTITUTION_ENDS_CHINESE)})",
]
# Addresses and their labels, which are no part of a name, and where names are looked for.
CONTACTS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?i)\bEmail\b[^,，\s]*"]
FRONT = 3000


def typography(text: Column) -> Column:
    """A space between Chinese and Latin, curly quotes for straight pairs; what PROTECTED matches stays as it is."""
    t = F.regexp_replace(text_or_empty(text), "\r\n?", "\n")
    kept = F.regexp_extract_all(t, F.lit(PROTECTED), F.lit(0))
    t = F.regexp_replace(t, PROTECTED, MARK)
    for pattern, by in TYPOGRAPHY:
        t = F.regexp_replace(t, pattern, by)
    return F.array_join(F.zip_with(F.split(t, MARK, -1), kept, lambda part, own: F.concat(part, F.coalesce(own, F.lit("")))), "")


def _ascii_edges(pattern: str) -> str:
    """`\\b` beside ASCII words alone, so that a name may stand beside Chinese."""
    head, *rest = pattern.split(r"\b")
    return head + "".join((r"(?<!\w)" if i == 0 else r"(?!\w)") + part for i, part in enumerate(rest))


def institutions(text: Column, front: int | None = FRONT, most: int = 3) -> Column:
    """At most `most` names joined by 、 from the first `front` characters (None: all), without those inside a longer one."""
    t = text_or_empty(text)
    for pattern in CONTACTS:
        t = F.regexp_replace(t, _ascii_edges(pattern), " ")
    t = t if front is None else F.substring(t, 1, front)
    # Bound to a variable, the cleaned text is computed once rather than for each pattern.
    in_text = lambda x: F.flatten(F.array(*(F.regexp_extract_all(x, F.lit(_ascii_edges(p)), F.lit(0)) for p in INSTITUTIONS)))
    found = F.transform(F.array(t), in_text)[0]
    return F.array_join(F.slice(F.aggregate(found, F.array().cast("array<string>"), _add_name, _longest), 1, most), "、")


def _add_name(names: Column, name: Column) -> Column:
    return F.when(F.exists(names, lambda n: F.lower(n) == F.lower(name)), names).otherwise(F.concat(names, F.array(name)))


def _longest(names: Column) -> Column:
    return F.filter(names, lambda t: ~F.exists(names, lambda o: (o != t) & F.contains(F.lower(o), F.lower(t))))
