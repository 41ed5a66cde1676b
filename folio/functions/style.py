"""Column functions for style: text without Markdown, and hits of word lists. Null text counts as empty."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import bound, text_or_empty

# The lists of words, by name.
WORD_LISTS = {
    "stock": "随着 总而言之 综上所述 总的来说 本质上 更重要的是 说白了 归根结底 关键在 核心在 具有重要意义 值得关注 提供新思路 新方向 赋能 闭环 抓手 本文研究 作者提出 我们提出 值得一提的是 需要注意的是 不是……而是 不仅能 更能".split(),
    "caution": "真正 尤其 关键在于 这意味着 值得注意的是 需要注意的是 首次 革命 颠覆 最强 SOTA 碾压 下一代 已经解决".split(),
    "boundary": [*"排名 最强 下一代 已经解决 已解决 超越 碾压 证明 首次 SOTA".split(), "best method", "ranking", "state-of-the-art"],
    "fake_depth": "突出了 反映了 促进了 彰显了 体现了 表明了 展示了 凸显了".split(),
    "high_freq": "至关重要 具有里程碑意义 里程碑 不可或缺 必不可少 错综复杂 全景 见证了 彰显著 深入剖析 发挥重要作用 起到关键作用".split(),
    "chatbot": "希望对你有帮助 希望对你有所帮助 很棒的问题 这是个好问题 为了总结 期待你的回复 未来充满希望 让我们一起 如你所见".split(),
    "passive": "被视为 被认为是 被认为 被称为 需要被 能够被 可以被 被广泛 被用于 被用来 被设计为 被证明".split(),
}
#: The lists that make up the voice, and the one whose words may overlap.
VOICE = ("fake_depth", "high_freq", "chatbot", "passive")
OVERLAPPING = "stock"

# What Markdown adds to the words, taken off in this order.
PLAIN_RULES = [
    (r"```[\s\S]*?```", "\n\n"),
    (r"(?m)^\s*!\[[^\]]*\]\([^)]*\)\s*$", ""),
    (r"\$\$[\s\S]*?\$\$", " "),
    (r"\$[^$\n]*\$", " "),
    (r"(?m)^\s*#{1,6}\s+.*$", ""),
    (r"(?m)^\s*>\s?", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*[0-9]+[.)]\s+", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\*\*|__|`", ""),
]


#: What a text must hold for a rule to change it, one of each; a plain search tells so at a fraction of a rule's time.
NEEDED = [("```",), ("![",), ("$$",), ("$",), ("#",), (">",), ("-", "*", "+"), (".", ")"), ("![",), ("](",), ("**", "__", "`")]


def words_only(text: Column) -> Column:
    t = text_or_empty(text)
    for (pattern, by), needed in zip(PLAIN_RULES, NEEDED, strict=True):
        holds = lambda t, needed=needed: reduce(or_, (F.contains(t, F.lit(n)) for n in needed))
        t = bound(t, lambda t, pattern=pattern, by=by, holds=holds: F.when(holds(t), F.regexp_replace(t, pattern, by)).otherwise(t))
    return t


def in_order(name: str) -> list[str]:
    """Words of a list as they are looked for: longer ones first, so that they take their places from shorter ones."""
    return WORD_LISTS[name] if name == OVERLAPPING else sorted(WORD_LISTS[name], key=len, reverse=True)


def outside_ascii(text: Column) -> Column:
    """A text's characters outside ASCII, each run of others as one mark that no word holds."""
    return F.regexp_replace(text_or_empty(text), r"[\x00-\x7f]+", "\x01")


def word_hits(text: Column, name: str, outside: Column | None = None) -> Column:
    """Array of (word, n) of the words of a list that occur, most frequent first, then as looked for.

    Words without ASCII characters are looked for in `outside` alone, the text by `outside_ascii`: name it once for several lists.
    """
    listed = list(enumerate(in_order(name)))
    plain, others = [x for x in listed if x[1].isascii()], [x for x in listed if not any(c.isascii() for c in x[1])]
    if len(plain) + len(others) < len(listed):  # a word of both kinds may take places from either
        plain, others = listed, []
    overlap = name == OVERLAPPING
    found = lambda o: F.concat(_hits(text_or_empty(text), plain, overlap), _hits(o, others, overlap))
    hits = bound(outside_ascii(text), found) if outside is None else found(outside)
    return F.transform(F.sort_array(hits), lambda h: F.struct(h["word"].alias("word"), (-h["less"]).alias("n")))


def _hits(text: Column, listed: list[tuple[int, str]], overlap: bool) -> Column:
    """Hits of words with their places in a list. Taking words never makes another one, so only those that the text holds are taken."""
    none = F.array().cast("array<struct<less:bigint,pos:int,word:string>>")
    if not listed:
        return none
    start = F.struct(text.alias("rest"), none.alias("hits"))

    def take(state: Column, w: Column) -> Column:
        rest = state["rest"]
        bare = F.replace(rest, w["word"], F.lit(""))
        n = F.floor((F.length(rest) - F.length(bare)) / F.length(w["word"])).cast("long")
        left = rest if overlap else F.replace(rest, w["word"], F.lit("\x01"))
        hit = F.array(F.struct((-n).alias("less"), w["pos"].alias("pos"), w["word"].alias("word")))
        return F.struct(left.alias("rest"), F.when(n > 0, F.concat(state["hits"], hit)).otherwise(state["hits"]).alias("hits"))

    words = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(w).alias("word")) for i, w in listed))
    return F.aggregate(F.filter(words, lambda w: F.contains(text, w["word"])), start, take, lambda s: s["hits"])


def total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["n"])
