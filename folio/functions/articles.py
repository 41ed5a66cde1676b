"""Blocks of a page under its headings, and a page's article with what its head says of it, both from its tree."""

from __future__ import annotations

import re

from folio.functions.tree import Tree, normal

# Elements that are no content, headings by class, the names of blocks, and how much of a table is kept.
NO_CONTENT = frozenset("script style nav header footer aside noscript".split())
HEADING_CLASS = re.compile(r"ltx_title_section|ltx_title_subsection|ltx_title_paragraph|ltx_title_document|title_section", re.I)
SEP, BODY, CAPTION = "›", "正文", "图注："
TABLE_CHARS, HEADING_CHARS = 1200, 200
# Where a head names institution and date, the first one that does.
INSTITUTION = [("name", "citation_author_institution"), ("name", "dc.publisher"), ("name", "citation_journal_title")]
DATE = [("name", "citation_publication_date"), ("property", "article:published_time"), ("name", "date"), ("property", "og:article:published_time")]
BYLINE = [("name", "author"), ("property", "article:author"), ("name", "dc.creator")]
EXCERPT = [("property", "og:description"), ("name", "description"), ("name", "dc.description"), ("name", "twitter:description")]

#: A paragraph counts from so many characters on, and so much of its score goes to the elements around it, nearest first.
PARAGRAPH_CHARS, SHARES = 25, (1, 1 / 2, 1 / 6, 1 / 9)
#: Classes and ids that speak for or against an article, and by how much; parts that only have the latter don't count.
FOR = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
AGAINST = re.compile(r"\bad\b|banner|combx|comment|contact|footer|masthead|media|meta|menu|promo|related|share|shopping|sidebar|sponsor|widget", re.I)
WEIGHT = 25
_NUMBER = re.compile(r"^[0-9]+(\.[0-9]+)*\s*")
_SPACE = re.compile(r"\s+")


def formula(tree: Tree, node: int) -> str:
    """TeX of a formula: its annotation, else its alternative text, else its own text."""
    for note in tree.inside(node, "annotation"):
        if tree.attributes(note).get("encoding") == "application/x-tex" and (tex := tree.text(note)):
            return tex.strip()
    alt = tree.attributes(node).get("alttext")
    return alt.strip() if alt else _SPACE.sub(" ", tree.text(node)).strip()


def with_formulas(tree: Tree, node: int) -> str:
    """A subtree's text with formulas as TeX between dollar signs."""
    out, k = [], node + 1
    while k < tree.end[node]:
        if tree.tag[k] == "math":
            out.append(f" ${formula(tree, k)}$ ")
            k = tree.end[k]
            continue
        if not tree.tag[k]:
            out.append(tree.value[k])
        k += 1
    return "".join(out)


def blocks(html: str | None) -> list[dict[str, str]]:
    """path, type and text of a page's blocks in order. A heading ends those of its level and below; one of the first level before all content is the page's title."""
    tree, out, above, begun = Tree(html or ""), [], [], False

    def put(kind: str, text: str) -> None:
        nonlocal begun
        text = normal(text)
        if len(text) >= 2:
            begun |= kind != "heading"
            out.append({"path": SEP.join(t for t, _ in above) or BODY, "type": kind, "text": text})

    k = 1
    while k < tree.end[0]:
        tag = tree.tag[k]
        if not tag or tag == "head":
            k = tree.end[k]
            continue
        cls = tree.attributes(k).get("class", "") if "class" in tree.value[k].lower() else ""
        past = tree.end[k]
        if tag in NO_CONTENT or tag == "figcaption":
            k = past
            continue
        by_tag = re.fullmatch("h[1-6]", tag)
        if by_tag or (cls and HEADING_CLASS.search(cls) and len(tree.text(k).strip()) < HEADING_CHARS):
            level = int(tag[1]) if by_tag else 3 if "subsection" in cls.lower() else 2
            title = _NUMBER.sub("", normal(tree.text(k)))
            if title:
                if level > 1 or begun or above:
                    begun = True
                    while above and above[-1][1] >= level:
                        above.pop()
                    above.append((title, level))
                    put("heading", title)
                k = past
                continue
        if tag == "table" or ("ltx_table" in cls and tree.inside(k, "table")):
            captions = tree.inside(k, "figcaption") or tree.inside(k, "caption") or [c for c in range(k + 1, past) if "ltx_caption" in tree.value[c] and tree.tag[c]]
            caption = normal(with_formulas(tree, captions[0])) if captions else ""
            put("table", (caption + "\n" if caption else "") + normal(with_formulas(tree, k))[:TABLE_CHARS])
        elif tag == "figure" or "ltx_figure" in cls:
            captions = tree.inside(k, "figcaption") or [c for c in range(k + 1, past) if "ltx_caption" in tree.value[c] and tree.tag[c]]
            caption = normal(with_formulas(tree, captions[0] if captions else k))
            put("figure", CAPTION + caption if caption else "")
        elif tag == "math" or re.search("ltx_(math|equation|displaymath)", cls):
            put("formula", f"$${formula(tree, k)}$$")
        elif tag == "p" or re.search("ltx_para|ltx_abstract", cls):
            put("abstract" if "ltx_abstract" in cls else "paragraph", with_formulas(tree, k))
            for m in tree.inside(k, "math"):
                if tex := formula(tree, m):
                    put("formula", f"$${tex}$$")
        elif tag in ("ul", "ol"):
            put("list", "\n".join("- " + normal(with_formulas(tree, item)) for item in tree.inside(k, "li")))
        else:
            past = k + 1  # its children are walked
        k = past
    return out


def _named(tree: Tree, metas: list[dict[str, str]], wanted: list[tuple[str, str]]) -> str:
    for attribute, name in wanted:
        for meta in metas:
            if meta.get(attribute, "").lower() == name and (value := (meta.get("content") or meta.get("datetime") or "").strip()):
                return value
    return ""


def best_candidate(tree: Tree) -> int:
    """The element whose paragraphs hold most text for the links in it; 0, the whole page, if no paragraph counts."""
    parents, path = {}, [0]
    for k in range(1, tree.end[0]):
        while k >= tree.end[path[-1]]:
            path.pop()
        parents[k] = path[-1]
        if tree.tag[k]:
            path.append(k)
    score: dict[int, float] = {}

    def names(node: int) -> str:
        found = tree.attributes(node) if "=" in tree.value[node] else {}
        return f"{found.get('class', '')} {found.get('id', '')}"

    k = 1
    while k < tree.end[0]:
        tag = tree.tag[k]
        if tag in NO_CONTENT or tag == "head" or (tag in ("div", "section", "ul", "table") and AGAINST.search(named := names(k)) and not FOR.search(named)):
            k = tree.end[k]
            continue
        text = tree.text(k, NO_CONTENT).strip() if tag in ("p", "pre", "blockquote", "td") else tree.value[k].strip() if not tag and tree.tag[parents[k]] in ("div", "section", "article", "main", "body") else ""
        if len(text) >= PARAGRAPH_CHARS and 2 * sum(len(tree.text(a)) for a in (tree.inside(k, "a") if tag else ())) < len(text):
            points, around = 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3), parents[k]
            for share in SHARES:
                if not around:
                    break
                if around not in score:
                    named = names(around)
                    score[around] = WEIGHT * ((tree.tag[around] in ("article", "main")) + bool(FOR.search(named)) - bool(AGAINST.search(named)))
                score[around] += points * share
                around = parents[around]
            if tag:
                k = tree.end[k]
                continue
        k += 1
    # characters before each node, and those of them in links
    chars, linked = [0], [0]
    until, link_until = 0, 0
    for k in range(tree.end[0]):
        if tree.tag[k] in NO_CONTENT:
            until = max(until, tree.end[k])
        elif tree.tag[k] == "a":
            link_until = max(link_until, tree.end[k])
        size = 0 if tree.tag[k] or k < until else len(tree.value[k])
        chars.append(chars[-1] + size)
        linked.append(linked[-1] + (size if k < link_until else 0))
    best, most = 0, float("-inf")
    for node in sorted(score):
        all_, in_links = (x[tree.end[node]] - x[node] for x in (chars, linked))
        value = score[node] * (1 - (in_links / all_ if all_ else 0))
        if value > most:
            best, most = node, value
    return best


def article(html: str | None) -> dict[str, str]:
    """title, byline, excerpt, text, institution and date of a page."""
    tree = Tree(html or "")
    metas = [tree.attributes(k) for k in tree.inside(0, "meta")]
    node = best_candidate(tree)
    one_line = lambda text: _SPACE.sub(" ", text).strip()
    first = lambda *tags: next((t for k in tree.inside(0, *tags) if (t := one_line(tree.text(k)))), "")
    paragraphs = (one_line(tree.text(k)) for k in tree.inside(node, "p"))
    byline = _named(tree, metas, BYLINE) or next((t for k in range(1, tree.end[0]) if tree.tag[k] and re.search(r"\brel=[\"']?author|\bbyline\b", tree.value[k]) and (t := one_line(tree.text(k)))), "")
    times = (tree.attributes(k).get("datetime", "").strip() for k in tree.inside(0, "time"))
    return {
        "title": _named(tree, metas, [("property", "og:title")]) or first("title") or first("h1"),
        "byline": byline,
        "excerpt": _named(tree, metas, EXCERPT) or next((p for p in paragraphs if p), ""),
        "text": one_line("".join(tree.value[k] for k in _content(tree, node))),
        "institution": _named(tree, metas, INSTITUTION),
        "date": _named(tree, metas, DATE) or next((t for t in times if t), ""),
    }


def _content(tree: Tree, node: int) -> list[int]:
    """Text nodes below a node, without what is no content."""
    out, k = [], node + 1
    while k < tree.end[node]:
        if tree.tag[k] in NO_CONTENT or tree.tag[k] == "head":
            k = tree.end[k]
            continue
        if not tree.tag[k]:
            out.append(k)
        k += 1
    return out
