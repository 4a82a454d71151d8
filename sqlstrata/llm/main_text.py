"""Main text of web pages by tree scoring (operator 7).

A page becomes a tree. Each paragraph gives points for its length and its commas to its ancestors, less with each step up; a container's points
are discounted by the share of its text that stands in links. The best container (or the article or main element that it stands in) and those of
its siblings that score or read like part of the same article are kept.

Parts that are never article text (menus, forms, adverts, comments) do not take part, by element or by the class and id of a block element. Only
whole names count, or compounds of known words alone ("cookie-notice", not "has-sidebar"), and an element that holds over half of the page's
points and the article's own element or heading stays. All steps take time linear in the page, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlstrata.llm import common as C

C.by_value(__name__)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[^\s]+")
_PART = re.compile(r"[a-z]+|[0-9]+(?:x[0-9]+)?")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg"}
NOT_RAW = {"template", "svg"}  # without an end tag their text is text
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
         "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
         "td", "tfoot", "th", "thead", "tr", "ul", "option", "select"}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html", "legend", "summary"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HARD = {"nav", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas", "label", "input"}  # cut with all they hold
SOFT = {"aside", "footer", "form", "fieldset", "header"}  # cut unless they hold the article
NEVER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog"}
COMMENT_NAME = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "shoutbox"}
NEVER_NAME = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion", "sidebar", "sidebars", "nav", "navbar", "navigation", "menu",
              "menus", "submenu", "footer", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login",
              "breadcrumb", "breadcrumbs", "pagination", "pager", "related", "recommended", "widget", "widgets", "masthead", "toolbar", "skip", "disclaimer", "paywall"}
MAYBE_NAME = {"header", "banner", "notice", "notices", "alert", "notification", "hidden", "rail"}
# words that may stand beside one of the names above in a compound
BESIDE = {"site", "page", "main", "top", "bottom", "left", "right", "global", "primary", "secondary", "post", "article", "entry", "blog", "list", "box", "bar", "area", "section", "wrapper", "wrap", "container", "block", "button",
          "buttons", "links", "posts", "articles", "form", "inner", "row", "item", "items", "group", "panel", "unit", "slot", "message"}
GOOD_NAME = {"article", "content", "main", "post", "entry", "story", "text", "body"}
HOME = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
STEPS = (1, 2, 6, 9, 12)  # a paragraph's points are divided by this, step by step up; the last for all further steps
KEEP, HARDLY, BY_ELEMENT, BY_NAME, AS_COMMENT = range(5)


def _named(value: str) -> tuple[set[str], bool]:
    """Names of boilerplate among the words of a class or id, and whether a word of content stands there."""
    found, good = set(), False
    for token in _NAME.findall(value):
        parts = _PART.findall(_CAMEL.sub(r"\1 \2", token).lower())
        names = COMMENT_NAME | NEVER_NAME | MAYBE_NAME
        if parts and all(p in names or p in BESIDE or p[0].isdigit() for p in parts):
            found.update(p for p in parts if p in names)
        good = good or (len(parts) > 0 and bool(GOOD_NAME & set(parts)) and not names & set(parts))
    return found, good


def kind_of(tag: str, attrs: str, inside_home: bool) -> tuple[int, bool]:
    """How an element is cut, by its name and attributes, and whether a name of content speaks for it."""
    if tag in HARD:
        return HARDLY, False
    kind = BY_ELEMENT if tag in SOFT and not (tag == "header" and inside_home) else KEEP
    if not attrs or tag in ("html", "body"):
        return kind, False
    found: set[str] = set()
    good = False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            names, is_good = _named(html.unescape(value))
            found |= names
            good = good or is_good
        elif key == "role" and tag in BLOCK and value.strip().lower() in NEVER_ROLE:
            kind = max(kind, BY_ELEMENT)
        elif key == "hidden" or (key == "style" and _UNSEEN.search(value)) or (key == "aria-hidden" and value.lower() == "true" and tag in BLOCK):
            return HARDLY, False
    if tag not in BLOCK or tag in HEADINGS:
        return kind, good
    if found & COMMENT_NAME:
        return AS_COMMENT, good
    if tag not in HOME and found & NEVER_NAME or tag in HOME and found & {"ad", "ads", "advert"}:
        return BY_NAME, good
    if tag not in HOME and tag != "p" and found and not good:
        return BY_NAME, good
    return kind, good


class Page:
    """A page's elements in page order, and its blocks of text with the element that holds each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind, self.good = ["#page"], [-1], [KEEP], [False]
        self.blocks: list[list] = []  # [element, text, text length, length in links]
        self._read(source)

    def _read(self, source: str) -> None:
        stack, holders, opened = [0], [0], {}  # open elements, those of them that are blocks, depths of the open ones of each name
        cut, at, part, linked = 0, 0, [], 0  # cut: depth of the stack at which a hard cut began
        n, last, endless = len(source), source.rfind(">"), set()

        def flush():
            nonlocal linked
            if part:
                text = " ".join("".join(part).split())
                if text:
                    self.blocks.append([holders[-1], text, len(text), min(linked, len(text))])
                part.clear()
                linked = 0

        def add(raw: str):
            nonlocal linked
            if not cut and raw:
                text = html.unescape(raw) if "&" in raw else raw
                part.append(text)
                if opened.get("a"):
                    linked += len(text.strip())

        def close(depth: int):
            """Close the elements from a depth of the stack on."""
            nonlocal cut
            while len(stack) > depth:
                name = self.tag[stack[-1]]
                if name in BLOCK:
                    flush()
                    holders.pop()
                opened[name].pop()
                stack.pop()
                if len(stack) < cut:
                    part.clear()
                    cut = 0

        def depth_of(names, until) -> int | None:
            """Depth of the innermost open element of some names, unless one of `until` stands within it."""
            top = lambda of: max((opened[x][-1] for x in of if opened.get(x)), default=0)
            found = top(names)
            return found if found and found > top(until) else None

        while at < n:
            lt = source.find("<", at)
            if lt < 0 or lt > last and not source.startswith("<!", lt):
                add(source[at:])
                break
            if lt > at:
                add(source[at:lt])
            m = _TOKEN.match(source, lt)
            if not m:
                add("<")
                at = lt + 1
                continue
            at = m.end()
            end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if end:
                if name == "br":
                    part.append(" ")
                d = depth_of({name}, {"td", "th", "table"} - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else ())
                if d:
                    close(d)
                continue
            if name in RAW:
                if attrs.endswith("/"):
                    continue
                stop = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                if stop:
                    close_at = source.find(">", stop.end())
                    at = close_at + 1 if close_at >= 0 else n
                    continue
                if name not in NOT_RAW:
                    break
                endless.add(name)
                continue
            if name in CLOSES_P and (d := depth_of({"p"}, {"td", "th", "table", "button"})):
                close(d)
            if name in SAME:
                while (d := depth_of(*SAME[name])):
                    close(d)
            if name in BLOCK:
                flush()
            if name in VOID:
                if name in ("br", "hr"):
                    part.append(" ")
                continue
            if name in ("html", "body") and opened.get(name):
                continue
            kind, good = (KEEP, False) if cut else kind_of(name, attrs, any(opened.get(h) for h in HOME))
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.kind.append(kind)
            self.good.append(good)
            opened.setdefault(name, []).append(len(stack))
            stack.append(len(self.tag) - 1)
            if name in BLOCK:
                holders.append(stack[-1])
            if kind == HARDLY:
                if name in BLOCK:
                    flush()
                cut = len(stack)
        close(1)
        flush()

    def points(self, block: list) -> float:
        """Points of a block of text."""
        holder, text, n, linked = block
        return 0.0 if self.tag[holder] in HEADINGS else (1 + sum(map(text.count, ",،、，")) + min(n / 100, 3)) * (1 - linked / n)

    def left_out(self) -> list[bool]:
        """Which elements are cut: from the page's points in all, the points below each element, and what stands there."""
        n = len(self.tag)
        below, home, title = [0.0] * n, [t in HOME for t in self.tag], [t == "h1" for t in self.tag]
        for block in self.blocks:
            below[block[0]] += self.points(block)
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            below[up] += below[e]
            home[up] = home[up] or home[e]
            title[up] = title[up] or title[e]
        out = [False] * n
        for e in range(1, n):
            kind = self.kind[e]
            spared = kind != AS_COMMENT and below[e] * 2 > below[0] and (home[e] or kind == BY_NAME and (title[e] or self.good[e]) or self.tag[e] in ("form", "fieldset") and title[e])
            out[e] = out[self.parent[e]] or kind == HARDLY or kind != KEEP and not spared
        return out

    def scores(self, blocks: list[list]) -> tuple[list[float], list[int], list[int]]:
        """Of each element: points from the paragraphs below it, length of its text, length of its text in links."""
        n = len(self.tag)
        steps = [[0.0] * len(STEPS) for _ in range(n)]
        size, links = [0] * n, [0] * n
        for block in blocks:
            holder = block[0]
            size[holder] += block[2]
            links[holder] += block[3]
            # text that stands in a container itself counts for it, a paragraph's for what holds the paragraph
            first = holder if self.tag[holder] in ("div", "section", "article", "main", "body", "#page", "td") else self.parent[holder]
            steps[first][0] += self.points(block)
        for e in range(n - 1, 0, -1):
            up, mine = self.parent[e], steps[e]
            size[up] += size[e]
            links[up] += links[e]
            for i in range(1, len(STEPS)):
                steps[up][i] += mine[i - 1]
            steps[up][-1] += mine[-1]
        return [sum(p / d for p, d in zip(s, STEPS)) for s in steps], size, links

    def main_text(self) -> str:
        out = self.left_out()
        blocks = [b for b in self.blocks if not out[b[0]]]
        if not blocks:
            return ""
        score, size, links = self.scores(blocks)
        density = lambda e: links[e] / max(1, size[e])
        final = [s * (1 - density(e)) for e, s in enumerate(score)]
        best = max(range(len(final)), key=lambda e: (final[e], -e)) if max(final) > 0 else blocks[0][0]
        home = best
        while home >= 0 and self.tag[home] not in HOME:
            home = self.parent[home]
        if home >= 0 and density(home) < 0.5:
            best = home
        last = {}  # last text of each element beside the best one
        over = self.parent[best]
        least = max(10.0, final[best] * 0.2)
        top = [-1] * len(self.tag)  # the element beside the best one (or itself) in which an element stands
        for e in range(1, len(self.tag)):
            top[e] = e if e == best or self.parent[e] == over else top[self.parent[e]]
        if best == 0:
            top = [0] * len(top)
        for holder, text, *_ in blocks:
            last[top[holder]] = text
        marked = self.tag[best] in HOME  # the page says itself where its article ends
        keep = {best}
        for e, text in last.items():
            if e < 0 or e == best:
                continue
            reads_on = size[e] > 80 or text.rstrip("\"'»”’)")[-1:] in tuple(".!?…。！？") or self.tag[e] in HEADINGS
            if marked:
                reads_on = self.tag[e] in HOME or self.tag[e] == "p" and size[e] > 80
            if final[e] >= least or density(e) < 0.25 and reads_on:
                keep.add(e)
        # text in the wrapper of the best container, beside it
        loose = over if over >= 0 and not marked and self.tag[over] not in ("#page", "html", "body") else -1
        return " ".join(text for holder, text, *_ in blocks if top[holder] in keep or holder == loose)


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in batches:
        text = [Page(h).main_text() if (h := x.as_py()) else "" for x in batch.column(2)]
        text = [t.encode("utf-8", "replace").decode() for t in text]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], schema=schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """`pages(page_id bigint, url string, html string, ...)` to `(page_id, url, text, n_chars)`, one row per input row.

    Blocks of the article in page order, one space between; n_chars counts code points. Null or empty html, and pages without text, give the
    empty string. Null ids and urls and repeated rows are carried along. Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(_extract, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_texts(C.table(spark, sf_dir, "pages"))
