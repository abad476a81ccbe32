"""Main text of web pages by composite text density.

A page's elements become a tree with counts of characters, tags, link characters and link tags. Elements that say what they
are (navigation, forms, adverts, comments ...) leave it first; among the rest link-adjusted characters per tag point at
the article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, without

#: Elements without content, elements whose content is no markup, and elements that begin a line of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes, up to the elements after the bar.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot caption", "table"), "thead": ("tr td th thead tbody tfoot caption", "table"), "tfoot": ("tr td th thead tbody tfoot caption", "table"),
    "option": ("option", "select optgroup"), "optgroup": ("option optgroup", "select"), "body": ("head", "html"), "a": ("a", "table td body"),
}
CLOSES = {tag: (frozenset(ends.split()), frozenset(until.split())) for tag, (ends, until) in CLOSES.items()}
ENDS_P = BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "head", "legend", "noscript"}
#: Elements that are never part of an article.
OUTSIDE = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset footer form head iframe input menu nav noembed noframes noscript object optgroup option script search select style svg"
    " template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names (parts of class and id) of what is no article; comments are left out even where they hold headings or more text than all else.
NAMES = frozenset(
    "ad adbanner adblock adbox ads adslot adspace adunit advert adverts advertisement advertisements advertising alert aside banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer"
    " footer gdpr login masthead menu menubar menus modal nav navbar navigation navmenu newsletter notice notices notification overlay pager pagination popup promo promos promoted promotion"
    " recommendations recommended related search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toc toolbar topbar widget widgets".split()
)
TALK = frozenset("comment comments commentlist commentlists discussion disqus feedback replies reply respond responses".split())
#: Words before such a name that speak of the element's surroundings or its subject instead.
ABOUT = frozenset("category has hide is no show tag topic with without".split())
P, P_WITHIN = frozenset({"p"}), frozenset("button caption table td th".split())
DEPTH = 512
TAG_BEGINS = re.compile("<[a-zA-Z!?/]")
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NEXT_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HINTS = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOPS = frozenset("bar container global header inner main masthead page site top wrapper".split())
#: A sibling of the chosen subtree belongs to it from this share of the threshold on.
SIBLING = 0.5


def named(value: str) -> tuple[bool, bool]:
    """Whether a class or id names something outside of an article, and whether it names comments."""
    outside = talk = False
    for name in value.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", CAMEL.sub("-", name).lower()) if p]
        for i, part in enumerate(parts):
            if i and parts[i - 1] in ABOUT:
                continue
            if part == "header":
                outside |= TOPS.issuperset(parts)
            outside |= part in NAMES or part.startswith(("adsby", "adsense", "advert", "cookie"))
            talk |= part in TALK or part.startswith(("commentform", "commentsection", "commentthread"))
        outside |= "".join(parts) in NAMES
    return outside, talk


class Page:
    """The elements of a page, numbered in page order (a parent before its children), and its text pieces by element."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marks = ["body"], [-1], [""]
        self.pieces: list[tuple[int, str] | None] = []  # None: a block begins or ends
        self.stack, self.open = [0], Counter()
        self.read(source)

    def read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        quotes = {q: source.rfind(q) for q in "\"'"}
        while at < len(source):
            lt = source.find("<", at)
            if lt < 0:
                return self.text(source[at:])
            if lt > at:
                self.text(source[at:lt])
            if lt > last and TAG_BEGINS.match(source, lt):  # a tag without an end
                return None
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 2)
                at = len(source) if end < 0 else end + 3
                continue
            found = TAG.match(source, lt)
            if not found:
                if TAG_BEGINS.match(source, lt):
                    at = source.find(">", lt) + 1
                else:
                    self.text("<")
                    at = lt + 1
                continue
            end, name = self.closing(source, found.end(), quotes), found[1].lower()
            if source[lt + 1] == "/":
                self.leave(name)
            else:
                self.enter(name, source[found.end() : end])
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, end)
                    end = close.start() - 1 if close else len(source)
            at = end + 1
        return None

    @staticmethod
    def closing(source: str, begin: int, quotes: dict[str, int]) -> int:
        """Where a tag ends: the first > outside of quoted values, else the first one at all."""
        at = begin
        while found := NEXT_END.search(source, at):
            char, at = found[0], found.end()
            if char == ">":
                return at - 1
            before = at - 2
            while before > begin and source[before].isspace():
                before -= 1
            if source[before] == "=" and quotes[char] >= at:
                at = source.find(char, at) + 1
        return source.find(">", begin)

    def text(self, raw: str) -> None:
        self.pieces.append((self.stack[-1], unescape(raw) if "&" in raw else raw))

    def enter(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and len(self.stack) == 1:
            return
        if name in CLOSES:
            self.imply(*CLOSES[name])
        if name in ENDS_P:
            self.imply(P, P_WITHIN)
        if name in BLOCKS:
            self.pieces.append(None)
        elif name == "br":
            self.pieces.append((self.stack[-1], " "))
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.marks.append(attributes)
        if name not in VOID and name not in RAW and len(self.stack) < DEPTH:
            self.stack.append(len(self.tag) - 1)
            self.open[name] += 1

    def imply(self, ends: frozenset, until: frozenset) -> None:
        """Closes the open elements that a new one ends."""
        if any(self.open[e] for e in ends):
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.tag[self.stack[i]]
                if name in until:
                    return
                if name in ends:
                    self.pop(i)

    def leave(self, name: str) -> None:
        if name in BLOCKS:
            self.pieces.append(None)
        if self.open[name]:
            for i in range(len(self.stack) - 1, 0, -1):
                here = self.tag[self.stack[i]]
                if here == name:
                    return self.pop(i)
                if name not in BLOCKS and here in BLOCKS:
                    return None
        return None

    def pop(self, to: int) -> None:
        for node in self.stack[to:]:
            self.open[self.tag[node]] -= 1
            if self.tag[node] in BLOCKS:
                self.pieces.append(None)
        del self.stack[to:]

    def says(self, v: int) -> tuple[bool, bool, bool]:
        """Whether an element's attributes put it outside of an article by role or style, by its name, as comments."""
        marks = self.marks[v]
        if not HINTS.search(marks):
            return False, False, False
        said = {k.lower(): (a or b or c).strip() for k, a, b, c in ATTRIBUTE.findall(marks)}
        bare = {x.lower() for x in ATTRIBUTE.sub(" ", marks).replace("/", " ").split()}
        style = re.sub(r"\s", "", said.get("style", "").lower())
        aside = said.get("role", "").lower() in ROLES or "hidden" in bare or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in style
        return aside, *named(f"{said.get('class', '')} {said.get('id', '')}")

    def outside(self) -> list[bool]:
        """The elements that say they are no part of an article, and all in them.

        A name counts neither on the page's body or main nor on what holds an article, main or the only h1.
        """
        tag, parent, n = self.tag, self.parent, len(self.tag)
        said = [self.says(v) for v in range(n)]
        holds = [t == "main" or (t == "article" and not said[v][2]) for v, t in enumerate(tag)]
        heading = [t == "h1" for t in tag]
        if any(holds) or sum(heading) > 1:
            heading = [False] * n
        keeps = [a or b for a, b in zip(holds, heading, strict=True)]
        for v in range(n - 1, 0, -1):
            keeps[parent[v]] |= keeps[v]
        gone, within = [False] * n, [False] * n
        for v in range(1, n):
            up, (aside, other, talk) = parent[v], said[v]
            within[v] = within[up] or tag[v] in ("article", "main")
            named_out = talk or (other and tag[v] != "article")
            gone[v] = gone[up] or tag[v] in OUTSIDE or (tag[v] == "header" and not within[up]) or aside or (named_out and not keeps[v] and tag[v] not in ("body", "html"))
        return gone

    def main_text(self) -> str:
        """The chosen elements' text: white space is one space within a block, and one space stands between blocks."""
        chosen = self.chosen()
        out, block = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if block and (line := "".join(block).split()):
                    out.append(" ".join(line))
                block = []
            elif chosen[piece[0]]:
                block.append(piece[1])
        return " ".join(out)

    def chosen(self) -> list[bool]:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        gone = self.outside()
        own, linked = [0] * n, [False] * n
        for v in range(1, n):
            linked[v] = linked[parent[v]] or tag[v] == "a"
        for piece in self.pieces:
            if piece:
                own[piece[0]] += len(" ".join(piece[1].split()))
        chars = [0 if gone[v] else own[v] for v in range(n)]
        link_chars = [chars[v] if linked[v] else 0 for v in range(n)]
        tags, link_tags, links = [0] * n, [0] * n, [0] * n
        for v in range(n - 1, 0, -1):
            up = parent[v]
            chars[up] += chars[v]
            link_chars[up] += link_chars[v]
            if not gone[v]:
                tags[up] += tags[v] + 1
                link_tags[up] += link_tags[v] + linked[v]
                links[up] += links[v] + (tag[v] == "a")
        share = link_chars[0] / max(chars[0], 1)
        density = [composite(chars[v], tags[v], link_chars[v], link_tags[v], share) for v in range(n)]
        sums = [0.0 if gone[v] else density[v] * own[v] / max(chars[v], 1) for v in range(n)]
        for v in range(n - 1, 0, -1):
            sums[parent[v]] += density[v]
        top = max((v for v in range(n) if not gone[v] and (v == 0 or tag[v] in BLOCKS)), key=sums.__getitem__)
        kept = [False] * n
        for v in self.regions(top, gone, chars, link_chars, density):
            kept[v] = True
        for v in range(1, n):
            menu = tag[v] in BLOCKS and links[v] > 1 and chars[v] == link_chars[v]
            kept[v] = (kept[v] or kept[parent[v]]) and not gone[v] and not menu
        return kept

    def regions(self, top: int, gone: list[bool], chars: list[int], link_chars: list[int], density: list[float]) -> list[int]:
        """The roots of the article: top's outermost article element; without one, top and what is as dense around it.

        The threshold is the least density on the way from top to the body (or to main); a heading needs none.
        """
        path = [top]
        while path[-1]:
            path.append(self.parent[path[-1]])
        articles = [v for v in path if self.tag[v] == "article"]
        if articles:
            return articles[-1:]
        inside = [v for v, t in enumerate(self.tag) if t == "article" and not gone[v] and 2 * chars[v] >= chars[top] > 0]
        if inside and top in self.above(inside[0]):
            return inside[:1]
        for i, v in enumerate(path):
            if self.tag[v] == "main":
                path = path[: i + 1]
        least, way, found = SIBLING * min(density[v] for v in path), set(path), [top]
        for v in range(1, len(self.tag)):
            if self.parent[v] in way and v not in way and self.parent[v] != top and not gone[v] and 3 * link_chars[v] < max(chars[v], 1):
                if density[v] >= least or self.tag[v] in HEADINGS:
                    found.append(v)
        return found

    def above(self, v: int) -> set[int]:
        found = {v}
        while v:
            v = self.parent[v]
            found.add(v)
        return found


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters a tag, raised or lowered by how little or much of them is linked (share: of the whole page); 0 without text."""
    if not chars:
        return 0.0
    plain, tags, link_tags = max(chars - link_chars, 1), max(tags, 1), max(link_tags, 1)
    linked = max(link_chars, 1)
    base = math.log(chars / plain * linked + share * chars + math.e)
    return max(chars / tags * math.log(chars / linked * tags / link_tags) / math.log(base), 0.0)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (main text of the column html, '' if it has none) and n_chars (its code points) in place of html.

    One pass without a shuffle; only html goes to Python, in batches bounded by bytes, other columns pass by (those named
    text and n_chars are replaced). Null and empty pages give ''. Broken markup is read as browsers do in the main (open
    tags, quotes and comments end somewhere); elements deeper than 512 are read as children of the 512th. Time is linear in
    the page. Repeated rows stay; no pages give none.
    """

    def texts(source):
        return source.map(main_text)

    (name,) = free(pages, "main_text")
    found = pages.withColumn(name, F.pandas_udf(texts, "string")(F.coalesce(F.col(html), F.lit(""))))
    others = without(found.drop(html), "text", "n_chars").columns
    return found.select(*[c for c in others if c != name], F.col(name).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
