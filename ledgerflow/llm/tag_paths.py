"""Main text of web pages by tag-path ratios.

A page becomes its sequence of text blocks, each with the tag path from the root to it (inline marks like ``b`` don't
belong to a path; classes do). Per path, text length and punctuation are summed and divided by the path's blocks. Each
block takes its path's ratios, both brought to 0..1 and fused; the sequence is smoothed over its neighbours, and a
path's score is the mean of its blocks', less their share of linked text (headings aside), relative to the page's best
path. To that comes a bounded prior: ``article`` and ``main`` speak for a path and against the others, by at most
IN_ARTICLE and as far as they hold the page's text, so that a teaser hardly counts and the ratios can overturn it.
Boilerplate containers by tag or role rule a path out. Class and id are weighed: whole names count, alone or with the
usual companions (``ad-top``, but not ``has-sidebar``), against the share of the page's text that the container holds. Up
to WRAPPER of it the name stands and the path is out; from there to all of it the name loses its weight, and around an
article that share needs only be ARTICLE_WRAPPER. Paths that reach the threshold are content; all
their blocks are taken, in page order.

Character references are decoded, white space within a block (all that Unicode calls so, no-break spaces included) becomes
one space, blocks are joined by a line feed. Pages are parsed one by one within Arrow batches, and nothing is shuffled. A
page costs time and memory in proportion to its length, whatever is left unclosed and however deep it goes.

Edge cases: a null, empty or tag-only page has the empty text; text without any tag is one block; unclosed elements end
where HTML ends them or with the page; a page cut off within a tag loses that tag only; a quote
inside an unquoted value or a name opens nothing; scripts, styles and comments
may hold anything; pages of any length are parsed whole; repeated rows are extracted each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a quote opens a value only where it stands first after the equals sign; anywhere else it is a character like others
_SPACE = r"[ \t\n\f\r]"
_ATTRIBUTE = rf"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:{_SPACE}*={_SPACE}*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*)?)?"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\f\r/>]*)((?:[ \t\n\f\r/]+|{_ATTRIBUTE.replace('(', '(?:').replace('(?:?:', '(?:')})*)(?:>|\Z)", re.S)
_RAW = {"script", "style", "noscript", "iframe", "title", "textarea", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
# a start tag closes an open element of the second set, unless one of the third stands between
_P_ENDS = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_SCOPES = {"table", "td", "th", "button", "html", "body"}
_BOILER_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "template", "dialog", "menu", "object", "audio", "video", "canvas", "math"}
_BOILER_WORDS = {
    "ad", "ads", "adbox", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright",
    "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "related",
    "replies", "reply", "rss", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
# what such a word may stand with in a class name
_COMPANIONS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "container", "footer", "form", "global", "header", "icon", "icons", "inner", "item", "items", "js", "left",
    "link", "links", "list", "main", "mobile", "desktop", "outer", "posts", "primary", "right", "secondary", "section", "site", "slot", "sticky", "text", "title", "top", "unit",
    "wrap", "wrapper",
}
_BOILER_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "navigation", "search", "menu", "menubar"}
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
_WORD = re.compile(r"[a-z]+")
_HEADING = re.compile("h[1-6]")

THRESHOLD = 0.5
WRAPPER, ARTICLE_WRAPPER = 0.9, 0.5  # shares of the page's text from which a container is rather a wrapper than what its name says
IN_ARTICLE = 0.45  # at most so much is added to a path's score inside an article, or taken from it outside
_HALF_LENGTH, _HALF_MARKS = 60.0, 1.0  # ratios at which the measures reach one half


@dataclass
class Block:
    path: int  # number of the tag path in its page
    place: str  # article, named, boilerplate or plain
    text: str
    linked: int = 0  # characters of it in links
    named: int = 0  # the innermost container around it whose name is boilerplate; 0: none


@dataclass
class _Open:
    tag: str
    path: int
    place: str
    inline: bool = False
    link: bool = False
    named: int = 0


_ROOT = _Open("", 0, "plain")


@dataclass
class Page:
    """A page while it is read. A path is a number given to (the path around it, its last step), and a container knows the one
    around it, so an element costs the same at any depth."""

    blocks: list[Block] = field(default_factory=list)
    around: list[int] = field(default_factory=lambda: [0])  # per container the one around it, which has a smaller number
    headings: set[int] = field(default_factory=set)  # paths that end in a heading
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    stack: list[_Open] = field(default_factory=list)
    depths: dict[str, list[int]] = field(default_factory=dict)  # places in the stack per tag
    run: list[str] = field(default_factory=list)
    at: tuple[int, str, int] | None = None
    linked: int = 0

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _ROOT

    def flush(self) -> None:
        if self.run:
            text = " ".join(entities.unescape("".join(self.run)).split())
            if text:
                self.blocks.append(Block(self.at[0], self.at[1], text, min(self.linked, len(text)), self.at[2]))
            self.run, self.linked = [], 0
        self.at = None

    def text(self, s: str) -> None:
        top = self.top()
        if self.at is None:
            if not s.strip():
                return
            self.at = top.path, top.place, top.named
        elif self.stack and (top.place == "boilerplate" and self.at[1] != "boilerplate" or top.named != self.at[2]):
            return  # an inline element that is itself ruled out or named
        self.run.append(s)
        if top.link:
            self.linked += len(s.strip())

    def open(self, tag: str, attributes: str) -> None:
        outer, inline = self.top(), tag in _INLINE
        step, place, named = _place(tag, attributes, outer.place)
        path, container = outer.path, outer.named
        if not inline:
            path = self.paths.setdefault((outer.path, step), len(self.paths) + 1)
            if _HEADING.fullmatch(tag):
                self.headings.add(path)
        if named:
            self.around.append(outer.named)
            container = len(self.around) - 1
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, path, place, inline, tag == "a" or outer.link, container))

    def close(self, i: int) -> None:
        """Close the element at this place of the stack and all inside it."""
        if any(not e.inline for e in self.stack[i:]):
            self.flush()
        for e in self.stack[i:]:
            self.depths[e.tag].pop()
        del self.stack[i:]

    def close_ended(self, tag: str) -> None:
        """Close what this start tag ends: the outermost of the elements it ends that no barrier stands around."""
        own, barrier = ({"p"}, _SCOPES) if tag in _P_ENDS else _CLOSES.get(tag, (set(), set()))
        own_depths = [d for d in map(self.depths.get, own) if d]
        if own_depths:
            lowest = max((d[-1] for d in map(self.depths.get, barrier - own) if d), default=-1)
            found = [d[i] for d in own_depths if (i := bisect_right(d, lowest)) < len(d)]
            if found:
                self.close(min(found))


def _boiler_name(name: str) -> bool:
    words = re.split(r"[-_:]+|(?<=[a-z])\d+", name)
    words = [w for w in words if w and not w.isdigit()]
    return any(w in _BOILER_WORDS for w in words) and all(w in _BOILER_WORDS or w in _COMPANIONS for w in words)


def _place(tag: str, attributes: str, outer: str) -> tuple[str, str, bool]:
    """Step of the path, what kind of place the element is, and whether its own name is boilerplate."""
    names: list[str] = []
    boiler = tag in _BOILER_TAGS or (tag == "header" and outer != "article")
    named = False
    if attributes:
        for key, value in _ATTRIBUTES.findall(attributes):
            key, value = key.lower(), value.lower()
            if value[:1] in ("'", '"'):
                value = value[1:].removesuffix(value[0])
            if key in ("class", "id"):
                own = value.split()
                names += own
                if tag == "article":
                    named = named or bool(set(_WORD.findall(value)) & {"comment", "comments", "reply"})
                else:
                    named = named or (tag not in ("html", "body", "main") and any(_boiler_name(x) for x in own))
            elif key == "role":
                boiler = boiler or value in _BOILER_ROLES
            elif key in ("hidden", "aria-hidden", "style"):
                boiler = boiler or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    step = ".".join([tag, *sorted(names)])
    if outer == "boilerplate" or boiler:
        return step, "boilerplate", named
    if named:
        return step, "named", True
    return step, "article" if outer == "article" or tag in ("article", "main") else outer, False


def parse(page: str) -> Page:
    """All text blocks of a page with their tag paths."""
    p, at, n = Page(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            p.text(page[at:])
            break
        if m.start() > at:
            p.text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if p.depths.get(tag):
                p.close(p.depths[tag][-1])
            elif tag not in _INLINE:
                p.flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = n if end is None else page.find(">", end.start()) + 1 or n
            continue
        if tag == "br":
            p.text(" ")
            continue
        if tag not in _INLINE:
            p.flush()
            p.close_ended(tag)
        if tag not in _VOID and not m[3].endswith("/"):
            p.open(tag, m[3])
    p.flush()
    return p


def name_weights(page: Page) -> dict[int, float]:
    """Of each path inside containers with boilerplate names: 0 where a name stands, 1 where all are wrappers' names."""
    own = [b for b in page.blocks if b.place != "boilerplate"]
    whole = sum(len(b.text) for b in own)
    held = [0] * len(page.around)
    article = [False] * len(page.around)  # containers with an article inside
    for b in own:
        held[b.named] += len(b.text)
        article[b.named] |= b.place == "article"
    for c in range(len(held) - 1, 0, -1):
        held[page.around[c]] += held[c]
        article[page.around[c]] |= article[c]
    weight = [1.0] * len(held)
    for c in range(1, len(held)):
        share = held[c] / max(1, whole)
        w = 1.0 if article[c] and share >= ARTICLE_WRAPPER else max(0.0, (share - WRAPPER) / (1 - WRAPPER))
        weight[c] = min(w, weight[page.around[c]])
    out: dict[int, float] = {}
    for b in own:
        if b.named:
            out[b.path] = min(out.get(b.path, 1.0), weight[b.named])
    return out


def path_scores(page: Page) -> dict[int, float]:
    """Score of every path that isn't ruled out: smoothed, fused ratios, the place's prior and its names' weight."""
    weight = name_weights(page)
    own = [b for b in page.blocks if b.place != "boilerplate" and weight.get(b.path, 1.0) > 0]
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in own:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        marks[b.path] = marks.get(b.path, 0) + len(_PUNCTUATION.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
    fused = {}
    for path, c in count.items():
        text, punctuation = length[path] / c, marks[path] / c
        fused[path] = (text / (text + _HALF_LENGTH)) * (0.5 + 0.5 * punctuation / (punctuation + _HALF_MARKS))
    raw = [fused[b.path] for b in own]
    smooth: dict[int, float] = {}
    for i, b in enumerate(own):
        near = [(0.5, raw[i])] + [(0.25, raw[k]) for k in (i - 1, i + 1) if 0 <= k < len(raw)]
        smooth[b.path] = smooth.get(b.path, 0.0) + sum(a * x for a, x in near) / sum(a for a, _ in near)
    links: dict[int, int] = {}
    for b in own:
        links[b.path] = links.get(b.path, 0) + b.linked
    mean = {path: smooth[path] / c * (1.0 if path in page.headings else 1 - links[path] / length[path]) for path, c in count.items()}
    top = max(mean.values(), default=1.0) or 1.0
    place = {b.path: b.place for b in own}
    prior = IN_ARTICLE * sum(len(b.text) for b in own if b.place == "article") / max(1, sum(length.values()))
    return {path: weight.get(path, 1.0) * x / top + (prior if place[path] == "article" else -prior) for path, x in mean.items()}


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    if not page:
        return ""
    read = parse(page)
    scores = path_scores(read)
    return "\n".join(b.text for b in read.blocks if b.place != "boilerplate" and scores.get(b.path, threshold - 1) >= threshold)


def extract(pages: DataFrame, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, threshold) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
