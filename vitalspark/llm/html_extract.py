"""Main-text extraction from web pages by consensus of paths within a host.

Method: every page is read into blocks of text and a tree of the containers around them. A container's
path is its chain of generalised tag.class names (digits in class names become N). Blocks give points, their
length less twice their link text, to the containers around them, the nearest one in full and each further one
DECAY times as much. A page has one vote, however long it is, for the path that got most of its points. Spark counts
the votes by (host, path); the path with most wins its host. Each page
is then read again and gives the blocks inside containers of the winning path, or, if it has none, those of its
own best path. What stands around them is text too: the rest of the outermost article or main around them, or else of
the containers around them (of body only its own blocks, sections and quotations), but no part that is mostly links. Boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) never count, neither in the vote nor in the text.

Time and memory are linear in a page's length, whatever its markup: containers link to their parents, open elements are
found by name, and a tag without an end is found out once.

Skew: votes are partially aggregated, so a host with a third of all pages sends few rows; the table of winners
is broadcast only if its measured size is under the bound and otherwise joined by a shuffle that AQE may split.

Defined results: a null html is empty and gives an empty text; a null url belongs to host ''; rows that repeat
each give their row; unclosed and stray tags are tolerated; a tag whose quotes never end ends at the first '>', as do all
tags after it; a '<' without any '>' after it is text; ties of votes go to the smaller path; an empty
table gives an empty result; other columns are ignored. Text of a page without any container is its whole text
outside boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2s

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise, maybe_broadcast, table

#: What a container further out gets of the points of the one inside it.
DECAY = 0.75
#: Element names by role.
CONTAINERS = frozenset("article body div main section td blockquote center".split())
BLOCKS = CONTAINERS | frozenset("address br caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head header hr html legend li ol option p pre summary table tbody tfoot th thead title tr ul nav footer aside form".split())
RAW = frozenset("script style textarea noscript template iframe svg math object xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form head button select menu dialog".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_DROPPED = frozenset(["button", "select"])
#: Words of class, id and role attributes that mark boilerplate where they begin or end the name, or stand among words about layout.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies disqus footer foot form forms header masthead menu menus modal nav navbar navigation newsletter notice notices"
    " alert alerts popup pager pagination promo promotion promos related recommended respond search share sharing sidebar sidebars side"
    " signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets reply replies discussion feedback login"
    " contentinfo complementary".split()
)
#: Words that make such a name one about the layout around the boilerplate, as in has-sidebar.
ABOUT = frozenset("has with no without layout enabled disabled free".split())
#: Hints that are also words of headings and topics: they mark a name only beside other hints or words about layout.
AMBIGUOUS = frozenset("alert alerts banner banners comment discussion feedback foot form forms login notice notices promotion related recommended reply replies respond search share sharing side skip social subscription".split())
LAYOUT = frozenset(
    "area articles bar block body bottom box btn button buttons column container content entries entry footer group head icon icons inner item items left link links"
    " list main news outer page panel post posts products reading right row section site slot stories text thread title top topics unit videos wrap wrapper".split()
)
#: First words of names that tell the topic of what they stand at, as in category-social.
TOPICS = frozenset("cat category format keyword label postid subject tag tagged tags topic type".split())
#: Elements that are the text itself, whatever their names.
TEXT = frozenset("article main h1 h2 h3 h4 h5 h6".split())
#: Outer parts of paths, and class names, that are longer than this are abbreviated by a digest; it changes no text.
LONGEST_PATH, LONGEST_CLASS = 400, 80
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_DECLARATION = re.compile("<[!?]")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Numbers of character references beyond any code point, and leading zeros, which integers of text may not have many of.
_HUGE, _ZEROS = re.compile("&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?"), re.compile("&#0{9,}")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: End tags that HTML lets one leave out: a start tag of the key ends an open element of the set.
_CLOSES = {"body": {"head"}, "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marks(name: str, anchor: bool) -> bool:
    """Whether a class, id or role marks boilerplate; `anchor`: it is the id of a section."""
    words = [w for w in _WORDS.findall(_CAMEL.sub(" ", name).lower()) if not w.isdigit()]
    if not words or words[0] in TOPICS or not ABOUT.isdisjoint(words):
        return False
    plain = all(w in HINTS or w in LAYOUT for w in words)
    hints = HINTS.intersection(words if plain else (words[0], words[-1]))
    if hints <= AMBIGUOUS:
        return bool(hints) and plain and not anchor
    return plain or not anchor


def _names(attributes: str, tag: str = "") -> tuple[str, bool]:
    """The first class, generalised, and whether class, id or role mark boilerplate."""
    label, dropped = "", False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role"):
            value = unescape(a or b or c)
            if tag not in TEXT:
                dropped = dropped or any(_marks(name, key == "id" and tag == "section") for name in value.split())
            if key == "class" and value.split():
                label = "." + re.sub(r"\d+", "N", value.split()[0].lower()).replace(">", "")
                if len(label) > LONGEST_CLASS:
                    label = f".#{blake2s(label.encode(), digest_size=16).hexdigest()}"
        elif key in ("hidden",) or key == "aria-hidden" and (a or b or c).lower() == "true":
            dropped = True
        elif key == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
            dropped = True
    return label, dropped


def unescape(raw: str) -> str:
    if "&#" in raw:
        raw = _ZEROS.sub("&#0", _HUGE.sub("\ufffd", raw))
    return html.unescape(raw)


class Page:
    """The blocks of a page in order, each with its innermost container, and the containers with parent and path."""

    def __init__(self, page: str):
        self.parent: list[int] = [-1]  # container 0 is the page itself and has no path
        self.path: list[str] = [""]
        self.tag: list[str] = [""]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, link characters
        self._text: list[str] = []
        self._open: list[tuple[str, bool, int]] = []  # tag, is container, is dropped
        self._places: dict[str, list[int]] = defaultdict(list)  # of open elements by tag
        self._containers: list[int] = []  # places of open containers
        self._now = self._dropped = self._links = self._linked = 0
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            words = " ".join("".join(self._text).split())
            if words:
                self.blocks.append((self._now, words, self._links))
            self._text.clear()
        self._links = 0

    def _add(self, raw: str) -> None:
        if raw and not self._dropped:
            own = unescape(raw)
            self._text.append(own)
            if self._linked:
                self._links += len(own.strip())

    def _close(self, place: int) -> None:
        """Close the open elements from this place on."""
        for tag, container, gone in reversed(self._open[place:]):
            self._places[tag].pop()
            if container:
                self._containers.pop()
                self._now = self.parent[self._now]
            self._dropped -= gone
            self._linked -= tag == "a"
        del self._open[place:]

    def _last(self, tags: Iterable[str]) -> int:
        return max((own[-1] for t in tags if (own := self._places.get(t))), default=-1)

    def _read(self, page: str) -> None:
        at, end, quotes = 0, len(page), True
        last = page.rfind(">")
        while at < end:
            start = page.find("<", at)
            if start < 0 or start > last:  # no tag ends any more; an open comment or declaration runs to the end
                mark = _DECLARATION.search(page, at)
                self._add(page[at : mark.start() if mark else end])
                return
            self._add(page[at:start])
            first = page[start + 1 : start + 2]
            if first in ("!", "?"):
                mark, stop, skip = next((x for x in (("<!--", "-->", 4), ("<![CDATA[", "]]>", 9)) if page.startswith(x[0], start)), ("", ">", 1))
                until = page.find(stop, start + skip)
                until = end if until < 0 else until
                if mark == "<![CDATA[":
                    self._add(html.escape(page[start + skip : until], False))
                at = until + len(stop)
                continue
            m = _TAG.match(page, start + 1)
            if m is None:
                self._add("<")
                at = start + 1
                continue
            close = self._tag_end(page, m.end()) if quotes else page.find(">", m.end())
            if close < 0:
                quotes = False
                close = page.find(">", m.end())
            tag, attributes = m[2].lower(), page[m.end() : close]
            at = close + 1
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not attributes.endswith("/"):
                    until = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    if until is None:
                        return
                    at = until.end()
            else:
                self._start(tag, attributes)

    @staticmethod
    def _tag_end(page: str, at: int) -> int:
        """Place of the '>' outside quotes that ends a tag, or -1."""
        while m := _QUOTE_OR_END.search(page, at):
            if m[0] == ">":
                return m.start()
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
        return -1

    def _end(self, tag: str) -> None:
        """An end tag closes the nearest open element of its name; without one it only ends a block."""
        if tag in BLOCKS:
            self._flush()
        place = self._last((tag,))
        inside = self._containers[-1] if self._containers else -1
        if place >= 0 and (tag in CONTAINERS or tag in DROPPED or place >= inside):
            self._close(place)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        inside = self._containers[-1] if self._containers else -1
        if tag in _CLOSES:
            place = self._last(_CLOSES[tag])
            if place >= 0 and place >= max(inside, self._last(("ul", "ol", "table", "dl"))):
                self._close(place)
        elif tag in CONTAINERS:
            place = self._last(("p",))
            if place > inside:
                self._close(place)
        label, gone = _names(attributes, tag) if attributes else ("", False)
        container = tag in CONTAINERS
        gone = int((gone and tag not in ("html", "body")) or tag in DROPPED)
        place = len(self._open)
        if container:
            outer = self.path[self._now] + ">" if self._now else ""
            if len(outer) > LONGEST_PATH:
                outer = f"#{blake2s(outer.encode(), digest_size=16).hexdigest()}>"
            self.parent.append(self._now)
            self.path.append(outer + tag + label)
            self.tag.append(tag)
            self._now = len(self.path) - 1
            self._containers.append(place)
        self._dropped += gone
        self._linked += tag == "a"
        self._open.append((tag, container, gone))
        self._places[tag].append(place)

    def scores(self) -> dict[str, float]:
        """Points of each container path."""
        points: dict[str, float] = defaultdict(float)
        for at, text, links in self.blocks:
            own = max(0, len(text) - 2 * links)
            while at and own >= 0.01:
                points[self.path[at]] += own
                own *= DECAY
                at = self.parent[at]
        return points

    def text(self, path: str | None) -> str:
        """The blocks inside containers of the path, or of the page's own best path where it has none, and around them."""
        if path not in self.path[1:]:
            path = best(self.scores())
            if path is None:
                return " ".join(t for _, t, _ in self.blocks)
        return " ".join(self.blocks[k][1] for k in self._around(path))

    def _around(self, path: str) -> list[int]:
        """Numbers of the blocks inside the containers of the path and of what belongs to the same text around them."""
        n = len(self.path)
        won, whole = [False] * n, [0] * n  # inside a winner; the outermost article or main around
        first = []  # outermost winners
        for c in range(1, n):
            p = self.parent[c]
            won[c] = won[p] or self.path[c] == path
            whole[c] = whole[p] or (c if self.tag[c] in ("article", "main") else 0)
            if won[c] and not won[p]:
                first.append(c)
        scope = [False] * n  # containers around the winners whose other parts are text too
        for c in first:
            at = c
            while at != whole[c] and (at := self.parent[at]) and not scope[at]:
                scope[at] = self.tag[at] != "html"
        near, part = [0] * n, [0] * n  # the nearest container of the scope, and the part of it that one is in
        for c in range(1, n):
            p = self.parent[c]
            near[c] = c if scope[c] else near[p]
            part[c] = c if scope[c] or scope[p] else part[p]
        parts: dict[int, list[int]] = defaultdict(list)
        text: list[int] = []
        for k, (c, _, _) in enumerate(self.blocks):
            if won[c]:
                text.append(k)
            elif near[c] and (near[c] == c or self.tag[near[c]] != "body" or self.tag[part[c]] in ("section", "blockquote")):
                parts[part[c]].append(k)
        for own in parts.values():
            if 2 * sum(self.blocks[k][2] for k in own) <= sum(len(self.blocks[k][1]) for k in own):
                text += own
        return sorted(text)


def scores(page: str) -> dict[str, float]:
    """Points of each container path of a page."""
    return Page(page).scores()


def best(points: dict[str, float]) -> str | None:
    return min(points, key=lambda p: (-points[p], p)) if points else None


def main_text(page: str, path: str | None) -> str:
    return Page(page).text(path)


def host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, n): for each host the paths that its pages vote for, and how many do."""

    def make():
        def work(batch) -> Iterator[dict]:
            seen: Counter = Counter()
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if path := best(scores(page or "")):
                    seen[name, path] += 1
            yield {"host": [k[0] for k in seen], "path": [k[1] for k in seen], "n": list(seen.values())}

        return work

    return arrow_map(pages.select(host().alias("host"), "html"), "host string, path string, n long", make).groupBy("host", "path").agg(F.sum("n").alias("n"))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path of most votes, ties to the smaller path."""
    least = F.min(F.struct((-F.col("n")).alias("n"), "path"))
    return votes(pages).groupBy("host").agg(least.alias("least")).select("host", F.col("least.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) → page_id, url, text, n_chars, path."""
    won = materialise(winners(pages), "host-paths")
    kind = dict(pages.dtypes)["page_id"]

    def make():
        def work(batch) -> Iterator[dict]:
            text = [main_text(page or "", path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": [len(t) for t in text], "path": batch.column("path")}

        return work

    rows = pages.select("page_id", "url", "html", host().alias("host")).join(maybe_broadcast(won, 512), "host", "left").drop("host")
    return arrow_map(rows, f"page_id {kind}, url string, text string, n_chars long, path string", make)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
