"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html as htmllib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a sliding window; characters in it that make a surge, at most, and fewer than which are a dive.
WINDOW = 3
SURGE = 120
DIVE = 25
#: A window surges that holds this share of what the page's fullest one does.
PEAK_SHARE = 0.5
#: Where marked lines hold at least this share of the page's text, marks decide what the lengths leave open.
LEAST_SHARE = 0.5

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_KEY = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:(\s*=)\s*)?")
_BARE = re.compile(r"[^\s>]*")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
#: Elements whose content is not markup.
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset", "label", "datalist", "audio", "video", "template", "svg", "object", "canvas", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
#: Formulas stand in their sentence; what only repeats one in another notation goes.
_MATH = {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mspace", "mstyle", "mpadded", "menclose", "mtable", "mtr", "mtd", "semantics"}
_INLINE |= _MATH
_DROP |= {"annotation", "annotation-xml"}
#: Words of class, id and role names that mark what is not the article.
_BOILER = set(
    "nav navbar navigation menu menubar submenu topnav topbar toolbar footer foot copyright sidebar aside sidenav rail widget widgets banner ad ads adv advert adverts advertisement advertising adsense adslot promo promos promoted promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer popup modal overlay "
    "comment comments commentlist respond reply replies disqus discussion feedback share sharing social related recommended recommendations breadcrumb breadcrumbs crumbs pagination pager login signin signup subscribe subscription newsletter search searchbox skip toc tags tagcloud contentinfo complementary dialog legal paywall outbrain taboola".split()
)
#: Words that stand beside such a word in a name without changing what it means.
_BESIDE = set("list lists item items section block box bar container wrapper wrap area link links button buttons icon icons post posts article articles story stories form thread slot unit left right top bottom inner outer main content text title header heading body group panel column col row".split())
#: Words that name parts of an article as well: an element in one so named goes only if it holds no window of text that surges.
_EITHER = set("footer foot rail discussion feedback share sharing social related recommended recommendations legal notice notices alert alerts disclaimer reply replies respond search skip toc tags rss copyright sponsor sponsors sponsored widget modal overlay banner menu navigation".split())
_HEADER = {"header", "head", "masthead", "pageheader", "siteheader"}
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marks(tag: str, attrs: dict[str, str]) -> tuple[set[str], bool]:
    """Words of an element's names, and whether it is hidden."""
    names: set[str] = set()
    for k in ("class", "id", "role"):
        if k in attrs:
            names.update(_WORD.findall(_CAMEL.sub("-", attrs[k]).lower()))
    style = attrs.get("style", "").lower().replace(" ", "")
    return names, "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _named(attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether a class, id or role of an element inside an article names, as a whole, what is not part of it; and whether it might."""
    surely = perhaps = False
    for k in ("class", "id", "role"):
        for name in attrs.get(k, "").split():
            words = set(_WORD.findall(_CAMEL.sub("-", name).lower()))
            if words & _BOILER and words <= _BOILER | _BESIDE:
                either = (words & _BOILER) <= _EITHER
                surely, perhaps = surely or not either, perhaps or either
    return surely, perhaps


class _Scanner:
    """Tags and text of a page by the rules of HTML's tokeniser, in time proportional to its length.

    Every step moves on, and what was once sought in vain to the end of the page is not sought
    again. A quote that nothing closes is part of an unquoted value, so it swallows no text.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.gone: set[str] = set()  # what does not occur any more

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        p = self.page.find(what, at)
        if p < 0:
            self.gone.add(what)
        return p

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """The attributes from at on, whether the tag closes itself, and the place after it."""
        page, out = self.page, {}
        while True:
            m = _KEY.match(page, at)
            key, at = m[1], m.end()
            if not key:
                return (out, False, at) if at >= len(page) else (out, page[at - 1] == "/", at + 1)
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote and quote in "\"'" else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = _BARE.match(page, at)
                    value, at = v[0], v.end()
            out.setdefault(key.lower(), value)

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str], bool, int]]:
        """(kind, name or text, attributes, closes itself, place): kinds are text, open and close."""
        page, at = self.page, 0
        while at < len(page):
            p = page.find("<", at)
            if p < 0:
                p = len(page)
            if p > at:
                yield "text", page[at:p], {}, False, at
            if p == len(page):
                return
            after = page[p + 1 : p + 2]
            if after == "!":
                at = self.declaration(p)
            elif after == "?":
                at = self.beyond(">", p)
            elif after == "/" and (m := _NAME.match(page, p + 2)):
                _, _, at = self.attributes(m.end())
                yield "close", m[0].lower(), {}, False, p
            elif after == "/":
                at = self.beyond(">", p)
            elif m := _NAME.match(page, p + 1):
                attrs, own, at = self.attributes(m.end())
                name = m[0].lower()
                if name in _RAW:
                    at = self.raw(name, at)
                else:
                    yield "open", name, attrs, own, p
            else:
                yield "text", "<", {}, False, p
                at = p + 1

    def beyond(self, what: str, at: int) -> int:
        p = self.find(what, at)
        return len(self.page) if p < 0 else p + len(what)

    def declaration(self, p: int) -> int:
        """The place after a comment, a doctype or character data."""
        page = self.page
        if page.startswith("<!--", p):
            if page.startswith((">", "->"), p + 4):
                return page.index(">", p) + 1
            return self.beyond("-->", p + 4)
        if page.startswith("<![CDATA[", p) and self.find("]]>", p) >= 0:
            return self.beyond("]]>", p)
        return self.beyond(">", p)

    def raw(self, name: str, at: int) -> int:
        """The place after the end of a raw element; one without an end, but a script or style, is no element."""
        if name not in self.gone:
            if m := re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.page, at):
                return m.end()
            self.gone.add(name)
        return len(self.page) if name in ("script", "style") else at


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, inside an article) of each block of a page, in order.

    Scripts, styles, comments and markup are stripped; blocks of menus, headers, footers,
    sidebars, notices, adverts, forms and reader comments are left as empty lines. Inside an article
    a name counts only as a whole: `related-links` goes, `related-work` stays; and one that an
    article's own part may have (`discussion`) only if no window of its text surges. A link is an
    `a` with an address; one that nothing closes before the next ends with its block. In a list
    of an article that follows a heading at once, links count as text.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped from here on, inside an article
    spans: list[tuple[int, int]] = []  # open elements that may go: depth, first line
    headed = False  # the last line with text is a heading
    lists = 0  # the depth at which a list under a heading began
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    link = 0
    linked, lasting = False, False  # inside a link; over the ends of blocks too
    ends = [(m.start(), m[1] == "/") for m in _LINK.finditer(page)]
    closed = {at for (at, close), (_, after) in zip(ends, ends[1:], strict=False) if not close and after}

    def close_block() -> None:
        nonlocal link, linked, headed
        text = " ".join(htmllib.unescape("".join(parts)).split())
        out.append((text, 0 if lists else min(link, len(text)), bool(stack and stack[-1][2])))
        if text:
            headed = bool(stack) and stack[-1][0] in _HEADINGS
        parts.clear()
        link = 0
        linked = linked and lasting

    def text(s: str) -> None:
        nonlocal link
        if s and not (stack and stack[-1][1]):
            parts.append(s)
            if linked:
                link += len(" ".join(s.split()))

    def pop() -> None:
        nonlocal lists
        open_tags[stack.pop()[0]] -= 1
        if lists > len(stack):
            lists = 0
        if spans and spans[-1][0] > len(stack):
            first = spans.pop()[1]
            if not surges([_size(t, k) for t, k, _ in out[first:] if t]):
                out[first:] = [("", 0, a) for _, _, a in out[first:]]

    def push(tag: str, dropped: bool, article: bool) -> None:
        stack.append((tag, dropped, article))
        open_tags[tag] += 1

    for kind, tag, attrs, own_end, at in _Scanner(page):
        if kind == "text":
            text(tag)
            continue
        if kind == "close":
            if tag == "a":
                linked = False
            elif open_tags[tag]:
                if tag not in _INLINE or stack[-1][0] != tag or stack[-1][1]:
                    close_block()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in _INLINE:
                close_block()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "a":
            linked = "href" in attrs
            lasting = at in closed
            continue
        inline = tag in _INLINE
        if not inline:
            close_block()
        if tag in _VOID or own_end:
            continue
        if tag in _ENDED:  # they end their like
            depth = next((i for i in range(1, min(9, len(stack) + 1)) if stack[-i][0] in _ENDED[tag] or stack[-i][0] not in _INLINE), 0)
            if depth and stack[-depth][0] in _ENDED[tag]:
                for _ in range(depth):
                    pop()
        names, hidden = _marks(tag, attrs) if attrs else (set(), False)
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if inline:
            if hidden or dropped or (tag == "span" and (_named(attrs)[0] if article else names & _BOILER)):
                push(tag, True, article)
            continue
        main = tag in ("article", "main") or attrs.get("role", "").lower() == "main"
        big = tag in ("body", "html", "article", "main")
        surely, perhaps = _named(attrs) if article and names & _BOILER else (bool(names & _BOILER), False)
        bad = hidden or tag in _DROP or (not big and surely) or (tag == "article" and bool(names & {"comment", "comments", "reply", "ad", "ads", "promo", "related"}))
        bad = bad or (not article and not big and (tag == "header" or bool(names & _HEADER)))
        push(tag, dropped or bad, (article or main) and not bad)
        if perhaps and not (dropped or bad or big or tag in _HEADINGS):
            spans.append((len(stack), len(out)))
        if tag in ("ul", "ol") and headed and article and not lists:
            lists = len(stack)
    close_block()
    while stack:
        pop()
    return out


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _size(text: str, link: int) -> int:
    """The characters of a line that count: as many as it has outside links more than inside."""
    return max(0, len(text) - 2 * link)


def surges(size: list[int], least: int = SURGE) -> bool:
    return any(sum(size[i : i + WINDOW]) >= least for i in range(len(size)))


#: Open elements that a start tag ends, where only inline ones lie between.
_ENDED = {t: {"p"} for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "blockquote", "pre", "section", "article", "header", "footer", "form", "hr", "address", "dl", "figure", "main", "nav", "aside")}
_ENDED |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, one a line; empty if there is none.

    The lengths of text outside links are summed over sliding windows of WINDOW lines: a zone
    begins where a window surges, over SURGE characters or, on a page of short lines, over
    PEAK_SHARE of its fullest window, at the first line that is not mostly links; it ends where
    one dives below DIVE (or that surge, if it is less), but a short line that ends a sentence stays with the zone before it. The
    lines between are kept, but for those that are mostly links.
    Marks break ties: where the lines that the page marks as an article hold most of its text,
    short lines there belong to it as well, so in marked lines a zone begins with any text and
    ends where a window holds none but links; teasers beside a longer text, and short lines around
    an article, count as what they are. No window reaches over an article's edge.
    """
    if not page:
        return ""
    lines = [x for x in lines_of(page) if x[0]]
    size = [_size(t, k) for t, k, _ in lines]
    marked = sum(n for n, x in zip(size, lines, strict=True) if x[2])
    trusted = marked > 0 and marked >= LEAST_SHARE * sum(size)
    peak = max((sum(size[i : i + WINDOW]) for i in range(len(size))), default=0)
    surge = max(1, min(SURGE, int(PEAK_SHARE * peak)))
    kept: list[bool] = []
    for article, run in itertools.groupby(range(len(lines)), lambda i: lines[i][2]):
        at = list(run)
        if article and trusted:
            kept += zones([size[i] for i in at], True, dive=1)
        else:
            # beside a trusted article only what is long by any measure
            least = SURGE if trusted else surge
            own = zones([size[i] for i in at], surge=least, dive=min(DIVE, least))
            for j in range(1, len(own)):
                own[j] = own[j] or (own[j - 1] and size[at[j]] > 0 and lines[at[j]][0].endswith(_ENDS))
            kept += own
    return "\n".join(t for (t, _, _), k in zip(lines, kept, strict=True) if k)


#: What a sentence ends with.
_ENDS = (".", "!", "?", "…", '."', '!"', '?"', ".”", "!”", "?”", ".»", ".)")


def zones(size: list[int], whole: bool = False, surge: int = SURGE, dive: int = DIVE) -> list[bool]:
    """Which of the lines lie between a surge and a dive, by the size of each; empty ones only if whole."""
    kept = [False] * len(size)
    i = 0
    while i < len(size):
        if size[i] and sum(size[i : i + WINDOW]) >= surge or (whole and size[i]):
            j = i
            while j > max(0, i - WINDOW) and size[j - 1] and not kept[j - 1]:  # a heading before the surge
                j -= 1
                kept[j] = True
            j = i
            while j < len(size) and sum(size[j : j + WINDOW]) >= dive:
                kept[j] = whole or size[j] > 0
                j += 1
            i = j
        i += 1
    return kept


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: (page_id, url, text, n_chars), in a map without a shuffle.

    A null or empty page has the empty text. Repeated rows are extracted each; an empty table
    gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
