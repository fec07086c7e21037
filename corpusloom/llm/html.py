"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams a page once, and open elements are kept on a stack that also knows the ends that HTML
implies (a paragraph before a block, a list item before its sibling, the head before the body). Block-level tags end a line; each
line keeps its text, its number of tags, the share of its text inside links and the block that it stands in. What is never read as text (scripts, styles,
menus, controls, hidden elements) goes as its events arrive. Other boilerplate (page headers and footers, asides, forms, and by role, class or id adverts,
notices, reader comments and the like) is marked: its lines have no ratio, unless so much of the page is inside the marked element that it must be the page
itself (a form around everything). A class counts by its whole name, its last word, or its first before a word for a part of a page, so that
`has-sidebar` is no sidebar and `related-work` is work.

The ratio of text outside links to tags is smoothed with a Gaussian over the neighbouring lines; lines at or above the page's threshold are content. Where
they stand in an article or main element, its unmarked lines are the text. Elsewhere the text's root is the innermost block that holds ROOT_SHARE of the content (lines
below the threshold count in proportion): its unmarked lines are the text, but for runs of links, which smoothing leaves below the threshold. Where only the body holds so much, the text goes from the
first to the last line of content and on over the body's own paragraphs, headings and lists on both sides.

Defined cases: null, empty and textless pages give an empty text; truncated pages and unclosed tags are read as far as they go;
unknown character references stay as they are; very long pages are read whole, in time linear in their length but for the depth of open elements;
repeated rows give repeated results; an empty table gives no rows; columns but page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.5
THRESHOLD = 0.5
LINK_SHARE = 0.6
#: Of the content, what a block must hold to be its root; of the text, what a marked form or other element holds that is no boilerplate.
ROOT_SHARE = 0.7
FORM_SHARE = 0.5
MARKED_SHARE = 0.8

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never text; those that aren't blocks leave the line around them whole.
_DROPPED = frozenset("button canvas dialog head iframe input menu nav noscript object script select style svg template textarea title".split())
_MARKED = frozenset("aside footer form".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus footer header login masthead menu modal nav"
    " navbar navigation newsletter notice notices popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Names that mean an article's own parts inside one.
_OWN = frozenset("banner discussion header login masthead".split())
_NOT = frozenset("has is no not with without".split())
#: After a name, words for a part of a page.
_PARTS_OF = frozenset("area bar block box button buttons container form group icon icons item items link links list message overlay panel post posts section slot thread top unit wrap wrapper wrapped zone".split())
_COMMENTS = frozenset("comment commentlist comments discussion disqus replies respond".split())
_SCOPES = frozenset(("article", "main"))
_PARTS = re.compile(r"[a-z]+")
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Blocks of running text, and blocks that only hold such.
_TEXT = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
_LISTS = frozenset("blockquote dd dl figure li ol table tbody td tfoot thead tr ul".split())
_FLOW = (_TEXT | _LISTS) - {"td", "th"}
#: A start tag ends the open elements of the first set, looked for up to one of the second.
_P_ENDS = _BLOCKS - frozenset("body caption dd dt head html legend li option summary tbody td tfoot th thead title tr".split())
_IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
}
_P_LIMIT = frozenset("button caption object table td th".split())


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id has one of these names: a word of it as a whole, the end of a compound that doesn't negate it, or the beginning
    of one that goes on in words for a part of a page."""
    for word in value.lower().split():
        parts = _PARTS.findall(word)
        if parts and (word in names or (_NOT.isdisjoint(parts) and (parts[-1] in names or (parts[0] in names and _PARTS_OF.issuperset(parts[1:]))))):
            return True
    return False


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    names = _COMMENTS if tag == "article" else _NAMES - _OWN if inside else _NAMES
    for name, value in attrs:
        if name == "role" and value and value.lower() in _ROLES and tag != "article":
            return True
        if name in ("class", "id") and value and _named(value, names):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines (text, tags, characters in links, block) and blocks (tag, parent, mark, scope); block 0 is the page.

    A block's mark is the innermost marked element around it, or -1; marks list (enclosing mark, whether it is a form). A block's scope is the number of the
    article or main element around it, or -1.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.blocks: list[tuple[str, int, int, int]] = [("", -1, -1, -1)]
        self.marks: list[tuple[int, bool]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it drops its text, block around its content
        self.count: dict[str, int] = {}
        self.dropping = self.links = self.made = 0

    def block(self) -> int:
        return self.open[-1][2] if self.open else 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.block()))
            self.text = []
        self.tags = self.linked = 0

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, dropped, block = self.open[-1]
            if block != (self.open[-2][2] if len(self.open) > 1 else 0) or tag in _BLOCKS:
                self.end_line()
            self.open.pop()
            self.count[tag] -= 1
            self.dropping -= dropped
            self.links -= tag == "a"

    def close_implied(self, tags: frozenset[str], limit: frozenset[str]) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in tags:
                self.pop_to(depth)
                return
            if self.open[depth][0] in limit:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in _IN_HEAD and tag != "head" and self.open and any(o[0] == "head" for o in self.open[:3]):
            self.close_implied(frozenset(("head",)), frozenset())
        if tag in _IMPLIED:
            self.close_implied(*_IMPLIED[tag])
        elif tag in _P_ENDS:
            self.close_implied(frozenset(("p",)), _P_LIMIT)
        block, dropped = self.block(), False
        if not self.dropping:
            _, _, mark, scope = self.blocks[block]
            dropped = tag in _DROPPED or any(name == "hidden" for name, _ in attrs)
            marked = not dropped and (tag in _MARKED or (tag == "header" and scope < 0) or bool(attrs and _boilerplate(tag, attrs, scope >= 0)))
            if tag in _BLOCKS or marked:
                self.end_line()
            elif tag == "br":
                self.text.append(" ")
            self.tags += not dropped
            if tag not in _VOID and (tag in _BLOCKS or marked):
                if marked:
                    self.marks.append((mark, tag == "form"))
                    mark = len(self.marks) - 1
                if tag in _SCOPES and scope < 0 and not marked:
                    self.made += 1
                    scope = self.made
                self.blocks.append((tag, block, mark, scope))
                block = len(self.blocks) - 1
        if tag in _VOID:
            return
        self.open.append((tag, dropped, block))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.dropping += dropped
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if len(self.open) > depth and (self.open[-1][1] or tag not in _BLOCKS):
            self.pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        block = tag in _BLOCKS or tag in _DROPPED
        if self.count.get(tag):
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][0]
                if name == tag:
                    self.pop_to(depth)
                    break
                if not block and name in _BLOCKS:
                    break
        elif tag == "p" and not self.dropping:
            self.end_line()
        if not self.dropping:
            self.tags += 1

    def handle_data(self, data):
        if not self.dropping:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over the neighbours within three sigma."""
    reach = int(3 * sigma)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for k in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = weights[abs(i - k)]
            total += w * values[k]
            norm += w
        out.append(total / norm)
    return out


def _upward(values: list, parents: list[int]) -> list:
    """Sums of the values over all that is below; what is below comes later."""
    sums = list(values)
    for i in range(len(sums) - 1, -1, -1):
        if parents[i] >= 0:
            sums[parents[i]] += sums[i]
    return sums


def _live_marks(parser: Lines) -> list[bool]:
    """Whether each mark stands: not if its element holds so much of the page's text that it is the page; inner marks stand on their own."""
    own = [0] * len(parser.marks)
    for text, _, linked, block in parser.lines:
        if (mark := parser.blocks[block][2]) >= 0:
            own[mark] += max(0, len(text) - linked)
    total = sum(max(0, len(text) - linked) for text, _, linked, _ in parser.lines)
    held = _upward(own, [parent for parent, _ in parser.marks])
    alone = [held[i] < (FORM_SHARE if form else MARKED_SHARE) * total or not total for i, (_, form) in enumerate(parser.marks)]
    live = []
    for i, (parent, _) in enumerate(parser.marks):
        live.append(alone[i] or (parent >= 0 and live[parent]))
    return live


def _root(parser: Lines, mass: list[float]) -> int:
    """The innermost block, itself no paragraph or list, that holds ROOT_SHARE of the content."""
    parents = [b[1] for b in parser.blocks]
    held = _upward(mass, parents)
    root = 0
    for i in range(1, len(held)):  # a block comes after those around it
        if held[i] >= ROOT_SHARE * held[0] > 0 and parser.blocks[i][0] not in _FLOW:
            root = i
    return root


def main_text(html: str) -> str:
    """The page's main text: its lines in page order, joined by an empty line."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines, blocks = parser.lines, parser.blocks
    live = _live_marks(parser)
    plain = [not (blocks[b][2] >= 0 and live[blocks[b][2]]) for *_, b in lines]
    if not any(plain):
        return ""
    ratio = smoothed([max(0, len(t) - linked) / (tags or 1) if ok else 0.0 for (t, tags, linked, _), ok in zip(lines, plain, strict=True)])
    own = [r for r, ok in zip(ratio, plain, strict=True) if ok]
    mean = sum(own) / len(own)
    spread = math.sqrt(sum((r - mean) ** 2 for r in own) / len(own))
    least = min(mean, max(THRESHOLD * mean, mean - spread)) - 1e-9 * mean
    chosen = [ok and r >= least for r, ok in zip(ratio, plain, strict=True)]
    scopes = {blocks[b][3] for (*_, b), c in zip(lines, chosen, strict=True) if c} - {-1} or {blocks[b][3] for (*_, b), ok in zip(lines, plain, strict=True) if ok} - {-1}
    if scopes:
        return "\n\n".join(t for (t, *_, b), ok in zip(lines, plain, strict=True) if ok and blocks[b][3] in scopes)
    mass = [0.0] * len(blocks)
    for (t, _, linked, b), r, ok in zip(lines, ratio, plain, strict=True):
        mass[b] += max(0, len(t) - linked) * min(1.0, r / (least or 1.0)) * ok
    root = _root(parser, mass)
    # A line of links stays where its neighbours are text, and goes beside another one.
    links = [linked >= LINK_SHARE * len(t) for t, _, linked, _ in lines]
    lone = [not a and not b for a, b in zip([False, *links[:-1]], [*links[1:], False], strict=True)]
    kept = [ok and (not many or (c and one)) for ok, c, many, one in zip(plain, chosen, links, lone, strict=True)]
    if blocks[root][0] in ("", "html", "body"):
        def of_root(b: int) -> bool:
            if b != root and blocks[b][0] in _TEXT:
                b = blocks[b][1]
                while b > root and blocks[b][0] in _LISTS:
                    b = blocks[b][1]
            return b == root

        at = [i for i, c in enumerate(chosen) if c and not links[i]] or [i for i, c in enumerate(chosen) if c]
        first, last = at[0], at[-1]
        own = [k and of_root(b) for (*_, b), k in zip(lines, kept, strict=True)]
        while first > 0 and (own[first - 1] or not plain[first - 1]):
            first -= 1
        while last + 1 < len(lines) and (own[last + 1] or not plain[last + 1]):
            last += 1
        inside = [first <= i <= last for i in range(len(lines))]
    else:
        below = [False] * len(blocks)
        for i in range(len(blocks)):
            below[i] = i == root or (i > 0 and below[blocks[i][1]])
        inside = [below[b] for *_, b in lines]
    return "\n\n".join(t for (t, *_), k, i in zip(lines, kept, inside, strict=True) if k and i)


def extract(pages: DataFrame, rows_at_once: int = 128) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
