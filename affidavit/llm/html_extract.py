"""Main text of web pages from streaming parser events.

The standard library's parser feeds one pass over a page.  Block elements cut
it into lines; a line knows its text, the tags met since the line before, and the
element around it.  Every line, menus and footers too, gets the ratio of text
characters to tags, smoothed over the lines by a Gaussian; the threshold that
best splits the smoothed ratios into two clusters (their least summed variance)
marks content lines, and runs of them are regions.  The region with the most text
selects the content: the article or main element around it, else the smallest
element around its longest line that holds nearly all content text, and of that
element's parts only those that are mostly content, as smoothing carries a
region a line or two too far.

Inside the content, elements that never hold main text (navigation, forms,
scripts, ...) are cleaned away, and nothing else is, so short paragraphs between
long ones stay.  Class, id and role count too, in two ranks.  Comments and adverts
are set aside before anything is clustered, whatever their size and whatever
stands in them, articles and headings too; where they are all there is, an article
or main that isn't marked itself is still taken out of them.  Other marks (sidebar,
banner, form, ...) lose an element only where something else has content: a line
above the threshold by itself, or text in an article, main or h1.  If nothing has, marks count from the second
one inwards, and so on; what they lose takes no part in the clusters either.  A heading, and an article or main outside any article, is
not cleaned away by marks of this second rank.

Defined cases: a null, empty or text-less page gives an empty text; unclosed
and stray tags are taken as browsers mostly take them; a page cut off anywhere
gives what came before; of regions of equal text the first wins; very long and
very deep pages are parsed in one pass, in memory that grows with the page, as
elements are numbered in their order and know where they end; repeated rows stay;
further columns pass through, but for ``text`` and ``n_chars``, which the result
replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, WINDOW = 1.0, 3
#: Share of the content text that a container without article or main must hold.
SHARE = 0.8

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "nav header footer aside form script style noscript template head title select option button textarea iframe "
    "object canvas svg math audio video menu dialog datalist label fieldset search".split()
)
#: Elements of NEVER whose text is no line at all.
UNSEEN = frozenset("script style noscript template head title iframe object canvas svg math audio video".split())
CONTAINERS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Words of class, id or role that mark comments and adverts, and others that mark what isn't main text.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising combx comment commentlist comments disqus replies reply skyscraper".split()
)
MARKS = frozenset(
    "banner breadcrumb breadcrumbs complementary contentinfo cookie cookies consent footer form gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related search "
    "share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: How an element is marked: by its class, id or role in either rank, or by its name.
MARKED, SET_ASIDE, NAMED = 1, 2, 3
#: Elements that a start tag closes, and where the search for them ends.
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: Block elements that a p may not hold, and the elements that bound an implied end.
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
SCOPES = frozenset("table td th ul ol dl body html article main section div blockquote button object".split())
#: Elements of single paragraphs, items or cells: a page's main text is more than one of them.
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt td th tr tbody pre blockquote figure figcaption address".split())
#: Class names of a page's state or kind, not of a part: has-sidebar, with-ads, comments-open, form-page.
STATE = re.compile("^(?:has|with|no|is|hide|show)[-_]|[-_](?:open|closed|enabled|disabled|page|template|layout)$")
_GAP, _NAME = re.compile(r"\s+"), re.compile("[a-z]+")


def marked(attrs: list[tuple[str, str | None]]) -> int:
    """How attributes mark an element: SET_ASIDE, MARKED or 0."""
    found = 0
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                one = re.sub("([a-z])([A-Z])", r"\1-\2", one).lower()
                if not STATE.search(one):
                    words = _NAME.findall(one)
                    if not ASIDE.isdisjoint(words):
                        return SET_ASIDE
                    found = found or MARKED * (not MARKS.isdisjoint(words))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            found = MARKED
    return found


class Lines(HTMLParser):
    """Lines of a page (text, tags, element) and its elements in their order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, element, unseen
        self.open: Counter[str] = Counter()
        # of every element: its parent, name, how it is marked, last element and lines
        self.parents, self.names, self.aside, self.last, self.first_line, self.end_line = [0], [""], [0], [0], [0], [0]
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.parts:
            text = _GAP.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.stack[-1][1]))
                self.tags = 0
            self.parts = []

    def close_to(self, k: int) -> None:
        """Leaves the elements above place ``k`` of the stack."""
        if any(self.stack[m][1] != self.stack[m - 1][1] for m in range(k, len(self.stack))):
            self.flush()
        for m in range(len(self.stack) - 1, k - 1, -1):
            name, e, _ = self.stack[m]
            self.open[name] -= 1
            if e != self.stack[m - 1][1]:
                self.last[e], self.end_line[e] = len(self.names) - 1, len(self.lines)
        del self.stack[k:]

    def implied(self, tag: str) -> None:
        closes = CLOSES.get(tag, frozenset())
        if tag in ENDS_P:
            closes = closes | {"p"}
        left = sum(self.open[c] for c in closes)
        if not left:
            return
        bound = SCOPES - closes if tag != "tr" else frozenset(["table"])
        found = None
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name in closes:
                found, left = k, left - 1
                if not left:
                    break
            elif name in bound:
                break
        if found:
            self.close_to(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.implied(tag)
            self.flush()
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "option":
            self.implied(tag)
        if tag in VOID:
            return
        aside = NAMED if tag in NEVER else marked(attrs) if attrs and tag not in ("html", "body") else 0
        if aside == MARKED and (tag in HEADINGS or tag in CONTAINERS and not self.open["article"]):
            aside = 0
        if aside:
            self.flush()
        self.open[tag] += 1
        element, unseen = self.stack[-1][1], self.stack[-1][2] or tag in UNSEEN
        if tag in BLOCKS or aside:
            self.parents.append(element)
            self.names.append(tag)
            self.aside.append(aside)
            self.last.append(0)
            self.first_line.append(len(self.lines))
            self.end_line.append(0)
            element = len(self.names) - 1
        self.stack.append((tag, element, unseen))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.close_to(k)
                return
            if tag not in BLOCKS and tag not in NEVER and self.stack[k][0] in BLOCKS:
                return  # a stray end of an inline element

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)

    def end(self) -> None:
        self.close()
        self.flush()
        self.close_to(1)
        self.last[0], self.end_line[0] = len(self.names) - 1, len(self.lines)

    def depths(self, kind: int) -> np.ndarray:
        """For each element how many of it and those around it are marked in a way."""
        out = [int(k == kind) for k in self.aside]
        if kind not in self.aside:
            return np.array(out)
        for e in range(1, len(out)):
            out[e] += out[self.parents[e]]
        return np.array(out)

    def inside(self, names: frozenset[str]) -> np.ndarray:
        """Whether each element is, or is in, one of these names."""
        out = [n in names for n in self.names]
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parents[e]]
        return np.array(out)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    weight = np.exp(-0.5 * (np.arange(-WINDOW, WINDOW + 1) / sigma) ** 2)
    cut = slice(WINDOW, WINDOW + len(ratio))
    return np.convolve(ratio, weight)[cut] / np.convolve(np.ones(len(ratio)), weight)[cut]


def threshold(values: np.ndarray) -> float:
    """The least value of the upper of the two clusters with least summed variance."""
    v = np.sort(values)
    if v[0] == v[-1]:
        return float(v[0])
    n, s, q = np.arange(1, len(v)), np.cumsum(v), np.cumsum(v * v)
    below = q[:-1] - s[:-1] ** 2 / n
    above = (q[-1] - q[:-1]) - (s[-1] - s[:-1]) ** 2 / (len(v) - n)
    cost = np.where(v[1:] > v[:-1], below + above, np.inf)
    return float(v[1 + int(np.argmin(cost))])


def main_text(page: str | None, clustered: bool = True) -> str:
    """The main text; ``clustered=False`` takes every line for content, to show what the clusters do."""
    parser = Lines()
    parser.feed(page or "")
    parser.end()
    if not parser.lines:
        return ""
    elements = np.array([e for _, _, e in parser.lines])
    named, aside = parser.depths(NAMED)[elements] > 0, parser.depths(SET_ASIDE)[elements]
    lines = np.flatnonzero(aside == 0)  # those that take part at all
    if named[lines].all():  # all else is comments and adverts: an article among them that isn't marked
        lines = np.flatnonzero(_unmarked_container(parser)[elements])
    if named[lines].all():
        return ""
    size = np.array([len(t) for t, _, _ in parser.lines], float)
    tags = np.array([k for _, k, _ in parser.lines])
    if MARKED in parser.aside:
        lines = _unlost(parser, lines, elements, named, size / np.maximum(1, tags))
    seen = lines[~named[lines]]
    ratio = smoothed(size[lines] / np.maximum(1, tags[lines]))
    content = np.zeros(len(size), bool)
    content[lines] = ratio >= threshold(ratio) if clustered else True
    if not content[seen].any():
        content[seen] = True
    # regions are runs of content lines among the lines that aren't cleaned away
    marks, weight = content[seen], size[seen] * content[seen]
    starts = np.flatnonzero(marks & ~np.r_[False, marks[:-1]])
    ends = np.flatnonzero(marks & ~np.r_[marks[1:], False]) + 1
    sums = np.r_[0.0, np.cumsum(weight)]
    best = int(np.argmax(sums[ends] - sums[starts]))
    region = elements[seen[starts[best] : ends[best]]]
    heaviest = int(region[int(np.argmax(size[seen[starts[best] : ends[best]]]))])
    shared = int(region[0])
    for e in region.tolist():
        while not shared <= e <= parser.last[shared]:
            shared = parser.parents[shared]
    top = _container(parser, shared) or _container(parser, heaviest)
    if top:
        chosen = seen[(elements[seen] >= top) & (elements[seen] <= parser.last[top])]
    else:
        before = np.r_[0.0, np.cumsum(size * content * np.isin(np.arange(len(size)), seen))]
        top = heaviest
        while top and (parser.names[top] in SMALL or before[parser.end_line[top]] - before[parser.first_line[top]] < SHARE * sums[-1]):
            top = parser.parents[top]
        chosen = _content_parts(parser, top, elements, seen, size, before)
    return "\n\n".join(parser.lines[k][0] for k in chosen.tolist())


def _unmarked_container(parser: Lines) -> np.ndarray:
    """Whether each element is in an article or main that isn't set aside itself."""
    out = [n in CONTAINERS and k != SET_ASIDE for n, k in zip(parser.names, parser.aside, strict=True)]
    for e in range(1, len(out)):
        out[e] = parser.aside[e] != SET_ASIDE and (out[e] or out[parser.parents[e]])
    return np.array(out)


def _unlost(parser: Lines, lines: np.ndarray, elements: np.ndarray, named: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The lines but those in more marked elements than it takes to leave something with content."""
    depth = parser.depths(MARKED)[elements[lines]]
    least = threshold(smoothed(ratio[lines]))
    # a line has content by itself, not by its neighbours alone
    solid = (np.minimum(smoothed(ratio[lines]), ratio[lines]) >= least) | parser.inside(CONTAINERS | {"h1"})[elements[lines]]
    free = ~named[lines]
    chosen = depth[free & solid] if (free & solid).any() else depth[free]
    return lines[depth <= int(chosen.min())]


def _container(parser: Lines, element: int) -> int:
    """The article or main around an element, itself included: an outermost article, or else the nearest; 0 for none."""
    named = []
    while element:
        if parser.names[element] in CONTAINERS:
            named.append(element)
        element = parser.parents[element]
    return 0 if not named else named[-1] if parser.names[named[-1]] == "article" else named[0]


def _content_parts(parser: Lines, top: int, elements: np.ndarray, seen: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of the lines inside ``top``: those of its parts that are paragraphs and the like, or wholes of mostly content."""
    chars = np.r_[0.0, np.cumsum(size * np.isin(np.arange(len(size)), seen))]
    out, part = [], 0
    for k in seen[(elements[seen] >= top) & (elements[seen] <= parser.last[top])].tolist():
        e = int(elements[k])
        if not (part and part <= e <= parser.last[part]):
            part = e
            while part != top and parser.parents[part] != top:
                part = parser.parents[part]
        first, end = parser.first_line[part], parser.end_line[part]
        if part == top or parser.names[part] in SMALL or 2 * (before[end] - before[first]) >= chars[end] - chars[first]:
            out.append(k)
        if part == top:
            part = 0
    return np.array(out, np.int64)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html column, with text and its n_chars."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    of = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], b.schema.names)

    return of.mapInArrow(run, of.schema).withColumn("n_chars", F.length("text").cast("long"))
