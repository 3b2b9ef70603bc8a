"""Main text of web pages: streamed parser events, text-to-tag ratio per line, smoothing, clustering.

The standard library's parser streams events; each block of text is one line with its ratio of
text to tags. The ratios are smoothed by a Gaussian and lines above the threshold (the standard
deviation of the smoothed ratios) form the content cluster. The region is the smallest element
that holds the cluster, or the page's article and main elements where they hold most of it; its
lines are the article, short ones included, but for what the page itself marks as menus, forms,
adverts and the like. A mark around the page's main part is no furniture and is lifted.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, and customary names of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title script style noscript template button select option textarea iframe object svg canvas".split())
#: Furniture by name: its text is marked; of these only a form can be the frame of a whole page.
MARKED = frozenset("nav aside footer form dialog menu".split())
CONTAINERS = frozenset("article main".split())
FURNITURE = re.compile(
    r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|ads?|adsbygoogle|advert\w*|"
    r"sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|pagination|pager|widgets?|"
    r"login|search|toolbar|skip", re.I)
#: Words that may stand beside a furniture word in one name without changing what it names.
BESIDE = re.compile(
    r"site|page|main|global|top|bottom|left|right|upper|lower|primary|secondary|box|bar|wrap|wrapper|wrapped|container|"
    r"block|section|area|region|panel|inner|outer|list|items?|links?|buttons?|icons?|form|results?|slots?|units?|text|"
    r"image|post|posts|article|articles|stories|content|mobile|desktop|fixed|sticky|row|col|column|group|js|ui|"
    r"to|by|us|in|the|and|user|reader|thread|policy|privacy|cta|media|this|placeholder|wp|email|follow|card|message|info|tabs?|toggle|title|"
    r"heading|[a-z]|[0-9]+", re.I)
#: Header names with one of these hold an article's title.
TITLED = re.compile(r"post|posts|article|articles|content|text|section|story|entry|block", re.I)
#: Adverts may also be inline elements; other furniture names there are marks in prose or in code.
INLINE_ADS = re.compile(r"ads?|adsbygoogle|advert\w*|sponsor\w*|promo\w*", re.I)
#: A section of this name is furniture if people reply in it: a scientific discussion is not.
TALK = re.compile(r"discussions?|responses?|reactions|conversation", re.I)
REPLY = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|avatar|commenter|username)(?:$|[\s_-])", re.I)
REPLY_TEXT = re.compile(r"reply|(?:\d+ |reader |your |leave a )?(?:comments?|replies|responses?)(?: \(?\d+\)?)?", re.I)
HEADER = re.compile(r"header|masthead", re.I)
GROUPS = frozenset("div section ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class tokens that tell about the layout around an element, as has-sidebar does.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|have|with|without|no|not)[_-]", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements whose end may be left out, and the starts that imply it.
IMPLIED = {"p": BLOCKS - {"html", "body"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}),
           "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}
SIGMA = 1.0
#: Article and main elements are the region if they hold at least this share of the cluster's characters.
REGION_SHARE = 0.6
FRAMES = frozenset("body div section table tbody td #page html blockquote center".split()) | CONTAINERS


@dataclass
class Line:
    """One block's text, the tags inside it, its characters in links and the elements around it."""

    text: str
    tags: int
    linked: int
    owner: int
    tag: str


def named(token: str, words: re.Pattern) -> bool:
    """Whether a class or id names one of the words: a part of it does, and the others fit beside it."""
    parts = [x for x in re.split(r"[-_]+", token) if x]
    hits = [bool(words.fullmatch(x)) for x in parts]
    return any(hits) and all(hit or BESIDE.fullmatch(x) for hit, x in zip(hits, parts, strict=True))


def titled(token: str, within: bool) -> bool:
    """Whether a name with `header` in it may be that of an article's own header."""
    parts = re.split(r"[-_]+", token)
    return any(map(HEADER.fullmatch, parts)) and (within or any(map(TITLED.fullmatch, parts)))


class Lines(HTMLParser):
    """Collects the lines of a page; elements form a tree of numbered nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.names = [-1], ["#page"]
        #: The innermost marked element that a node lies in or is; 0 where there is none.
        self.marks = [0]
        self.stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        #: The open inline advert: its tag and how many elements of that name are open in it.
        self.advert: list | None = None
        #: Sections that are furniture once somebody replies in them, with the depth of the stack.
        self.talks: list[tuple[int, int]] = []
        self.spoken: set[int] = set()
        #: Elements with a furniture word somewhere in their name: furniture if they are mostly links.
        self.doubtful: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            if self.talks and REPLY_TEXT.fullmatch(text):
                self.spoken.update(node for node, _ in self.talks)
            self.lines.append(Line(text, self.tags, self.linked, self.stack[-1][1], self.stack[-1][0]))
        self.parts.clear()
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.talks and any(name in ("class", "id", "rel") and value and REPLY.search(value) for name, value in attrs):
            self.spoken.update(node for node, _ in self.talks)
        if tag not in BLOCKS and tag not in DROPPED and tag not in MARKED:
            if self.advert:
                self.advert[1] += tag == self.advert[0]
            elif tag not in VOID and any(name == "class" and value and any(
                    named(x, INLINE_ADS) for x in value.split()) for name, value in attrs):
                self.advert = [tag, 1]
            if tag == "a":
                self.links += 1
            elif tag in ("br", "td", "th"):
                self.parts.append(" ")
            return
        self.flush()
        last = self.stack[-1][0]
        while last in IMPLIED and tag in IMPLIED[last]:
            self._pop()
            last = self.stack[-1][0]
        if tag in VOID:
            return
        dropped = self.stack[-1][2] or tag in DROPPED or tag not in CONTAINERS and any(n == "hidden" for n, _ in attrs)
        parent = self.stack[-1][1]
        marked = tag in MARKED or self._furniture(tag, attrs) or self.advert
        self.marks.append(len(self.names) if marked else self.marks[parent])
        if tag in ("section", "div", "ul", "ol") and not marked and any(
                name in ("class", "id") and value and any(named(x, TALK) for x in value.split()) for name, value in attrs):
            self.talks.append((len(self.names), len(self.stack)))
        if tag in GROUPS and not marked and any(name in ("class", "id") and value and any(
                FURNITURE.fullmatch(part) for x in value.split() if not LAYOUT.search(x) for part in re.split("[-_]+", x))
                for name, value in attrs):
            self.doubtful.append(len(self.names))
        if tag in BLOCKS:
            self.advert = None  # the block carries the mark from here on
        self.parents.append(parent)
        self.names.append(tag)
        self.stack.append((tag, len(self.names) - 1, dropped))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _furniture(self, tag: str, attrs) -> bool:
        if tag in ("html", "body") or tag in CONTAINERS:
            return False
        within = any(self.open.get(c) for c in CONTAINERS)
        if tag == "header" and not within:
            return True
        for name, value in attrs:
            if not value:
                continue
            # A heading's id is an anchor, and the header of an article holds its title.
            if name == "class" or name == "id" and tag not in HEADINGS:
                if any(named(x, FURNITURE) and not LAYOUT.search(x) and not titled(x, within) for x in value.split()):
                    return True
            elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
                return True
        return False

    def _pop(self) -> None:
        self.flush()
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        while self.talks and self.talks[-1][1] >= len(self.stack):
            self.talks.pop()
        if tag in BLOCKS:
            self.advert = None  # an inline advert ends with its block at the latest

    def finish(self) -> None:
        """Read the rest and settle the marks that depend on what an element holds."""
        self.close()
        self.flush()
        late = set(self.spoken)
        if self.doubtful:
            linked, chars = [0] * len(self.names), [0] * len(self.names)
            for x in self.lines:
                linked[x.owner] += x.linked
                chars[x.owner] += len(x.text)
            _sums(self, linked), _sums(self, chars)
            late.update(n for n in self.doubtful if chars[n] and 2 * linked[n] >= chars[n])
        if late:
            for node in range(1, len(self.names)):
                if node in late:
                    self.marks[node] = node
                elif self.marks[node] != node:
                    self.marks[node] = self.marks[self.parents[node]]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.advert and tag == self.advert[0]:
            self.advert[1] -= 1
            if not self.advert[1]:
                self.advert = None
        if not self.open.get(tag):
            if tag in BLOCKS:
                self.flush()
            return
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.stack[-1][2] and not self.advert:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends repeat the outermost values."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _cluster(lines: list[Line]) -> tuple[list[bool], float]:
    """Which lines belong to the content cluster, and its threshold."""
    if not lines:
        return [], 0.0
    ratios = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    threshold = float(ratios.std())
    return (ratios >= threshold).tolist(), threshold


def _sums(page: Lines, start: list[int]) -> list[int]:
    """The numbers of the nodes, each with those of all nodes inside it."""
    for node in range(len(start) - 1, 0, -1):
        start[page.parents[node]] += start[node]
    return start


def _links_only(line: Line) -> bool:
    return bool(line.linked) and line.linked >= 0.9 * len(line.text)


def unmarked_lines(page: Lines) -> list[Line]:
    """The lines outside furniture. A mark around the main part of the page does not count: around
    `main`, around the only article elements, or, if no content is left outside the marks, the
    marks that hold most of the content cluster."""
    marks, parents, names = page.marks, page.parents, page.names
    if not any(marks):
        return page.lines
    mains = _sums(page, [int(name == "main") for name in names])
    articles = _sums(page, [int(name == "article") for name in names])
    outer = [0] * len(names)  # the next mark around a marked element
    children: dict[int, list[int]] = {}
    for node in range(1, len(names)):
        if marks[node] == node:
            outer[node] = marks[parents[node]]
            children.setdefault(outer[node], []).append(node)
    lifted = {0} | {m for m in set(marks) if mains[m]}

    def exposed() -> list[bool]:
        """Whether no mark that counts lies around a node."""
        shown = [True] * len(names)
        for node in range(1, len(names)):
            shown[node] = shown[parents[node]] and (marks[node] != node or node in lifted)
        return shown

    shown = exposed()
    if not any(shown[n] and names[n] in CONTAINERS for n in range(len(names))):
        todo = [0]
        while todo:
            for m in children.get(todo.pop(), ()):
                if articles[m] and names[m] not in MARKED - {"form"} and (articles[m] == 1 or names[m] == "form"):
                    lifted.add(m)
                if m in lifted:
                    todo.append(m)
        shown = exposed()
    within, threshold = _cluster(page.lines)
    content = [ok and not _links_only(x) and len(x.text) >= threshold * max(1, x.tags)
               for x, ok in zip(page.lines, within, strict=True)]
    if not any(ok and shown[x.owner] for x, ok in zip(page.lines, content, strict=True)):
        held, own = [0] * len(names), set()
        for x, ok in zip(page.lines, content, strict=True):
            if ok:
                held[x.owner] += len(x.text)
                own.add(marks[x.owner])
        held = _sums(page, held)
        # The marks that still count, the one with most of the cluster first, from outside inwards.
        ahead = [(-held[m], m) for at in lifted for m in children.get(at, ()) if m not in lifted]
        heapq.heapify(ahead)
        while ahead:
            size, m = heapq.heappop(ahead)
            if not size:
                break
            if names[m] in MARKED - {"form"}:
                continue
            lifted.add(m)
            if m in own:
                break
            for inner in children.get(m, ()):
                heapq.heappush(ahead, (-held[inner], inner))
        shown = exposed()
    return [x for x in page.lines if shown[x.owner]]


def content_region(page: Lines) -> list[Line]:
    """The lines outside furniture of the smallest element that holds the content cluster."""
    lines, parents, names = unmarked_lines(page), page.parents, page.names
    within, _ = _cluster(lines)
    cluster = [x for x, ok in zip(lines, within, strict=True) if ok]
    cluster = [x for x in cluster if not _links_only(x)] or cluster
    contained = [False] * len(names)
    for node in range(1, len(names)):
        contained[node] = contained[parents[node]] or names[node] in CONTAINERS
    marked = [x for x in cluster if contained[x.owner]]
    whole = sum(len(x.text) for x in cluster)
    only = bool(marked) and sum(len(x.text) for x in marked) >= REGION_SHARE * whole
    kept = {id(x) for x in _beside(page, lines, marked, cluster, contained)} if only else set()
    if only:
        cluster = [x for x in cluster if contained[x.owner] or id(x) in kept]
    lengths = [0] * len(names)
    for x in cluster:
        lengths[x.owner] += len(x.text)
    lengths = _sums(page, lengths)
    # Parents come before their children: the last node with all of it is the deepest.
    region = next((n for n in range(len(names) - 1, -1, -1) if lengths[n] == lengths[0]), 0)
    while region and names[region] not in (CONTAINERS if only and contained[region] else FRAMES):
        region = parents[region]
    inside = [False] * len(names)
    inside[region] = True
    for node in range(region + 1, len(names)):
        inside[node] = inside[parents[node]]
    return [x for x in lines if inside[x.owner] and (contained[x.owner] or not only or id(x) in kept)]


def _beside(page: Lines, lines: list[Line], marked: list[Line], cluster: list[Line], contained: list[bool]) -> list[Line]:
    """Lines outside article and main elements that go on with the article: cluster lines at least half
    as long as the median one inside and not mostly links, with the other lines of their element where
    they are most of it."""
    least = 0.5 * float(np.median([len(x.text) for x in marked]))
    prose = [x for x in cluster if not contained[x.owner] and len(x.text) >= least and 2 * x.linked < len(x.text)]
    if not prose:
        return []
    parents = page.parents
    holds = _sums(page, [int(name in CONTAINERS) for name in page.names])
    top = list(range(len(parents)))  # the largest element around a node without an article in it
    for node in range(1, len(parents)):
        if not holds[node] and not holds[parents[node]]:
            top[node] = top[parents[node]]
    chars, all_chars = dict.fromkeys(top, 0), dict.fromkeys(top, 0)
    for x in prose:
        chars[top[x.owner]] += len(x.text)
    for x in lines:
        all_chars[top[x.owner]] += len(x.text)
    full = {t for t in chars if t and not holds[t] and chars[t] >= REGION_SHARE * all_chars[t] > 0}
    long = {id(x) for x in prose}
    return [x for x in lines if not contained[x.owner] and (id(x) in long or top[x.owner] in full)]


def main_text(html: str) -> str:
    """The article's blocks joined by line ends; empty if the page has none."""
    page = Lines()
    page.feed(html.replace("<![", "<!-["))  # marked sections end at the next ">", as in browsers
    page.finish()
    return "\n".join(x.text for x in content_region(page)) if page.lines else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and its code points.

    Null html counts as empty and gives an empty text; null ids and urls stay null; repeated rows
    are read each; an empty table gives an empty one; other columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")
