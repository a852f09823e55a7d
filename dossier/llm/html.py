"""Main text of a page: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The streaming parser cuts the page into lines at block-level tags and counts
text and tags of each; text inside links does not count. Ratios are smoothed
along the page and the lines over the threshold are the content. Only from them
comes the region: the article elements that hold such lines, if these hold most
of the content, else the main element, else the blocks of the chosen lines and
what lies between. Short lines of the region stay although their own ratio is
low, runs of bare links do not. Kinds and names of elements give a prior: parts
marked as page furniture have no ratio.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SIGMA = 1.0  # of the smoothing, in lines
LAMBDA = 1.0  # threshold in standard deviations of the smoothed ratios
HOLDS = 0.5  # articles (or a main element) holding this share of the content are the region
LINKS = 3  # so many lines of bare links in a row, none of them chosen, are a menu
# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead
tr ul title""".split())
SPACED = set("br td th img input".split())
FURNITURE = set("""aside audio button canvas datalist dialog embed fieldset footer form head iframe input label legend map menu meter nav
noscript object optgroup option output progress script select style svg template textarea title video""".split())
FURNITURE_NAMES = set("""ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment
commentlist comments consent cookie cookies disqus donate footer header masthead menu modal nav navbar navigation newsletter notice notices
outbrain pagination pager popup promo promoted promotion recommended related replies respond share sharing sidebar skyscraper social
sponsor sponsored subscribe taboola toolbar topbar widget""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup header".split())
HEAD_NAMES = set("banner header masthead".split())  # of a site, or of an article where one of the next stands beside it
ARTICLE_NAMES = set("article entry post story".split())
FURNITURE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
REGIONS = set("article body center div html main section".split())
CONTAINERS = set("article body blockquote center div html main section table tbody td tr".split())
CLOSES_SAME = set("dd dt li optgroup option td th tr".split())
NAMES = re.compile(r"[A-Za-z]+")
BROKEN_END = re.compile(r"<[/!?A-Za-z][^<>]*\Z")


class Lines(HTMLParser):
    """Lines of a page in order, each with its element; elements as parallel lists with the parent's number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.off = ["#"], [0], [False]
        self.link, self.inside = [False], [False]  # in a link; in an article or main element
        self.open: list[int] = [0]
        self.lines: list[tuple[int, str, int, int]] = []  # element, text, tags, characters outside links
        self.text: list[str] = []
        self.at, self.tags, self.bare = 0, 0, 0

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((self.at, line, self.tags, min(self.bare, len(line))))
                self.tags = 0
            self.text, self.bare = [], 0

    def furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in FURNITURE:
            return True
        inside = self.inside[self.open[-1]]
        if tag == "header":
            return not inside
        for k, v in attrs:
            if v and (k == "class" or k == "id") and tag not in ("html", "body", "article", "main"):
                names = set(NAMES.findall(v.lower()))
                if inside or tag in HEADINGS or not ARTICLE_NAMES.isdisjoint(names):
                    names -= HEAD_NAMES
                if not FURNITURE_NAMES.isdisjoint(names):
                    return True
            elif k == "class" and v and tag == "article" and "comment" in v.lower():
                return True
            elif k == "role" and v and v.lower() in FURNITURE_ROLES:
                return True
            elif k == "hidden" or k == "aria-hidden" and v == "true":
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            self.close_to("p", BLOCK)
        elif tag in SPACED:
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_SAME:
            self.close_to(tag, {"dl", "ol", "ul", "menu", "select", "table", "tbody", "thead", "tfoot", "tr"} - {tag})
        top = self.open[-1]
        off = self.off[top] or self.furniture(tag, attrs)
        if off != self.off[top]:
            self.flush()
        self.tag.append(tag)
        self.parent.append(top)
        self.off.append(off)
        self.link.append(self.link[top] or tag == "a")
        self.inside.append(self.inside[top] or tag in ("article", "main"))
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("div", "p", "script", "style"):
            self.handle_endtag(tag)

    def close_to(self, tag: str, stops: set[str]) -> None:
        """Close an open ``tag`` unless one of ``stops`` lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[i]]
            if t == tag:
                if tag in BLOCK:
                    self.flush()
                del self.open[i:]
                return
            if t in stops:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        elif tag in SPACED:
            self.text.append(" ")
        for i in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[i]] == tag:
                if self.off[self.open[i]] != self.off[self.open[i - 1]]:
                    self.flush()
                del self.open[i:]
                return
            if tag not in BLOCK and self.tag[self.open[i]] in CONTAINERS:
                return  # an inline end tag closes nothing outside its block

    def handle_data(self, data):
        if self.off[self.open[-1]]:
            return
        if not self.text:
            self.at = self.open[-1]
        self.text.append(data)
        if not self.link[self.open[-1]]:
            self.bare += sum(map(len, data.split()))


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, r, mode="edge"), k / k.sum(), mode="valid")


def ratios(lines: list[tuple[int, str, int, int]]) -> np.ndarray:
    return np.array([bare / max(1, tags) for _, _, tags, bare in lines])


def region(page: Lines, chosen: np.ndarray, own: np.ndarray) -> list[int]:
    """Numbers of the lines to keep, in page order, given the lines over the threshold, smoothed and by themselves.

    An article is kept for a line that is over it by itself, not for a neighbour's.
    """
    lines, size = page.lines, len(page.tag)
    article, main, block = [0] * size, [0] * size, [0] * size  # nearest element of each kind, 0 where there is none
    for n in range(1, size):
        up, tag = page.parent[n], page.tag[n]
        article[n] = n if tag == "article" else article[up]
        main[n] = n if tag == "main" else main[up]
        block[n] = n if tag in REGIONS else block[up]
    mass = [len(line[1]) if yes else 0 for line, yes in zip(lines, chosen)]
    for near in (article, main):
        held = {near[line[0]] for line, yes in zip(lines, own) if yes} - {0}
        if held and sum(m for line, m in zip(lines, mass) if near[line[0]]) >= HOLDS * sum(mass):
            kept = [near[line[0]] in held for line in lines]
            break
    else:
        held = {block[line[0]] for line, yes in zip(lines, chosen) if yes}
        first, last = int(chosen.argmax()), len(lines) - 1 - int(chosen[::-1].argmax())
        kept = [first <= i <= last or block[line[0]] in held for i, line in enumerate(lines)]
        start = kept.index(True)
        while start and heading(page, lines[start - 1][0]):
            start -= 1
            kept[start] = True
    run = 0
    for i in range(len(lines) + 1):
        if i < len(lines) and not chosen[i] and not lines[i][3]:
            run += 1
            continue
        if run >= LINKS:
            kept[i - run:i] = [False] * run
        run = 0
    return [i for i, yes in enumerate(kept) if yes]


def heading(page: Lines, n: int) -> bool:
    while n and page.tag[n] not in REGIONS:
        if page.tag[n] in HEADINGS:
            return True
        n = page.parent[n]
    return False


def main_text(html: str | None) -> str:
    """Text of the content region, one line per block. Null, empty and textless pages give an empty text."""
    if not html:
        return ""
    page = Lines()
    page.feed(BROKEN_END.sub("", html))
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    raw = ratios(lines)
    ratio = smoothed(raw)
    least = min(LAMBDA * ratio.std(), ratio.max())
    return "\n".join(lines[i][1] for i in region(page, ratio >= least, raw >= least))


def extracted(html: Column) -> Column:
    def of(col: pa.Array) -> pa.Array:
        return pa.array([main_text(t) for t in col.to_pylist()], pa.string())
    return F.arrow_udf(of, "string")(html)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (its code points); columns of these names are replaced.

    One row per row, whatever repeats or is null. The page is parsed whole.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.select(*kept, extracted(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
