"""Main text of web pages.

The standard library's streaming parser gives start tags, end tags and text.
Block-level tags cut the page into lines.  A line's text-to-tag ratio is its
text outside of links over the start tags since the line before; the ratios are
smoothed by a Gaussian over neighbouring lines, and lines above a threshold are
clusters of content.  Lines in page furniture (navigation, scripts, hidden
elements and the like, told by element and role) have ratio zero.

The clusters select the content regions.  The outermost article and main
elements that hold a cluster are regions as a whole, short lines included,
unless the clusters outside of them weigh more.  Otherwise the region is the
smallest container that holds nearly all of the clusters' weight; of the page's
body only what lies between the first cluster and the last, with the headings
above.

A class name is evidence, not a verdict.  It counts if all of its words are those
of page furniture (``share-buttons``, not ``share-price``); then it lowers the
weight of its lines, which stay if the smoothed ratio is above the threshold even
so.  Where names would leave less than a third of the page's unlinked text, and there
is no article or main element, they are not believed.  An article or main element
inside a named container is content again, and names that state a condition
(has-sidebar, comments-open) say nothing.  Only elements, roles and hidden states
are sure.

Defined results: null and empty pages give the empty text; character references
are decoded; white space of any kind and length inside a block is one space;
blocks are joined by one space in page order; equal pages give equal texts and an
empty table an empty one; other columns stay, those named text or n_chars are
replaced.  Nothing is cut short: pages may be of any length and elements nested to
any depth, and time grows in proportion to the page.  Marks that can't be read
(unfinished tags, comments and declarations) end at the next ``>``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, texts

# Names of elements and of page furniture.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("article body center div main section td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FURNITURE = frozenset(
    "nav footer aside script style noscript template head title iframe object canvas svg button select option textarea "
    "dialog menu menuitem audio video map datalist".split()
)
_REGIONS = frozenset(("article", "main"))
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
_STRONG_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal newsletter "
    "subscribe subscription signup login breadcrumb breadcrumbs sidebar sidebars navbar navigation nav related recommend recommended recommendations share sharing "
    "social comment comments commentlist disqus replies respond footer masthead topbar toolbar pagination pager".split()
)
_WEAK_NAMES = frozenset("notice notices alert alerts banner banners menu menus widget widgets rail tags overlay header skip".split())
#: Words that go with those of furniture in a name without saying anything else.
_STRUCTURE = frozenset(
    "box bar block section area list links link buttons button btn icons icon container wrapper wrap inner outer row col column item items panel unit slot form field message msg text title heading label "
    "posts post articles stories story news site page top bottom left right side primary secondary main global mobile desktop sticky fixed floating small large big first last new more follow us me a the and bg "
    "zone space placeholder group grid card cards content body media network feed tweet facebook twitter linkedin whatsapp email mail user reader readers thread author meta info close toggle js css el component module".split()
)
_CONDITIONS_BEFORE = frozenset("has with no is without not show hide hides shows".split())
_CONDITIONS_AFTER = frozenset("open opened closed enabled disabled on off free left right".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that a sibling's start tag closes, and what they lie in.
_CLOSED_BY_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

#: How sure it is that a line is furniture: content, inside a form, by a name, by its element.
_PLAIN, _FORM, _NAMED, _SURE = range(4)
#: What a name leaves of a line's weight, and the share of the unlinked text that names must leave to be believed.
_NAME_WEIGHT, _LEAST_SHARE = 0.1, 1 / 3
#: Elements that a paragraph doesn't reach across.
_FENCES = (_BLOCKS | _FURNITURE) - {"p"}


@lru_cache(maxsize=4096)
def name_evidence(names: str) -> int:
    """0, 1 (weak) or 2 (strong): what the names of a class or id attribute say for furniture."""
    found = 0
    for name in names.split():
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        if not _STRUCTURE.union(_STRONG_NAMES, _WEAK_NAMES).issuperset(words):
            continue  # another word tells what it is about
        if not words or words[0] in _CONDITIONS_BEFORE or (len(words) > 1 and words[-1] in _CONDITIONS_AFTER and words[-2] in _STRONG_NAMES | _WEAK_NAMES):
            continue
        if not _STRONG_NAMES.isdisjoint(words):
            return 2
        if not _WEAK_NAMES.isdisjoint(words):
            found = 1
    return found


class _Lines(HTMLParser):
    """Lines of a page: text, tags, link characters, level of furniture, region, container, heading or not."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, int] | None] = []  # tag, level, region, container; None if closed before what it holds
        self.at: dict[str, list[int]] = {}  # places of each tag in ``open``
        self.fences: list[int] = []
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []
        self.level: list[int] = []
        self.region: list[int] = []
        self.node: list[int] = []
        self.heading: list[bool] = []
        self.parents: list[int] = [-1]
        self.n_regions = 0
        self.parts: list[str] = []
        self.n_tags = self.n_link = 0
        self.no_comment_end = False

    # -- marks that can't be read end at the next ">"

    def _skipped(self, i: int) -> int:
        k = self.rawdata.find(">", i + 1)
        return len(self.rawdata) if k < 0 else k + 1

    def parse_starttag(self, i):
        k = super().parse_starttag(i)
        return k if k >= 0 else self._skipped(i)

    def parse_endtag(self, i):
        k = super().parse_endtag(i)
        return k if k >= 0 else self._skipped(i)

    def parse_pi(self, i):
        return self._skipped(i)

    def parse_comment(self, i, report=1):
        k = -1 if self.no_comment_end else super().parse_comment(i, report)
        if k >= 0:
            return k
        self.no_comment_end = True
        return self._skipped(i)

    def parse_marked_section(self, i, report=1):
        return self._skipped(i)

    # -- lines

    def _state(self) -> tuple[int, int, int]:
        return self.open[-1][1:] if self.open else (_PLAIN, 0, 0)

    def _last(self, tags) -> int:
        """Place of the innermost open element of these, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                level, region, node = self._state()
                self.texts.append(text)
                self.tags.append(self.n_tags)
                self.links.append(self.n_link)
                self.level.append(level)
                self.region.append(region)
                self.node.append(node)
                self.heading.append(any(self.at.get(h) for h in _HEADINGS))
                self.n_tags = self.n_link = 0
            self.parts = []

    def _close_to(self, at: int) -> None:
        self._flush()
        while len(self.open) > at:
            self._pop()
        self._trim()

    def _pop(self) -> None:
        top = self.open.pop()
        if top is not None:
            self.at[top[0]].pop()
            if top[0] in _FENCES:
                self.fences.pop()

    def _trim(self) -> None:
        while self.open and self.open[-1] is None:
            self.open.pop()

    @staticmethod
    def _furniture(tag: str, attrs: list[tuple[str, str | None]], region: int) -> int:
        if tag in _FURNITURE or (tag == "header" and not region):
            return _SURE
        if tag in ("html", "body"):
            return _PLAIN
        level = _FORM if tag == "form" else _PLAIN
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                return _SURE
            if not v:
                continue
            if k in ("class", "id"):
                evidence = name_evidence(v)
                if tag in _REGIONS:
                    # page builders put many names on a whole article
                    if evidence == 2 and re.search(r"comment|\bads?\b|sponsor|related|promo", v, re.IGNORECASE):
                        level = _NAMED
                elif evidence == 2 or (evidence == 1 and tag in _BLOCKS and tag not in _HEADINGS and tag not in ("p", "blockquote", "pre", "figure", "li", "td")):
                    level = _NAMED
            elif k == "role" and v in _FURNITURE_ROLES and tag != "article":
                level = max(level, _FORM if v == "form" else _NAMED)
            elif k == "style" and _HIDDEN.search(v):
                return _SURE
        return level

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._flush()
            if tag in _CLOSED_BY_SIBLING:
                siblings, around = _CLOSED_BY_SIBLING[tag]
                last, limit = self._last(siblings), self._last(around)
                if last > limit:
                    # the outermost of the siblings that lie in here
                    inside = [self.at[t][bisect_right(self.at[t], limit)] for t in siblings if self.at.get(t) and self.at[t][-1] > limit]
                    self._close_to(min(inside))
            if tag != "br" and (at := self._last(("p",))) > (self.fences[-1] if self.fences else -1):
                self._close_to(at)  # a block ends a paragraph that is still open
        self.n_tags += 1
        if tag in _VOID:
            return
        level, region, node = self._state()
        own = self._furniture(tag, attrs, region)
        if tag in _REGIONS and own == _PLAIN and level < _SURE:
            level = _PLAIN  # an article or main element is content, whatever the names around it are
        elif own > level:
            self._flush()
            level = own
        if tag in _REGIONS and level == _PLAIN and not region:
            self.n_regions += 1
            region = self.n_regions
        if tag in _CONTAINERS:
            self.parents.append(node)
            node = len(self.parents) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in _FENCES:
            self.fences.append(len(self.open))
        self.open.append((tag, level, region, node))

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCKS:
            self._flush()
        self.n_tags += 1

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self._flush()
        if not self.at.get(tag):
            return
        i = self.at[tag][-1]
        if tag not in _BLOCKS and self.fences and self.fences[-1] > i:
            return  # an inline end tag doesn't reach out of its block
        if self.open[i][1] or tag in _BLOCKS:
            self._close_to(i)
        else:
            self.at[tag].pop()
            if tag in _FENCES:
                self.fences.remove(i)
            self.open[i] = None
            self._trim()

    def handle_data(self, data):
        self.parts.append(data)
        if self.at.get("a"):
            self.n_link += len(data)

    def lines(self, html: str) -> None:
        self.feed(html)
        self.close()
        self._flush()


def smooth(ratio: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    """The ratios under a Gaussian window; the ends are padded by zeros."""
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    return np.convolve(ratio, kernel / kernel.sum())[radius : radius + len(ratio)]


def clusters(ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Which lines are in clusters of content, the smoothed ratios, and the threshold."""
    smoothed = smooth(ratio)
    top = float(smoothed.max(initial=0.0))
    threshold = min(float(smoothed.std()), 0.5 * top) if top > 0 else 0.0
    return (ratio > 0) & (smoothed >= threshold), smoothed, threshold


def _with_title(part: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """``part`` with the headings that stand right above it, unless it has some of its own."""
    first = int(np.flatnonzero(part)[0]) if part.any() else 0
    if not (part & heading).any():
        while first > 0 and heading[first - 1]:
            first -= 1
            part[first] = True
    return part


def content_lines(page: _Lines, whole: float = 0.85, long_form: int = 250) -> list[int]:
    """Numbers of the lines in the selected regions."""
    n = len(page.texts)
    if not n:
        return []
    length = np.array([len(t) for t in page.texts], dtype=float)
    level, region, node = np.array(page.level), np.array(page.region), np.array(page.node)
    own = np.maximum(length - np.minimum(page.links, length), 0.0)
    named = level == _NAMED
    plain = (level == _PLAIN) | named
    if not own[plain].any() and own[level == _FORM].sum() >= long_form:
        plain |= level == _FORM  # a page that is one form
    if not plain.any():
        return []
    if not own[plain & ~named & (region > 0)].any() and own[plain & ~named].sum() < _LEAST_SHARE * own[plain].sum():
        named &= False
    ratio = np.where(plain, own / np.maximum(page.tags, 1), 0.0) * np.where(named, _NAME_WEIGHT, 1.0)
    chosen, smoothed, threshold = clusters(ratio)
    # names are believed where the neighbours alone lift a line over the threshold
    chosen &= ~named | (ratio >= threshold)
    # a named line stays if it is in a cluster in spite of its name
    plain &= ~named | chosen
    if not chosen.any():
        return np.flatnonzero(plain & (own > 0)).tolist()
    weight = np.where(chosen & ~named, np.minimum(smoothed, ratio), 0.0)
    inside = plain & (region > 0)
    if weight[inside].sum() >= 0.5 * weight.sum():
        holds = np.zeros(page.n_regions + 1, dtype=bool)
        holds[region[chosen & inside]] = True
        part = inside & holds[region]
        return np.flatnonzero(_with_title(part, np.array(page.heading) & (level < _SURE) & (own > 0))).tolist()
    # the smallest container with nearly all of the weight; children come after their parents
    sums = np.bincount(node, weight, len(page.parents))
    lines = np.bincount(node[plain], minlength=len(page.parents))
    for i in range(len(page.parents) - 1, 0, -1):
        sums[page.parents[i]] += sums[i]
        lines[page.parents[i]] += lines[i]
    at = int(np.flatnonzero(sums >= whole * sums[0])[-1])
    while at > 0 and lines[at] < 2:
        at = page.parents[at]
    below = np.zeros(len(page.parents), dtype=bool)
    below[at] = True
    for i in range(at + 1, len(page.parents)):
        below[i] = below[page.parents[i]]
    part = plain & below[node]
    if at == 0 or page.parents[at] == 0:
        # the body: from the first cluster to the last, with the headings above
        solid = np.flatnonzero(chosen & part & (ratio >= threshold))
        first, last = (solid if len(solid) else np.flatnonzero(chosen & part))[[0, -1]].tolist()
        part[:first], part[last + 1 :] = False, False
    part = _with_title(part, np.array(page.heading) & (level < _SURE) & (own > 0))
    # three link-only lines and more in a row are a menu
    menu = part & (own == 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], menu, [False])).astype(int)))
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if z - a >= 3:
            part[a:z] = False
    return np.flatnonzero(part).tolist()


def extract(html: str) -> str:
    """The main text of one page."""
    page = _Lines()
    page.lines(html)
    return " ".join(page.texts[i] for i in content_lines(page))


def extract_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) of each page's main text."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        made = [extract(h) for h in texts(batch, html)]
        return {"text": made, "n_chars": [len(t) for t in made]}

    return map_batches(pages, run, {"text": T.StringType(), "n_chars": T.LongType()}, keep=keep)
