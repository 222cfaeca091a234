"""Main text of web pages by consensus paths of their hosts.

Each page scores its containers; scores are summed by host and generalised path (tags and classes without
digits) in Spark, and every page is extracted again with the path that won on its host.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, within_bytes
from .urls import host_of

#: Bytes up to which the winning paths of hosts are broadcast, so that pages aren't shuffled.
BROADCAST_BYTES = 64_000_000

# fixed values: elements by what they are
_RAW = frozenset("script style textarea title".split())
_SKIPPED = frozenset("noscript template iframe object svg".split())
_IN_HEAD = frozenset("title meta link base style script noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav header footer aside form button select option dialog menu fieldset canvas audio video".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr "
    "math mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mfenced semantics".split()
)
_CONTAINERS = frozenset("body article main section div td center".split())
_LISTS = frozenset("ul ol table dl".split())
_ITEMS = frozenset("li dt dd tr td th".split())
# what a name may rule out: boxes, but no heading, paragraph or part of a sentence
_BOXES = frozenset("div section ul ol dl table center details figure".split())
_ENDS_PARAGRAPH = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# fixed values: names of what is never main text, what may follow such a name without changing it, what negates it
_UNWANTED = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside banner cookie cookies consent gdpr notice alert ad ads adsense advert advertisement advertising "
    "sponsor sponsored promo promotion popup modal overlay comment comments disqus respond reply replies social share sharing related breadcrumb breadcrumbs "
    "newsletter subscribe signup login search widget pagination pager toolbar skip".split()
)
_READERS = frozenset("comment comments disqus respond replies".split())
_FORM_WORDS = frozenset(
    "area bar block body box button buttons card col column container content form group holder icon icons inner inline item items label left link links list main "
    "menu outer panel post posts right row section slot thread top bottom unit wrap wrapper".split()
)
_NEGATIONS = frozenset("no not non without with has hide show".split())
_UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_WANTED = frozenset("article content post entry story main body text".split())
_NEVER_DROPPED = frozenset("html body main".split())

#: Share of the plain text of a page's own best path from which on the host's path is taken.
FAIR_SHARE = 0.25
#: Plain characters of a block from which on it counts as text where it stands beside the winning container.
LEAD = 60
#: Characters of a path and of a part of it, beyond which what is before stands as a digest.
PATH_CHARS, PART_CHARS = 400, 100

# a tag ends at the first > outside a quoted value, or with the page; there is one way only to read each quote
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+(?>\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?")
_DIGITS = re.compile(r"\d+")


class Block(NamedTuple):
    """A run of text in one block: what it says, letters of it in links, the innermost container and region in doubt."""

    text: str
    linked: int
    container: int
    region: int


class Page(NamedTuple):
    """The containers of a page by number, with the one around each (-1: none) and their generalised paths; the blocks that may
    be main text; the containers in one that is named like something else."""

    around: list[int]
    paths: list[str]
    blocks: list[Block]
    doubted: frozenset[int] = frozenset()


def _gone(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _NEVER_DROPPED:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    return tag != "article" and (tag in _DROPPED or attributes.get("role", "").lower() in _UNWANTED_ROLES)


def _named(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether a class names something that is never main text, and whether a part of a class or of the id does.

    A name of several parts is what its last part says ("cookie-notice", but not "notice-period"), or its first
    where the others only say what form that has ("comment-list"). An id is as often the anchor of a heading, so that it
    rules out what readers wrote only.
    """
    named, in_part = False, False
    for kind in ("class", "id"):
        for name in attributes.get(kind, "").lower().split():
            parts = [p for p in re.split(r"[_\-\d]+", name) if p]
            in_part = in_part or not _UNWANTED.isdisjoint(parts)
            unwanted = _UNWANTED if kind == "class" else _READERS
            if parts and _NEGATIONS.isdisjoint(parts[:-1]):
                named = named or parts[-1] in unwanted or (parts[0] in unwanted and _FORM_WORDS.issuperset(parts[1:]))
    return named, in_part


class _Regions:
    """Elements that their name may rule out, the one around each (-1: none), whether the whole name does, and where
    articles stand among them."""

    def __init__(self) -> None:
        self.around: list[int] = []
        self.named: list[bool] = []
        self.articles: set[int] = set()

    def without(self, blocks: list[Block]) -> list[Block]:
        """The blocks that are in no element that goes. One that is named so goes, unless it holds an article or main or most of the
        page's plain text and none stands outside. One that is named so in part goes if it holds an article and one stands outside."""
        n = len(self.around)
        sizes, holds = [0] * n, [r in self.articles for r in range(n)]
        for block in blocks:
            if block.region >= 0:
                sizes[block.region] += _plain(block)
        for r in range(n - 1, -1, -1):
            if (outer := self.around[r]) >= 0:
                sizes[outer] += sizes[r]
                holds[outer] = holds[outer] or holds[r]
        total = sum(map(_plain, blocks))
        beside, gone = [False] * n, [False] * n
        for r, outer in enumerate(self.around):
            beside[r] = outer in self.articles or (outer >= 0 and beside[outer])
            goes = beside[r] or not (holds[r] or 2 * sizes[r] > total) if self.named[r] else beside[r] and holds[r]
            gone[r] = goes or (outer >= 0 and gone[outer])
        return [b for b in blocks if b.region < 0 or not gone[b.region]]


def _longer(path: str, tag: str, classes: list[str]) -> str:
    """The path of a container, of bounded length."""
    part = tag + "".join(f".{c}" for c in classes)
    short = lambda text: blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    part = part if len(part) <= PART_CHARS else f"{tag}.{short(part)}"
    return f"{path if len(path) <= PATH_CHARS else short(path)}/{part}"


class _Element(NamedTuple):
    """An open element: its tag, path, whether it is left out, innermost container, whether in a link, region in doubt."""

    tag: str
    path: str
    dropped: bool
    container: int
    in_link: bool
    region: int


class _Parser:
    """Takes a page apart in one pass. Unclosed and crossed tags are as usual on the web: a block start ends an open
    paragraph, an end tag closes all that is open within its element. What is kept for an open element is of
    bounded size, however deep it is."""

    def __init__(self) -> None:
        self.around: list[int] = []
        self.paths: list[str] = []
        self.doubted: set[int] = set()
        self.blocks: list[Block] = []
        self.regions = _Regions()
        self.stack = [_Element("", "", False, -1, False, -1)]
        # how deep the open elements are of each tag, those that aren't inline, and those that an open paragraph doesn't
        # reach out of, the innermost last
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks_open, self.barriers = [0], [0]
        self.text: list[str] = []
        self.linked = 0

    def pop_to(self, depth: int) -> None:
        for element in self.stack[depth:]:
            self.open[element.tag].pop()
        del self.stack[depth:]
        for depths in (self.blocks_open, self.barriers):
            while depths[-1] >= depth:
                depths.pop()

    def close_block(self) -> None:
        if self.text:
            said = " ".join("".join(self.text).split())
            if said:
                self.blocks.append(Block(said, self.linked, self.stack[-1].container, self.stack[-1].region))
            self.text.clear()
        self.linked = 0

    def leave_head(self) -> None:
        """A head without an end tag ends at the first thing that can't stand in it."""
        if self.stack[-1].tag == "head":
            self.pop_to(len(self.stack) - 1)

    def say(self, piece: str) -> None:
        if self.stack[-1].tag == "head" and piece.strip():
            self.leave_head()
        if piece and not self.stack[-1].dropped:
            piece = unescape(piece)
            self.text.append(piece)
            self.linked += len(piece) if self.stack[-1].in_link else 0

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        depth = self.open[tag][-1]
        if tag not in _INLINE:
            self.close_block()
        elif depth < self.blocks_open[-1]:
            # an inline end tag doesn't reach out of its block
            return
        self.pop_to(depth)

    def _end_open(self, closes: str) -> None:
        """Ends an open paragraph or item, if it is in the same container and list."""
        if self.open[closes] and self.open[closes][-1] >= self.barriers[-1]:
            self.pop_to(self.open[closes][-1])

    def start(self, tag: str, rest: str) -> None:
        if tag in _ENDS_PARAGRAPH or tag in _ITEMS:
            self.close_block()
            self._end_open("p" if tag in _ENDS_PARAGRAPH else tag)
        elif tag not in _INLINE:
            self.close_block()
        if tag in _VOID or (rest.endswith("/") and tag in _INLINE):
            return
        outer = self.stack[-1]
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}
        dropped = outer.dropped or tag == "head" or _gone(tag, attributes)
        path, container, region = outer.path, outer.container, outer.region
        named, in_part = _named(attributes) if tag in _BOXES and not dropped else (False, False)
        if named or in_part:
            self.regions.around.append(region)
            self.regions.named.append(named)
            region = len(self.regions.around) - 1
        elif tag in ("article", "main") and not dropped:
            self.regions.articles.add(region)
        if tag in _CONTAINERS and not dropped:
            path = _longer(path, tag, sorted({_DIGITS.sub("", c) for c in attributes.get("class", "").lower().split()} - {""}))
            self.around.append(container)
            self.paths.append(path)
            if named or in_part or container in self.doubted:
                self.doubted.add(len(self.paths) - 1)
            container = len(self.paths) - 1
        depth = len(self.stack)
        self.stack.append(_Element(tag, path, dropped, container, outer.in_link or tag == "a", region))
        self.open[tag].append(depth)
        if tag not in _INLINE:
            self.blocks_open.append(depth)
        if tag in _CONTAINERS or tag in _LISTS:
            self.barriers.append(depth)


def parse(html: str) -> Page:
    """Containers and blocks of a page, without what is never main text, in time and memory in proportion to its length."""
    p, at, endless = _Parser(), 0, set()
    while token := _TOKEN.search(html, at):
        p.say(html[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            p.end(tag)
            continue
        if tag not in _IN_HEAD:
            p.leave_head()
        if tag in _RAW or (tag in _SKIPPED and not token[3].endswith("/")):
            # where one has no end tag, no later one of its name has
            end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            if end:
                at = end.end()
            elif tag in _RAW:
                at = len(html)
            else:
                endless.add(tag)
            if tag == "title":
                p.close_block()
        elif tag == "br":
            if not p.stack[-1].dropped:
                p.text.append(" ")
        elif tag not in _SKIPPED:
            p.start(tag, token[3])
    p.say(html[at:])
    p.close_block()
    return Page(p.around, p.paths, p.regions.without(p.blocks), frozenset(p.doubted))


def _plain(block: Block) -> int:
    return max(0, len(block.text) - 2 * block.linked)


def scores(page: Page) -> dict[str, float]:
    """For each path the share of the page's text in it that isn't link text, weighed by what it is called.

    A container that is named like something else, in whole or in part, has half its score. One that has all the text
    is as good as one within it that has all of it too; the inner wins.
    """
    total = sum(map(_plain, page.blocks))
    if not total:
        return {}
    held = [0] * len(page.paths)
    for block in page.blocks:
        if block.container >= 0:
            held[block.container] += _plain(block)
    for c in range(len(held) - 1, -1, -1):
        if page.around[c] >= 0:
            held[page.around[c]] += held[c]
    out: dict[str, float] = {}
    for c, (path, n) in enumerate(zip(page.paths, held, strict=True)):
        tag, _, classes = path.rpartition("/")[2].partition(".")
        good = {"article": 1.3, "main": 1.2, "body": 0.5}.get(tag, 1.0) * (1.1 if set(re.split(r"[._-]", classes)) & _WANTED else 1.0) * (0.5 if c in page.doubted else 1.0)
        out[path] = out.get(path, 0.0) + good * n / total * (1 + 0.01 * min(20, path.count("/")))
    return out


def extract(page: Page, path: str | None) -> str:
    """The blocks in containers with that path and in what leads up to them, in page order. Where they have less than
    FAIR_SHARE of the plain text that the page's own best path has, that one is taken, and if it has none all blocks are."""

    def within(choice: str | None) -> list[Block]:
        chosen = {c for c, p in enumerate(page.paths) if p == choice}
        around, near = _beside(page, chosen)
        inside = _inside(page, chosen | near)
        return [b for b in page.blocks if b.container >= 0 and (inside[b.container] or (b.container in around and _plain(b) >= LEAD))]

    own = within(max(sorted(s), key=s.get) if (s := scores(page)) else None)
    said = within(path)
    if sum(map(_plain, said)) < FAIR_SHARE * sum(map(_plain, own)):
        said = own
    return " ".join(b.text for b in said or own or page.blocks)


def _inside(page: Page, chosen: set[int]) -> list[bool]:
    inside: list[bool] = []
    for c, outer in enumerate(page.around):
        inside.append(c in chosen or (outer >= 0 and inside[outer]))
    return inside


def _beside(page: Page, chosen: set[int]) -> tuple[set[int], set[int]]:
    """The containers around chosen ones, of which long blocks are text too, and containers in these that are text like the chosen
    ones: not named like something else, mostly no links, and with a block of LEAD plain letters. What is called
    article or main is whole by itself."""
    tag = lambda c: page.paths[c].rpartition("/")[2].partition(".")[0]
    outer = {page.around[c] for c in chosen if tag(c) not in ("article", "main", "body", "td")}
    outer -= {-1}
    if not outer:
        return set(), set()
    near = {c for c, around in enumerate(page.around) if around in outer and c not in chosen and c not in page.doubted and tag(c) in ("div", "section", "center")}
    plain, said, longest = dict.fromkeys(near, 0), dict.fromkeys(near, 0), dict.fromkeys(near, 0)
    top: list[int] = []
    for c, around in enumerate(page.around):
        top.append(c if c in near else top[around] if around >= 0 else -1)
    for b in page.blocks:
        if b.container >= 0 and (c := top[b.container]) in near:
            plain[c] += _plain(b)
            said[c] += len(b.text)
            longest[c] = max(longest[c], _plain(b))
    return outer, {c for c in near if longest[c] >= LEAD and 2 * plain[c] > said[c]}


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the highest sum of scores on each host that has a name. Scores are summed before the shuffle."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes = [(host, path, score) for host, html in zip(batch["host"], batch["html"], strict=True) for path, score in scores(parse(html)).items()]
            yield pd.DataFrame(votes, columns=["host", "path", "score"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("html IS NOT NULL AND host <> ''")
    votes = rows.mapInPandas(vote, "host string, path string, score double").groupBy("host", "path").agg(F.sum(F.round("score", 6).cast("decimal(28,6)")).alias("score"))
    return votes.groupBy("host").agg(F.max(F.struct("score", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, path.

    The text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles, markup and reader comments; character references are decoded, white space in a block is one
    space, blocks are joined by one. Null or empty pages have an empty text; pages without a host (null or
    odd URLs) don't vote and are read by their own best path. Rows repeat as they come; other columns are not read.
    """
    page_host, host = "__page_host", "__host"
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn(page_host, host_of(F.col("url")))
    winners = cut(host_paths(pages, url_col, html_col).withColumnRenamed("host", host))
    # beyond the bound both sides are shuffled, and adaptive execution may split a host with very many pages
    winners = F.broadcast(winners) if within_bytes(winners, BROADCAST_BYTES) else winners
    joined = rows.join(winners, rows[page_host] == winners[host], "left").drop(page_host, host)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(parse(h), p) if h else "" for h, p in zip(batch["html"], batch["path"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "path": batch["path"]})

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(each, f"page_id {kind}, url string, text string, n_chars long, path string")
