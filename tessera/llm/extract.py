"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path (class and id tokens included). Text length and punctuation
are aggregated per path and per container, smoothed along the path and fused with what the path's place, names and link share say;
paths whose score reaches the threshold are content. Each step takes time in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field as member
from html import unescape
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._arrow import annotate, field

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^<>]*)>""", re.S)
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，؟।、]")

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template svg canvas iframe object head title nav header footer aside form button select option input textarea label fieldset dialog menu audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SETS_APART = frozenset("body article main section".split())
SCOPES = frozenset("ul ol dl table body article section div main td th".split())
#: Words in class, id and role names.
PAGE_FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot copyright legal share sharing social related recommended recommendations widget comment comments commentlist reply replies respond disqus discussion feedback reviews talkback boxout teaser disclaimer byline pagination pager toolbar skip search form complementary contentinfo dialog".split())
CONTENT_NAMES = frozenset("article content post entry story body main text prose maincontent articlebody".split())


@dataclass
class Path:
    """A root-to-leaf tag path, with class and id tokens; equal paths of a page are one object."""

    tag: str
    names: frozenset[str]
    up: Path | None
    place: int
    dropped: bool
    inside: bool  # of an article or main element
    holder: Path | None = None  # the innermost block element
    container: Path | None = None  # the innermost element that sets its text apart
    link: bool = False

    furniture: bool = False  # named so, or in what is
    content: bool = False

    def containers(self) -> Iterator[Path]:
        """Its container, and those around it from the innermost on."""
        at = self.container
        while at is not None:
            yield at
            at = at.up and at.up.container


@dataclass
class Block:
    path: Path
    parts: list[str] = member(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", unescape("".join(self.parts))).strip()


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    out, hidden = set(), False
    if attributes and not attributes.isspace():
        for name, a, b, c in _NAMES.findall(attributes):
            name, value = name.lower(), unescape(a or b or c)
            if name in ("class", "id", "role", "itemprop"):
                out.update(x.lower() for x in _SPLIT.split(value) if x)
                out.update(x for x in re.split(r"[^a-z]+", value.lower()) if x)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return frozenset(out), hidden


class _Page:
    """The open elements of a page, with the places of each tag, so that no step looks through all of them."""

    def __init__(self):
        root = Path("", frozenset(), None, 0, False, False)
        root.holder = root.container = root
        self.paths: dict[tuple, Path] = {}
        self.stack, self.places = [root], {}
        self.done: list[Block] = []
        self.current: Block | None = None

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if not text or top.dropped:
            return
        if self.current is None or self.current.path is not top.holder:
            self.flush()
            self.current = Block(top.holder)
        self.current.parts.append(text)
        if top.link:
            self.current.linked += len(text)

    def flush(self) -> None:
        if self.current is not None:
            self.done.append(self.current)
        self.current = None

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of these tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        if place:
            for path in self.stack[place:]:
                self.places[path.tag].pop()
            del self.stack[place:]

    def open(self, tag: str, attributes: str) -> None:
        up = self.stack[-1]
        names, hidden = _names(attributes)
        key = (up.place, tag, names, hidden)
        path = self.paths.get(key)
        if path is None:
            dropped = up.dropped or hidden or tag in DROPPED and not (tag == "header" and bool(self.places.get("article")))
            path = Path(tag, names, up, len(self.paths) + 1, dropped, up.inside or tag in ("article", "main"), link=up.link or tag == "a")
            path.furniture = up.furniture or bool(names & PAGE_FURNITURE) and tag not in ("article", "main", "body", "html")
            path.content = up.content or bool(names & CONTENT_NAMES)
            path.holder = up.holder if tag in INLINE else path
            path.container = path if tag in SETS_APART or names and tag not in INLINE else up.container
            self.paths[key] = path
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(path)


def read_page(html: str) -> _Page:
    """The page's paths and its text blocks in page order: text between block-level boundaries, with the path of its innermost block
    element."""
    page, at, raw = _Page(), 0, None
    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        tag = (m[2] or m[5] or "").lower()
        closing = (m[1] or m[4]) == "/"
        if raw:
            if not (closing and tag == raw):
                continue
            raw = None
        else:
            page.add(html[at : m.start()])
        at = m.end()
        if not tag:
            if m[0].startswith("<![CDATA["):
                page.add(m[0][9:-3].replace("&", "&amp;"))
            continue
        if tag not in INLINE:
            page.flush()
        elif tag == "br":
            page.add(" ")
        if closing:
            page.close(page.last((tag,)))
            continue
        if tag in CLOSES_P and (p := page.last(("p",))) > page.last(("article", "div", "section", "td", "li", "body")):
            page.close(p)
        if tag in CLOSED_BY_OWN and (own := page.last(CLOSED_BY_OWN[tag])) > page.last(SCOPES - set(CLOSED_BY_OWN[tag])):
            page.close(own)
        if tag in VOID:
            continue
        page.open(tag, m[3] or m[6] or "")
        if tag in RAW:
            raw = tag
    if not raw:
        page.add(html[at:])
    page.flush()
    return page


@dataclass
class Ratio:
    """Text length, punctuation and link text summed over the blocks of a path or container."""

    chars: int = 0
    marks: int = 0
    linked: int = 0
    count: int = 0
    long_chars: int = 0  # both sums again, each block weighed by its length
    long_marks: int = 0

    def add(self, chars: int, marks: int, linked: int) -> None:
        self.chars, self.marks, self.linked, self.count = self.chars + chars, self.marks + marks, self.linked + linked, self.count + 1
        self.long_chars, self.long_marks = self.long_chars + chars * chars, self.long_marks + marks * chars

    def typical(self) -> tuple[float, float]:
        """Length and punctuation of the block a character lies in on average, at most twice those of a block."""
        return min(self.long_chars / self.chars, 2 * self.chars / self.count), min(self.long_marks / self.chars, 2 * self.marks / self.count)

    def fused(self, chars: float, marks: float) -> float:
        """Length and punctuation per block against those of the page's main text, from 0 to 1."""
        length = min(1.0, self.chars / self.count / chars)
        return 0.7 * length**0.5 + 0.3 * (min(1.0, self.marks / self.count / marks) if marks else length) ** 0.5


def leaf(block: Block, text: str) -> tuple[int, bool]:
    """The path of a block (its place), and whether it goes on into a link that holds all the text."""
    return block.path.place, 10 * block.linked >= 9 * len(text)


def path_ratios(found: list[tuple[Block, str]], of: Callable[[Block, str], Hashable]) -> dict[Hashable, Ratio]:
    """The ratio of what ``of`` makes of the blocks: their paths, or their containers."""
    out: dict[Hashable, Ratio] = {}
    for b, t in found:
        out.setdefault(of(b, t), Ratio()).add(len(t), len(_PUNCTUATION.findall(t)), min(b.linked, len(t)))
    return out


def _named(path: Path) -> float:
    """What the class, id and role names of a path say: one bounded feature."""
    return -0.45 if path.furniture else 0.1 if path.content else 0.0


def _headings(found: list[tuple[Block, str]], keep: list[bool], names: dict[int, float]) -> None:
    """A heading is kept if something up to the next heading is, of its container or like it inside the article; one right before a
    kept heading too. With nothing below, its score decides."""
    below: Path | None = None
    text, directly = False, False  # whether there is text up to the next heading; whether ``below`` is that heading itself
    for k in range(len(found) - 1, -1, -1):
        b = found[k][0]
        c = b.path.container
        if not re.fullmatch("h[1-6]", b.path.tag):
            below = c if keep[k] else None if directly else below
            text, directly = True, False
            continue
        heads = below is not None and (c is below or c.inside and below.inside and names[c.place] >= 0)
        keep[k] = heads or keep[k] and not text
        below, text, directly = c if keep[k] else None, False, True


def main_text(html: str | None, threshold: float = 0.55) -> str:
    """The blocks whose path reaches ``threshold``, joined by two line feeds.

    Text length and punctuation per block are summed over tag paths and over the containers they lie in. A path's ratio is smoothed
    with its container's and fused with smaller features, none of which reaches the threshold by itself: lying in an article or
    main element, beside it, behind or apart from the main container, names, and link text. A heading goes with what it heads.
    """
    page = read_page(html or "")
    found = [(b, t) for b in page.done if (t := b.text())]
    if not found:
        return ""
    has_article = any(p.tag in ("article", "main") and not p.dropped for p in page.paths.values())
    own, held = path_ratios(found, leaf), path_ratios(found, lambda b, _: b.path.container.place)
    containers = {b.path.container.place: b.path.container for b, _ in found}
    prose = {k: r.chars - r.linked for k, r in held.items()}
    whole = sum(prose.values())
    large = [k for k in held if 4 * prose[k] >= whole] or list(held)
    typical = [max(x) for x in zip(*(held[k].typical() for k in large), strict=True)]
    names = {k: _named(p) for k, p in containers.items()}
    weight = {k: (prose[k] * held[k].fused(*typical) + 1e-9) * (3 if p.inside else 1) * (0.3 if names[k] < 0 else 1) for k, p in containers.items()}
    main = containers[max(weight, key=weight.__getitem__)]
    trunk = {p.place for p in main.containers()}
    order = [b.path.container.place for b, _ in found]
    end = len(order) - order[::-1].index(main.place)
    first = {k: n for n, k in reversed(list(enumerate(order)))}

    score = {}
    for b, t in found:
        if (at := leaf(b, t)) in score:
            continue
        c, r = b.path.container, own[at]
        apart = sum(1 for x in islice(c.containers(), 2) if x.place not in trunk)
        beside = 0.15 if c.inside else -0.4 if has_article else 0.0
        named = max(names[c.place], -0.2) if c.place in trunk else names[c.place]
        linked = r.linked / r.chars
        score[at] = 0.4 * r.fused(*typical) + 0.6 * held[c.place].fused(*typical) + beside + named - 0.1 * apart - 0.1 * (first[c.place] >= end) - 0.7 * (linked > 0.6)
    keep = [score[leaf(b, t)] >= threshold for b, t in found]
    _headings(found, keep, names)
    return "\n\n".join(t for (_, t), k in zip(found, keep, strict=True) if k)


def _extractor(threshold: float) -> Callable[[], Callable[[pa.Array], list]]:
    def make():
        def run(pages: pa.Array) -> list:
            texts = [main_text(h, threshold) for h in pages.to_pylist()]
            return [texts, [len(t) for t in texts]]

        return run

    return make


def extract_main_text(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = 0.55) -> DataFrame:
    """``keep`` columns, text (the article's blocks joined by two line feeds; empty if there is none) and n_chars.

    Null and empty pages give an empty text; unclosed and stray tags are taken as browsers take them; repeated rows are each
    extracted.
    """
    return annotate(pages, html, _extractor(threshold), [field("text", "string"), field("n_chars", "long")], keep)


def op6_extract(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
