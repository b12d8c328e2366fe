"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes by the rules of HTML: a name may hold quotes, so may a value without quotes.
_ATTRS = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?+)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.A,
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""", re.S | re.A)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption hr header footer nav aside address details summary form fieldset "
    "legend center dialog menu hgroup search".split()
)
#: A start tag of the first kind ends an open element of the second kind, up to the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
SIDE_TAGS = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video search".split())
SIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos "
    "promotion promoted banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login sidebar sidebars rail widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer footers masthead topbar toolbar comment comments commentlist disqus replies "
    "respond share sharing social related recommended recommendations pagination pager".split()
)
#: A class with one of these words tells of the page's state, not what the element is.
STATE_WORDS = frozenset("no not non has have with without open closed enabled disabled allowed hide show".split())
#: Elements of these are reader comments, however much of the page they hold.
READER_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: Elements whose class names describe the page, not themselves.
ROOTS = frozenset(("html", "body", "article", "main"))


@dataclass(slots=True, eq=False)
class Path:
    """A tag path: one object per distinct path of a page, so deep pages stay linear."""

    label: str
    parent: Path | None
    below: dict[str, Path] = field(default_factory=dict)

    def down(self, label: str) -> Path:
        if label not in self.below:
            self.below[label] = Path(label, self)
        return self.below[label]

    def labels(self) -> tuple[str, ...]:
        out: list[str] = []
        at: Path | None = self
        while at is not None:
            out.append(at.label)
            at = at.parent
        return tuple(reversed(out))


@dataclass(slots=True, eq=False)
class Element:
    """A block element or listed inline element. ``article`` is the outermost one, ``main`` the first one before it."""

    name: str
    path: Path
    parent: Element | None
    depth: int = 0
    firm: bool = False
    listed: str = ""
    main: Element | None = None
    article: Element | None = None
    side: bool = False
    mass: int = 0


@dataclass(slots=True)
class _Open:
    name: str
    link: bool
    element: Element
    own: bool


@dataclass(slots=True)
class Block:
    """Text of one block: the element it stands in, and what of it is link text."""

    element: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _label(name: str, attrs: dict[str, str]) -> str:
    words = (attrs.get("class", "") + " " + attrs.get("role", "")).lower().split()
    return ".".join([name, *sorted(words)])


def _listed(name: str, attrs: dict[str, str], in_article: bool) -> tuple[bool, str]:
    """Whether an element is page furniture by its tag, role or style, and the word for which its names list it as such."""
    if (name in SIDE_TAGS and name != "form") or "hidden" in attrs or (name == "header" and not in_article):
        return True, ""
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True, ""
    if name in ROOTS:
        return False, ""
    role = attrs.get("role", "").lower()
    if role in SIDE_ROLES and role != "form":
        return True, ""
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = set(re.split(r"[^a-z0-9]+", token))
        if words & STATE_WORDS:
            continue
        if words & READER_WORDS:
            return False, "reader"
        if words & SIDE_WORDS or ("header" in words and not in_article):
            return False, "names"
    return False, "form" if "form" in (name, role) else ""


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of a page and the elements that may hold them, both in page order. Linear in the page at any depth."""
    top = Element("#page", Path("#page", None), None)
    stack = [_Open("#page", False, top, True)]
    counts: dict[str, int] = {}
    blocks: list[Block] = []
    elements = [top]
    current: Block | None = None
    at, size = 0, len(page)

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            current = Block(stack[-1].element)
            blocks.append(current)
        current.parts.append(text)
        if stack[-1].link:
            current.link_chars += len(text)

    def pop_to(index: int) -> None:
        nonlocal current
        while len(stack) > index:
            gone = stack.pop()
            counts[gone.name] -= 1
            if gone.own:
                current = None

    while at < size:
        match = _TOKEN.search(page, at)
        text = page[at : match.start() if match else size]
        if text:
            add(entities.unescape(text))
        if not match:
            break
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            if match[0].startswith("<![CDATA["):
                add(match[0][9:].removesuffix("]]>"))
            continue
        if match["close"]:
            if counts.get(name):
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name == "br":
            add(" ")
            continue
        attrs = {}
        if match["attrs"]:
            for a in _ATTR.finditer(match["attrs"]):
                attrs.setdefault(a[1].lower(), entities.unescape(next((x for x in a.groups()[1:] if x is not None), "")))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name in BLOCK:
                current = None
            continue
        if name in IMPLIED and any(counts.get(x) for x in IMPLIED[name][0]):
            ended, bound = IMPLIED[name]
            low = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in bound:
                    break
                if stack[i].name in ended:
                    low = i
            if low < len(stack):
                pop_to(low)
        if name in BLOCK and counts.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    pop_to(i)
                    break
                if stack[i].name in BLOCK:
                    break
        within = stack[-1].element
        firm, listed = _listed(name, attrs, bool(counts.get("article") or counts.get("main")))
        own = name in BLOCK or firm or bool(listed)
        if own:
            kind = name
            if name == "div" and (attrs.get("role", "").lower() == "main" or "articlebody" in attrs.get("itemprop", "").lower()):
                kind = "main"
            new = Element(kind, within.path.down(_label(name, attrs)), within, within.depth + 1, within.firm or firm, listed)
            new.article = within.article or (new if kind == "article" else None)
            new.main = within.main or (new if kind == "main" and not new.article else None)
            elements.append(new)
            within, current = new, None
        counts[name] = counts.get(name, 0) + 1
        stack.append(_Open(name, stack[-1].link or name == "a", within, own))
    for block in blocks:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in blocks if b.text], elements


def _scores(blocks: list[Block], smooth: tuple[float, float]) -> dict[Path, float]:
    sums: dict[Path, list[float]] = {}
    for b in blocks:
        own = sums.setdefault(b.element.path, [0, 0, 0, 0, 0])
        own[0] += len(b.text)
        own[1] += len(_PUNCTUATION.findall(b.text))
        own[2] += 1
        own[3] += b.link_chars
        own[4] += b.element.side
    by_parent: dict[Path | None, list[Path]] = {}
    for path in sums:
        by_parent.setdefault(path.parent, []).append(path)
    out = {}
    for paths in by_parent.values():
        text = np.array([sums[p][0] / sums[p][2] for p in paths])
        marks = np.array([sums[p][1] / sums[p][2] for p in paths])
        for ratio in (text, marks):
            wide = np.pad(ratio, 1, mode="edge")
            ratio[:] = smooth[0] * ratio + smooth[1] * (wide[:-2] + wide[2:])
        for p, t, m in zip(paths, text, marks, strict=True):
            links = min(1.0, sums[p][3] / max(1, sums[p][0]))
            out[p] = 0.0 if sums[p][4] else float(t * (1 + m) * (1 - links))
    return out


def path_scores(blocks: list[Block], smooth: tuple[float, float] = (0.5, 0.25)) -> dict[tuple[str, ...], float]:
    """Fused ratio of every tag path.

    Text length and punctuation are summed per path and divided by its blocks;
    both ratios are smoothed over the paths of one parent in page order, fused
    as their product and weakened by the share of link text. Paths under page
    furniture score nothing.
    """
    return {p.labels(): s for p, s in _scores(blocks, smooth).items()}


def _content(blocks: list[Block], cut: float) -> set[Path]:
    """Paths whose fused ratio reaches ``cut`` standard deviations of all; every path outside furniture if none does."""
    scores = _scores(blocks, (0.5, 0.25))
    limit = cut * float(np.std(list(scores.values()))) if scores else 0.0
    return {p for p, s in scores.items() if s > 0 and s >= limit} or {b.element.path for b in blocks if not b.element.side}


def _weigh(blocks: list[Block], elements: list[Element], content: set[Path]) -> int:
    """Characters on content paths outside furniture, of every element and in all."""
    for e in elements:
        e.mass = 0
    for b in blocks:
        if b.element.path in content and not b.element.side:
            b.element.mass += len(b.text)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.mass += e.mass
    return elements[0].mass


def _settle(blocks: list[Block], elements: list[Element], cut: float) -> None:
    """Tell page furniture: what is so by tag, role or style, and what is listed by its names unless it holds the page.

    A form with half of the content is a wrapper and stays. So is another listed
    element with nine tenths of it and a title (h1), article or main element, if
    none of these has text outside listed elements. Reader comments never are.
    """
    for e in elements:
        e.side = e.firm
    if any(e.listed for e in elements):
        total = _weigh(blocks, elements, _content(blocks, cut))
        free: set[Element] = set()
        for e in elements:
            if not e.listed and (e.parent is None or e.parent in free):
                free.add(e)
        titled = {b.element for b in blocks if not b.element.firm and (b.element.article or b.element.main or b.element.name == "h1")}
        told = bool(titled & free)
        for e in reversed(elements):
            if e in titled and e.parent is not None:
                titled.add(e.parent)
        for e in elements:
            wrapper = total > 0 and (
                (e.listed == "form" and 2 * e.mass >= total)
                or (e.listed == "names" and not told and e in titled and 10 * e.mass >= 9 * total)
            )
            e.side = e.firm or (e.parent is not None and e.parent.side) or (bool(e.listed) and not wrapper)


def main_text(page: str | None, cut: float = 0.5, share: float = 0.1) -> str:
    """The main text of a page; blocks in page order, one per line.

    Paths whose fused ratio reaches ``cut`` standard deviations of all paths
    are content, and their blocks are kept wherever they stand, unless they
    are page furniture or mostly link text. What else is kept lies around
    them. Article and main elements with ``share`` of the content of the
    heaviest one are kept whole if they hold most of the content, with the
    headings and blocks that a main element has beside such an article. If they
    hold less, or the page marks none, these are the blocks of the deepest
    element with nine tenths of the content and titles (h1); if that is the
    page itself, only those of which a sibling path is content.
    """
    if not page:
        return ""
    blocks, elements = blocks_of(page)
    _settle(blocks, elements, cut)
    kept = [b for b in blocks if not b.element.side]
    if not kept:
        return ""
    content = _content(blocks, cut)
    total = _weigh(blocks, elements, content)
    own: dict[Element, int] = {}
    for b in kept:
        marked = b.element.article or b.element.main
        if marked and b.element.path in content:
            own[marked] = own.get(marked, 0) + len(b.text)
    filled = {e for e, w in own.items() if w >= share * max(own.values())}
    around: set[Element] = set()
    for e in filled:
        up = e.parent if e.name == "article" else None
        while up is not None and up not in around:
            around.add(up)
            up = up.parent
    marked_only = 2 * sum(own[e] for e in filled) > total
    rooted: set[Element] = set()
    near: set[Path | None] | None = None
    if not marked_only:
        root = elements[0]
        for e in elements:
            if e.mass >= 0.9 * total and e.depth >= root.depth:
                root = e
        for e in elements:
            if e is root or e.parent in rooted:
                rooted.add(e)
        if root.name in ("#page", "html", "body"):
            near = {p.parent for p in content}

    def stays(b: Block) -> bool:
        e = b.element
        linked = 2 * b.link_chars > max(1, len(b.text))
        if not marked_only:
            at_root = e in rooted and (near is None or e.path.parent in near)
            return not linked and (e.path in content or at_root or e.name == "h1")
        if e.article in filled or (e.main in filled and not e.article and e.main not in around):
            return True
        if linked or e.path in content:
            return not linked
        if e.article or e.main not in around:
            return False
        up = e.parent
        while up is not None and up.name in ("header", "hgroup"):
            up = up.parent
        return e.main in filled or e.name == "h1" or up in around

    return "\n".join(b.text for b in kept if stays(b))


def extract_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: key, url, text and n_chars (code points).

    One pass without shuffle; a task holds one batch of pages. Null, empty and
    text-free pages give an empty text; repeated rows are judged each; markup
    cut short is read as far as it goes; other columns are not read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    batch.column("_url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["_key", "_url", "text", "n_chars"],
            )

    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(parse, f"_key {kinds['_key']}, _url {kinds['_url']}, text string, n_chars bigint")
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
