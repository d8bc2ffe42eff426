"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf path of block tags. Per path, the length of the text outside links and the
punctuation per block are aggregated (text ratio, punctuation ratio), smoothed over the blocks in page order, and fused by
multiplication; paths whose fused ratio passes a threshold set by the page's own top are content. The main text is what the
lowest element that holds the content nodes holds: its other blocks (short paragraphs, headings, list items) belong to it
unless they are mostly links. Where article or main elements hold content, that element is looked for within them.

What HTML itself names a menu, footer, sidebar or form does not count. Class and id names are one factor of the ratio of a part
without content of its own: they weaken it, some more and some less, and a part of the article whose blocks stay as strong as the
article's own is kept. Links do not count against headings, nor against anything within an article element.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|textarea|title|iframe|svg|annotation-xml|annotation|select|object|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*>?",
    re.S | re.I,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-hidden|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?¿¡…。、，！？]")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset datalist head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of class and id values that name a part of a page which is not its article ...
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist respond reply replies disqus share sharing social related "
    "recommended recommendations widget widgets login search form pagination pager paywall toc skip hidden teaser teasers rail crumb crumbs subnav sidenav blogroll copyright colophon "
    "adbox adslot adsbygoogle outbrain taboola feedback rating ratings print tagcloud".split()
)
#: Those of them that are hardly ever part of an article; the others only weaken it.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr newsletter subscribe subscription signup sidebar sidebars nav navbar navigation "
    "breadcrumb breadcrumbs comments commentlist disqus share sharing login paywall adbox adslot adsbygoogle outbrain taboola hidden".split()
)
#: ... where the other words of the name say nothing: "cookie-notice-box" names a notice, "rating-scale" does not name a rating.
PLAIN = frozenset(
    "a an and the of to our your us my me it by in on at for with box block blocks wrap wrapper container content contents area section list item items bar panel column col row inner outer top bottom left right middle main "
    "first second last site page post posts article entry blog user users reader readers visitor visitors link links button buttons slot unit region zone group head header heading title body text card tile icon icons media "
    "global local mobile desktop sticky fixed primary secondary tertiary small large x js id div module component placeholder policy accept message messages follow email e mail thread tree count icon new now here this site "
    "story stories news articles more read also see up out down off next prev previous".split()
)
#: Words of names that say so of comments only where the part is outside the article.
OUTER_HINTS = frozenset("header head top bottom logo branding discussion discussions".split())
#: Layout classes name parts that an element has or lacks, not what it is.
_LAYOUT = re.compile(r"\b(?:no|has|with|without|hide|show)[-_]\w+|\b\w+[-_](?:open|closed|enabled|disabled|on|off|layout|visible)\b", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)


#: (opening tags, what they close first, containers up to which they look for it).
CLOSING = (
    (CLOSES_P, frozenset({"p"}), frozenset("td th li dd button article section div".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset("ul ol menu".split())),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset("tr td th".split()), frozenset({"table"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset("tr table".split())),
    (frozenset({"option"}), frozenset({"option"}), frozenset({"select"})),
)
RULE = {tag: k for k, (tags, _, _) in enumerate(CLOSING) for tag in tags}
MATTERS = frozenset().union(*(closed | until for _, closed, until in CLOSING))


@dataclass(slots=True)
class Element:
    """An element of a page. Numbers go in the order of the start tags; ``last`` is the number of its last descendant."""

    tag: str
    path: int
    number: int
    parent: int
    out: bool = False  # it or one around it does not count
    root: int = 0  # the outermost article or main around it
    article: bool = False  # it or one around it is an article
    header: bool = False  # within a header of the article
    hint: float = 1.0  # what its own name leaves of its ratio
    last: int = 0
    lowest: tuple[int, ...] = ()  # for each rule of CLOSING the lowest open element that it would close


@dataclass(slots=True)
class Block:
    path: int
    element: int
    text: str
    linked: int

    @property
    def own(self) -> int:
        return len(self.text) - self.linked


def _hinted(value: str, inside: bool) -> float:
    """What a class or id leaves of a part's ratio: 1 if it says nothing against it."""
    out = 1.0
    for token in _CAMEL.sub("-", _LAYOUT.sub(" ", value)).lower().split():
        words = set(_WORD.findall(token))
        rest = words - HINTS
        if words & HINTS and rest <= PLAIN or not inside and words & OUTER_HINTS and rest - OUTER_HINTS <= PLAIN:
            out = min(out, 1 / 4 if words & NEVER else 3 / 4)
    return out


def parse(html: str) -> tuple[list[Element], list[Block]]:
    """Elements and blocks of a page in order; a block is a run of text between the starts and ends of block elements, white space
    collapsed. Work and memory grow with the page, however deep its elements nest."""
    elements = [Element("", 0, 0, 0, lowest=(0,) * len(CLOSING))]
    paths: dict[tuple[int, str], int] = {}
    stack, open_, out = [0], dict[str, int](), list[Block]()
    parts: list[str] = []
    linked, link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append(Block(elements[stack[-1]].path, stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        for e in stack[k:]:
            elements[e].last = len(elements) - 1
            open_[elements[e].tag] -= 1
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if link:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = not m["end"]
            continue
        flush()
        if m["end"]:
            if open_.get(tag):
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag))
                link = False
            continue
        if tag in VOID:
            continue
        rule = RULE.get(tag)
        if rule is not None and (k := elements[stack[-1]].lowest[rule]):
            pop_to(k)
        names, role, itemprop, drop = "", "", "", tag in BOILERPLATE
        attrs = m["attrs"]
        if attrs:
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    names += " " + value
                elif name == "role":
                    role = value.lower()
                elif name == "itemprop":
                    itemprop = value.lower()
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    drop = True
        above, number, k = elements[stack[-1]], len(elements), len(stack)
        inside = bool(above.root)
        article = tag == "article" or role == "article" or itemprop == "articlebody"
        hint = _hinted(names, inside) if names and tag not in ("html", "body", "main") else 1.0
        lowest = above.lowest
        if tag in MATTERS:
            lowest = tuple(0 if tag in until else k if tag in closed and not low else low for low, (_, closed, until) in zip(lowest, CLOSING, strict=True))
        elements.append(
            Element(
                tag, paths.setdefault((above.path, tag), len(paths) + 1), number, above.number, above.out or drop or role in ROLES or tag == "header" and not inside,
                above.root or (number if article or tag == "main" or role == "main" else 0), above.article or article, above.header or tag == "header" and inside, hint, lowest=lowest,
            )
        )
        stack.append(number)
        open_[tag] = open_.get(tag, 0) + 1
    if at < len(html):
        parts.append(html[at:])
    flush()
    pop_to(1)
    elements[0].last = len(elements) - 1
    return elements, out


def path_ratios(found: list[Block]) -> dict[int, float]:
    """Fused ratio per path: text and punctuation per block, each smoothed over the blocks in page order."""
    index = {p: k for k, p in enumerate(dict.fromkeys(b.path for b in found))}
    of = np.array([index[b.path] for b in found])
    n = np.bincount(of)
    text = np.bincount(of, [b.own for b in found]) / n
    mark = np.bincount(of, [len(_PUNCT.findall(b.text)) * (b.own > 0) for b in found]) / n

    def smooth(per_path: np.ndarray) -> np.ndarray:
        x = np.pad(per_path[of], 1, mode="edge")
        return np.bincount(of, 0.25 * x[:-2] + 0.5 * x[1:-1] + 0.25 * x[2:]) / n

    # geometric means: a path between menus and notices loses by them; a path that recurs weighs as its text does
    fused = np.sqrt(text * smooth(text)) * np.sqrt((1 + mark) * (1 + smooth(mark))) * n
    return {p: float(fused[k]) for p, k in index.items()}


def _container(elements: list[Element], found: list[Block], content: np.ndarray) -> Element:
    """The lowest element that holds every content block: that of the first and the last one. Elements that hold nothing but their
    own text (p, li, h1) are passed over, and sections, which are parts of an article."""
    holds = [False] * len(elements)
    for b in found:
        e = elements[b.element].parent
        while e and not holds[e]:
            holds[e] = True
            e = elements[e].parent
    own = [elements[found[k].element if holds[found[k].element] else elements[found[k].element].parent] for k in np.flatnonzero(content)[[0, -1]].tolist()]
    at, last = own[0], own[1].number
    while at.number and not at.number <= last <= at.last:
        at = elements[at.parent]
    while at.number and at.tag == "section":
        at = elements[at.parent]
    return at


#: Share of the page's highest ratio from which a path is content.
THRESHOLD = 0.5
#: Share of a block of the article, by its ratio and the hint of its name, that keeps a named part of the article.
NAMED = 0.3
#: Share of the largest article's text that another one of the page needs.
BESIDE = 0.1


def _sums(elements: list[Element], found: list[Block], amount: list[float]) -> list[float]:
    """The sum over the blocks within each element."""
    out = [0.0] * len(elements)
    for b, x in zip(found, amount, strict=True):
        out[b.element] += x
    for e in reversed(elements[1:]):
        out[e.parent] += out[e.number]
    return out


def _strength(b: Block) -> float:
    return b.own * (1 + len(_PUNCT.findall(b.text))) ** 0.5


def extract(html: str | None, ratios=path_ratios) -> str:
    """The article's blocks joined by line feeds; empty for null, empty and contentless pages."""
    if not html:
        return ""
    elements, every = parse(html)
    found = [b for b in every if not elements[b.element].out]
    if not found:
        return ""
    whole = sum(b.own for b in found)
    mass, parts = _sums(elements, found, [b.own for b in found]), _sums(elements, found, [1] * len(found))
    # by name no article; a name does not count where the page has little else
    hint = [1.0] * len(elements)
    for e in elements[1:]:
        m = mass[e.number]
        hint[e.number] = min(hint[e.parent], e.hint if m < whole and (2 * m <= whole or parts[e.number] < 3) else 1.0)
    named = np.array([hint[b.element] < 1 for b in found])
    if not named.all():
        fused = ratios([b for b, x in zip(found, named, strict=True) if not x])
        each = np.array([0.0 if x else fused[b.path] for b, x in zip(found, named, strict=True)])
    else:
        each = np.zeros(len(found))
    root = np.array([elements[b.element].root for b in found])
    head = np.array([elements[b.element].header and elements[b.element].tag not in HEADINGS for b in found])
    top = each.max()
    if top <= 0:
        return "\n".join(b.text for b, r, h, x in zip(found, root, head, named, strict=True) if r and not h and not x)
    content = each >= THRESHOLD * top
    own = np.array([b.own for b in found])
    weight = np.bincount(root, own * content, len(elements))
    weight[0] = 0
    if not weight.any():
        held = (root > 0) & ~named
        if 2 * own[held].sum() > whole:  # short articles next to one long notice
            weight = np.bincount(root[held], own[held], len(elements))
    if weight.any():
        # the outermost article elements with a fair share; teasers of other articles have little text
        inside = (weight >= BESIDE * weight.max())[root] & (root > 0)
    else:
        held = _container(elements, found, content)
        inside = np.array([held.number <= b.element <= held.last for b in found])
    # a named part of the article stays if, hint and all, its blocks are as strong as the article's
    if (inside & named).any() and weight.any():
        strength = np.array([_strength(b) for b in found])
        plain = np.sort(strength[inside & ~named])[::-1]
        typical = plain[np.searchsorted(np.cumsum(plain), plain.sum() / 2)] if plain.sum() else 0.0
        total, n = _sums(elements, found, strength.tolist()), _sums(elements, found, [1] * len(found))
        weak = [False] * len(elements)
        for e in elements[1:]:
            own_hint = e.hint < 1 and hint[e.number] < 1 and e.root and n[e.number]
            weak[e.number] = weak[e.parent] or bool(own_hint) and total[e.number] / n[e.number] * e.hint < NAMED * typical
        named &= ~inside | np.array([weak[b.element] for b in found])
    keep = []
    for b, c, i, x, h in zip(found, content, inside, named, head, strict=True):
        e = elements[b.element]
        if i and not x and not h and (c or e.article or e.tag in HEADINGS or b.linked <= 0.6 * len(b.text)):
            keep.append(b.text)
    return "\n".join(keep)


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of ``pages``: key, ``carry``, text, n_chars (code points).

    Null and empty pages, and pages without an article, give an empty text. Pages of any length are read whole; repeated rows
    give repeated results; other columns are not read.
    """
    names = [key, *carry]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(len(names)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(pages.select(*names, html), run, schema + ", text string, n_chars long")
