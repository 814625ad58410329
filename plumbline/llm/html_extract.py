"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each with its root-to-leaf path of block tags. For every path the text
length, punctuation, words inside links and number of nodes are summed. Two ratios, text per node
and punctuation per node, are smoothed along the page, fused by their product, and paths above a threshold
relative to the page are content. Headings and short blocks with few links next to content paths, under the same container (in a
named article: under any container between it and the path), go with them, so that an article keeps its title and its one-line paragraphs.

Where the page names its articles, only paths inside them compete. Elements that are furniture by name (scripts, menus, footers) never
count. Forms and elements whose class, id or role has a token made of furniture words (adverts, comments; articles too) do not count
either, unless they hold the largest article or more than half of the page's unlinked text. A furniture word among others, or one that may
be a section's subject, only lowers a path's ratio, and only outside articles.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
FURNITURE = frozenset("""head script style noscript template iframe object embed svg canvas math audio video nav menu footer aside form button select option
    textarea input fieldset dialog noembed noframes applet map""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an open element of the second set ends when the tag opens; the search stops at the third
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
# fixed values: words of class, id and role that mark furniture or the article
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion sidebar sidebars
    menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert
    alerts popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended comment
    comments commentlist reply replies respond disqus discussion form search widget widgets pagination pager copyright legal disclaimer
    hidden skip complementary contentinfo""".split())
ARTICLE_WORDS = frozenset("article main content story post entry".split())
# furniture words that may be a section's subject, and words that leave a token's meaning as it is
SUBJECTS = frozenset("""alert alerts banner banners consent copyright disclaimer discussion form legal login navigation notice notices overlay promotion register related
    reply replies search share sharing skip social subscription""".split())
PLACES = frozenset("site page global top bottom left right wrapper wrap container section area box list block bar links inner outer button buttons".split())
# elements that give text its form; a block below them is as near to a container as they are
FORMS = HEADINGS | frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote figure figcaption pre p header hgroup section address details summary".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡\"'()«»„“”–—]")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")
THRESHOLD, SIGMA = 0.1, 1.0
WEAK, SHORT, LINKED = 0.3, 200, 0.3  # weight of a path with a furniture word; characters of a short block; share of links in one with few


@dataclass
class Element:
    tag: str
    furniture: bool
    article: bool
    block: bool
    path: str
    root: int = 0
    top: str = ""
    named: tuple[int, ...] = ()
    weak: tuple[int, ...] = ()


@dataclass
class Block:
    """One block of text: pieces, path, number and path of its outermost article (0: none), whether it is furniture by name, and the
    numbers of the open elements that furniture words name or only weigh on."""
    path: str
    root: int
    furniture: bool
    top: str = ""
    named: tuple[int, ...] = ()
    weak: tuple[int, ...] = ()
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


def marks(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool, bool, str]:
    """Whether an element is furniture by name, is the article, is named furniture by a token, has a furniture word, and its first class for the path."""
    tokens, label, hidden = [], "", False
    if attributes.strip():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
            elif name in ("class", "id", "role"):
                tokens += [set(WORDS.findall(x)) for x in value.split()]
                label = label or value.split(" ")[0].replace("/", "_")
    said = set().union(*tokens)
    furniture = hidden or tag in FURNITURE - {"form"} or (tag == "header" and not inside_article)
    named, weak, article = tag == "form", False, tag in ("article", "main")
    if tag not in ("html", "body") and tag not in HEADINGS:
        for words in tokens:
            bad = words & FURNITURE_WORDS
            if said & ARTICLE_WORDS:  # an article's own header holds its title
                bad -= {"header"}
            weak = weak or bool(bad)
            named = named or (bool(bad - SUBJECTS) and words <= FURNITURE_WORDS | ARTICLE_WORDS | PLACES)
            article = article or (tag in ("div", "section", "td") and bool(words & ARTICLE_WORDS) and not bad)
    return furniture, article and not furniture and not (named and tag not in ("article", "main")), named, weak, label


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, furniture included and marked."""
    stack = [Element("", False, False, True, "")]
    out: list[Block] = []
    now: Block | None = None
    articles = elements = 0
    i, n = 0, len(page)
    while i < n:
        m = TOKEN.match(page, i)
        i = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[:2] in ("<!", "<?"):
                if not text.startswith("<![CDATA["):
                    continue
                text = html.escape(text[9:].removesuffix("]]>"))
            top = stack[-1]
            if now is None:
                home = next(e for e in reversed(stack) if e.block)
                now = Block(home.path, home.root, any(e.furniture for e in stack), home.top, top.named, top.weak)
                out.append(now)
            elif top.furniture and not now.furniture:  # furniture inside a paragraph, such as a button
                continue
            into = now
            if len(top.named) > len(now.named):  # a block of its own, as its mark may not stand
                into = Block(now.path, now.root, now.furniture, now.top, top.named, top.weak)
                out.append(into)
            into.pieces.append(text)
            if any(e.tag == "a" for e in stack):
                into.linked += len(text)
            continue
        tag = tag.lower()
        if m[1]:  # an end tag closes its element and what is open in it; a stray one does nothing
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if at and not (not stack[at].block and any(e.block for e in stack[at + 1:])):
                if any(e.block for e in stack[at:]):
                    now = None
                del stack[at:]
            elif tag == "br" and now is not None:
                now.pieces.append(" ")
            continue
        block = tag in BLOCK
        if block:
            now = None
            if tag not in ("td", "th", "html", "head"):  # a block ends an open paragraph and the inline elements in it
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0)
                if at and not any(e.block for e in stack[at + 1:]):
                    del stack[at:]
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
        if tag in ENDED_BY:
            ends, stop = ENDED_BY[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in VOID:
            if tag in ("br", "wbr", "hr") and now is not None and tag != "wbr":
                now.pieces.append(" ")
            continue
        root, top = stack[-1].root, stack[-1].top
        furniture, article, named, weak, label = marks(tag, m[3], root > 0)
        elements += 1
        home = next(e for e in reversed(stack) if e.block)
        path = f"{home.path}/{tag}{'.' + label if label else ''}" if block else home.path
        if article and not root:
            articles += 1
            root, top = articles, path
        if m[4] and tag in ("svg", "math"):
            continue
        if tag in RAW:  # its content is no markup
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, i)
            i = close.end() if close else n
            continue
        mine = (elements,)
        stack.append(Element(tag, furniture, article, block, path, root, top, stack[-1].named + mine * named, stack[-1].weak + mine * weak))
    return [b for b in out if b.pieces]


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing over neighbours, renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        span = [(kernel[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in span) / sum(w for w, _ in span))
    return out


def unlinked(block: Block, text: str) -> int:
    return max(0, len(text) - block.linked)


def standing(found: list[tuple[Block, str]]) -> set[int]:
    """The elements with furniture words that hold neither the largest article nor more than half of the unlinked text."""
    roots: dict[int, list[int]] = {}
    held: dict[int, int] = {}
    over: dict[int, set[int]] = {}
    for block, text in found:
        size = unlinked(block, text)
        for e in {*block.named, *block.weak}:
            held[e] = held.get(e, 0) + size
        if block.root:
            roots.setdefault(block.root, [0, 0])[1] += size
            roots[block.root][0] += size * (not block.named)
            mine = {*block.named, *block.weak}
            over[block.root] = over[block.root] & mine if block.root in over else mine
    largest = max(roots, key=lambda r: roots[r], default=0)
    most = sum(unlinked(*x) for x in found) / 2
    return {e for e, n in held.items() if n <= most and e not in over.get(largest, ())}


def content_paths(found: list[tuple[Block, str]], threshold: float, sigma: float, marked: set[int] = frozenset()) -> set[str]:
    """Paths whose fused ratio reaches ``threshold`` of the page's highest; ``marked`` elements outside articles lower it."""
    sums: dict[str, list[float]] = {}
    for block, text in found:
        s = sums.setdefault(block.path, [0, 0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += min(len(text), block.linked)
        s[3] += 1
        s[4] += len(text) * (WEAK if not block.root and marked.intersection(block.weak) else 1)
    order = list(sums)
    free = [1 - sums[p][2] / max(1, sums[p][0]) for p in order]
    length = smoothed([f * sums[p][0] / sums[p][3] for p, f in zip(order, free)], sigma)
    points = smoothed([f * (1 + sums[p][1]) / sums[p][3] for p, f in zip(order, free)], sigma)
    # smoothing carries content to its neighbours; a path's own share of unlinked text still decides
    fused = {p: a * b * f * math.log1p(sums[p][0]) * sums[p][4] / max(1, sums[p][0]) for p, a, b, f in zip(order, length, points, free)}
    most = max(fused.values(), default=0.0)
    return {p for p, v in fused.items() if v > 0 and v >= threshold * most}


def extract(page: str | None, threshold: float = THRESHOLD, sigma: float = SIGMA) -> str:
    """Main text: blocks in page order joined by a line end; null, empty and furniture-only pages give ''."""
    if not page:
        return ""
    found = [(b, b.text()) for b in blocks(page)]
    found = [(b, t) for b, t in found if t and not b.furniture]
    marked = standing(found) if any(b.named or b.weak for b, _ in found) else set()
    found = [(b, t) for b, t in found if not marked.intersection(b.named)]
    inside = [(b, t) for b, t in found if b.root]
    found = inside or found
    chosen = content_paths(found, threshold, sigma, marked)
    if inside and not chosen:  # an article that is all links
        return "\n".join(t for _, t in found)
    homes: set[tuple[int, str]] = set()
    for b, _ in found:
        if b.path in chosen:
            home = b.path.rpartition("/")[0]
            homes.add((b.root, home))
            while b.root and len(home) > len(b.top):
                home = home.rpartition("/")[0]
                homes.add((b.root, home))
    texts = [len(t) for b, t in found if b.path in chosen]
    short = max(SHORT, sum(texts) / max(1, len(texts)))

    def beside(b: Block, text: str) -> bool:
        parts = b.path.split("/")
        tags = [x.partition(".")[0] for x in parts]
        if unlinked(b, text) < (1 - LINKED) * len(text) or (len(text) > short and tags[-1] not in HEADINGS):
            return False
        for k in range(len(parts) - 1, -1, -1):
            if k < len(parts) - 1 and tags[k] not in FORMS:
                return False
            if (b.root, "/".join(parts[:k])) in homes:
                return True
        return False

    return "\n".join(t for b, t in found if b.path in chosen or beside(b, t))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  threshold: float = THRESHOLD, sigma: float = SIGMA) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page from its whole html; other columns are left out, repeated rows stay."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [extract(h, threshold, sigma) for h in rows["html"]]
            yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema[id_col].dataType.simpleString()
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
            .mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long"))
