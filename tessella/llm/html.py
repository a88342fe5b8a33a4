"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass 1 judges each block alone by length, link density and the share of stop words:
long blocks with enough stop words are good, lists of links and long blocks without are bad, short ones and headings stay open; what
stands in menus, notices and the like, by its elements or by names that mean nothing else, is bad; a name that may mean something
else raises the limits. Pass 2 lets open blocks inherit from the nearest decided neighbours.

An article element is a prior: if its text as a whole has stop words and makes up enough of the page's good text, limits are lower
within it and higher outside; one that holds little, such as a teaser, is a block like others. Listings and pages in languages
without a list of stop words, which have next to none of them, are judged by length and links alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of HTML, and frequent function words of English, German, French and Spanish.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can do for from had has have he her his i if in into is it its more no not of on one or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du ein eine einem einen einer eines er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wer wie wir wird zu zum zur über "
    "au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui mais ne nos nous on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vos vous à été être "
    "al como con de del desde el ella en entre era es esta este fue ha hay la las le lo los más mi muy no nos o para pero por que se ser si sin sobre su sus también un una y ya".split()
)
#: Words of class and id names that mark what is not the main text, and words that stand beside them without saying more.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget related recommended "
    "share sharing social comment comments respond disqus footer foot masthead topbar toolbar pagination pager tag tags copyright legal skip".split()
)
NEUTRAL = frozenset(
    "site page post posts entry article main content global primary secondary box wrap wrapper container holder list lists item items block blocks section area zone slot unit bar top bottom left right inner outer upper lower header head title text link links button buttons btn icon icons group row col column "
    "panel fixed sticky mobile desktop small large big js ui wp id form info meta to".split()
)
#: A comment, a declaration or a tag. A quoted value that holds a < and ends in = has lost its closing quote; such a tag ends at its first >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)"
    r"(?:(?P<attrs>(?:\"[^\"<]*\"|\"[^\"<]*<[^\"]*(?<!=)\"|'[^'<]*'|'[^'<]*<[^']*(?<!=)'|[^\"'>])*+)(?:>|\Z)|(?P<broken>[^>]*)(?:>|\Z))",
    re.S,
)
#: Open elements that a start tag ends (fixed values of HTML); each block-level one also ends an open p.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Attributes with their values, what may hide an element, and styles that do.
ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = re.compile(r"hidden|display", re.I)
UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Such names in two words.
HEADERS = re.compile(r"(?:^|[-_\s])(?:site|page)[-_]header(?:$|[-_\s\d])", re.I)
#: Names that only say what the page also has.
BESIDE = re.compile(r"(?:has|with|no|without)-[\w-]+", re.I)
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alert)$", re.I)
GOOD, BAD, OPEN = "good", "bad", "open"


def marks(names: str) -> tuple[bool, bool]:
    """(marked, in doubt) by a class or id attribute: marked if a name of it consists of marks and neutral words, such as cookie-notice or site-footer; in doubt if one has a mark
    beside a word that may say something else, such as tag-news or market-share."""
    doubt = False
    if HEADERS.search(names):
        return True, False
    for name in BESIDE.sub("", names).lower().split():
        words = [w.strip("0123456789") for w in re.split(r"[-_]+", name)]
        if not MARKS.isdisjoint(words):
            if all(not w or w in MARKS or w in NEUTRAL for w in words):
                return True, False
            doubt = True
    return False, doubt


def is_hidden(attrs: str) -> bool:
    """Whether a tag's attributes hide its element: hidden, aria-hidden=true or a style; class names never do."""
    if not HIDING.search(attrs):
        return False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(ATTRIBUTES.finditer(attrs)))}  # the first of a name counts
    return "hidden" in values and values["hidden"].lower() != "until-found" or values.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(values.get("style", "")))


@dataclass
class Rules:
    """Characters below which a block is short and from which it is long; densities of words and of links."""

    short: int = 70
    long: int = 200
    stop_words: float = 0.2
    few_stop_words: float = 0.1
    links: float = 0.4
    prior: float = 0.5  # what the limits of length and stop words are multiplied by within an article
    outside: float = 0.3  # stop words that a long block outside the article needs
    share: float = 0.3  # of the page's good text, that an article holds which moves the limits
    unknown: float = 0.02  # of all words, below which the language has no list of stop words
    doubt: float = 2.0  # what the limit of a short block is multiplied by where a name raises a doubt; stop words must be as many as outside an article


@dataclass
class Block:
    text: str
    linked: float  # share of its characters within links
    words: int
    stops: float  # share of its words that are stop words
    marked: bool  # stands in a menu, notice, advert and so on
    doubt: bool  # stands in an element whose name may mean that, or not
    article: bool  # stands in the marked article
    heading: bool


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, marked, in doubt, article here
    opened: Counter[str] = Counter()  # how many of each name are open
    marked = doubt = article = anchors = 0
    heading = ""

    def close() -> str:
        nonlocal marked, doubt, article, anchors
        name, was_marked, was_doubt, was_article = stack.pop()
        opened[name] -= 1
        marked, doubt, article, anchors = marked - was_marked, doubt - was_doubt, article - was_article, anchors - (name == "a")
        return name

    def end_open(names: tuple[str, ...]) -> None:
        """Closes the innermost block-level element, and what is open within it, if it is one of names."""
        k = len(stack) - 1
        while k >= 0 and stack[k][0] not in BLOCKS:
            k -= 1
        if k >= 0 and stack[k][0] in names:
            while len(stack) > k:
                close()

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            words = re.findall(r"[^\W\d_]+", text.lower())
            out.append(Block(text, min(1.0, linked / len(text)), len(words), sum(w in STOP_WORDS for w in words) / max(1, len(words)), marked > 0, doubt > 0, article > 0, bool(heading)))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if anchors:
                linked += len("".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name, attrs = (m["name"] or "").lower(), m["attrs"] or m["broken"] or ""
        if not name:
            continue
        if m["close"]:
            if name in BLOCKS:
                end_block()
            if name == heading:
                heading = ""
            while opened[name] and close() != name:
                pass
            continue
        if name in SKIPPED:
            if attrs.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "head" and not end:
                end = re.compile(r"<body\b", re.I).search(page, at)
                at = end.start() if end else at
                continue
            at = end.end() if end else n
            continue
        if name in BLOCKS:
            end_block()
            end_open(("p",))
            for _ in ENDS.get(name, ()):
                end_open(ENDS[name])
            if name in ("p", "ul", "ol", "table"):
                heading = ""
        elif name in ("br", "wbr", "img"):
            parts.append("" if name == "wbr" else " ")
        if name in VOID or attrs.endswith("/"):
            continue
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = name
        names = [next(filter(None, x), "") for x in NAMES.findall(attrs)] if attrs else []
        found = [marks(x) for x in names] if name not in ("html", "body", "article", "main") else []
        here = name in BOILERPLATE_TAGS and not (name == "header" and article) or any(m for m, _ in found) or bool(found) and any(ROLES.match(x) for x in names) or bool(attrs) and name not in ("html", "body") and is_hidden(attrs)
        unsure = not here and any(d for _, d in found)
        main = name in ("article", "main")
        if name in ("article", "main") and any(re.search(r"(?:^|[-_\s])comments?(?:$|[-_\s\d])", x, re.I) for x in names):
            here, main = True, False
        if name == "a" or here or unsure or main or name in BLOCKS:
            stack.append((name, here, unsure, main))
            opened[name] += 1
            marked, doubt, article, anchors = marked + here, doubt + unsure, article + main, anchors + (name == "a")
    end_block()
    return out


def judge(blocks: list[Block], rules: Rules) -> list[str]:
    """GOOD or BAD for each block."""
    plain = [b for b in blocks if not (b.marked or b.linked > rules.links)]
    stops = lambda found: sum(b.stops * b.words for b in found) / max(1, sum(b.words for b in found))
    need = 0.0 if stops(plain) < rules.unknown else rules.stop_words
    inside = [b for b in plain if b.article]
    within = sum(len(b.text) for b in inside)
    outside = sum(len(b.text) for b in plain if not (b.article or b.heading) and len(b.text) >= rules.short and b.stops >= need)
    prose = stops(inside) >= rules.few_stop_words  # else a listing, or a language without a list: length and links decide, if no other text is good
    need_inside = need * rules.prior if prose else 0.0
    has_article = within > 0 and within >= rules.share * (within + outside) and (stops(inside) >= need_inside if prose else not outside)

    def alone(b: Block) -> str:
        if b.marked or b.linked > rules.links:
            return BAD
        if has_article and not b.article:
            return GOOD if len(b.text) >= rules.long and b.stops >= (rules.outside if need else 0.0) and not b.heading else BAD
        if len(b.text) < rules.short * (rules.doubt if b.doubt else rules.prior if has_article else 1.0) or b.heading:
            return OPEN
        if b.doubt:
            return GOOD if b.stops >= (rules.outside if need else 0.0) else BAD
        if b.stops >= (need_inside if has_article else need):
            return GOOD
        return BAD if b.stops < rules.few_stop_words and not has_article else OPEN

    first = [alone(b) for b in blocks]
    decided = [x != OPEN and not b.marked and (b.article or not has_article) for x, b in zip(first, blocks, strict=True)]
    edge = GOOD if has_article else BAD  # what lies beyond the first and last decided block

    def nearest(order: list[int]) -> dict[int, tuple[str, int]]:
        """Of each block in turn: the last decided label before it, and how many blocks ago."""
        found, label, since = {}, edge, len(blocks)
        for k in order:
            since += 1
            found[k] = label, since
            if decided[k]:
                label, since = first[k], 0
        return found

    before, after = nearest(list(range(len(blocks)))), nearest(list(range(len(blocks)))[::-1])

    def inherited(k: int) -> str:
        (a, da), (b, db) = before[k], after[k]
        if a == b or blocks[k].heading:
            return b  # a heading belongs to what follows
        return a if da < db else b if db < da else edge

    return [inherited(k) if x == OPEN else x for k, x in enumerate(first)]


def main_text(page: str | None, rules: Rules | None = None) -> str:
    found = blocks_of(page or "")
    return "\n".join(b.text for b, verdict in zip(found, judge(found, rules or Rules()), strict=True) if verdict == GOOD)


def extract(html_col: Column, rules: Rules | None = None) -> Column:
    """The main text of a page; null and empty pages give the empty text."""

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p, rules) for p in batch], dtype=object)

    return run(html_col)


def extract_pages(pages: DataFrame, html_col: str = "html", rules: Rules | None = None) -> DataFrame:
    """pages with text and n_chars (its code points). Rows are neither dropped nor merged; a null page has the empty text; a cut-off
    page is read to its end. Columns of pages with these names are replaced. No shuffle: scan -> Arrow -> project."""
    return pages.withColumn("text", extract(F.col(html_col).cast("string"), rules)).withColumn("n_chars", F.length("text").cast("long"))
