"""Main text of web pages by consensus of their hosts.

Every page's containers are scored by the prose that they hold. A page votes for the
generalised paths (tags and classes from the body down, digits as `#`) of its best ones; votes
are added up per host, and each page is read again with its host's winning paths. A page whose
own score misleads, such as one with more remarks than article, follows its host. Pages are
scanned twice and never shuffled while the winners are few; a page's markup meets nothing but
the paths of its host.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import checkpointed, table
from ledgerloom.llm.urls import with_parts

# Names of HTML.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
_LEFT_OUT = frozenset("head nav footer aside form button select dialog menu noscript iframe object svg math canvas audio video template map datalist applet".split())
_LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_PASSED_THROUGH = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd ul ol dl blockquote figure figcaption caption address hgroup".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ARTICLES = frozenset(("article", "main"))
#: Open elements that a start tag ends, up to the elements that hold them.
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("td", "th", "tr")), frozenset(("table",))),
}
#: Words of classes and ids of what isn't the article.
_SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion banner sidebar rail menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer comment comments commentlist disqus reply replies respond discussion notice notices notification cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations teaser widget widgets toolbar pagination pager skip search copyright disclaimer alert".split()
)
#: Words before those that make them tell of a layout, not of what the element is.
_LAYOUT_WORDS = frozenset(("with", "has", "no", "without"))

#: A raw element to its end tag, a comment or declaration, or a tag; what no end is found for goes to the end of the text.
_MARKUP = re.compile(
    r"""<(script|style|textarea|title|xmp|noembed|noframes)(?=[\s/>])[^>]*>(?>.*?</\1(?=[\s/>])[^>]*>?|.*)|<!--(?>.*?-->|.*)|<[!?](?>[^>]*>?)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>|[^>]*\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|([^\s=/>"']+)""")
_WORD = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
#: What a container passes on to the one around it, in tenths, and how much more an article element counts.
_PASSED_ON, _ARTICLE_WEIGHT = 6, 2
#: A container votes if its score is at least half that of its page's best.
_VOTES = 1000
#: Share of a host's pages that a path must win, in percent.
LEAST_VOTES_PCT = 10
#: Winning paths that are sent to every executor, in bytes; beyond, they are joined by host.
BROADCAST_BYTES = 32 << 20
#: Parts that pages and paths of a host are dealt to where they are joined.
_SALTS = 64
_ROWS_OUT = 256


@dataclass(slots=True)
class Element:
    """An element that holds blocks: where it stands, and why it may be left out."""

    parent: int
    tag: str
    classes: str
    out: bool
    side: bool
    headings_only: bool
    chars: int = 0
    score: int = 0
    has_article: bool = False


@dataclass(slots=True)
class Page:
    """Elements in page order and (element, text, characters of links) of each block."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


@lru_cache(maxsize=4096)
def _is_side(names: str) -> bool:
    """Whether a class or id names something beside the article."""
    words = [w.lower() for w in _WORD.findall(names)]
    return any(w in _SIDE_WORDS and (i == 0 or words[i - 1] not in _LAYOUT_WORDS) for i, w in enumerate(words))


@lru_cache(maxsize=4096)
def _general(classes: str) -> str:
    """Classes without what differs from page to page: runs of digits are one sign, order doesn't count."""
    return ".".join(sorted({re.sub(r"[0-9]+", "#", c) for c in classes.split()}))


@lru_cache(maxsize=4096)
def _attributes(rest: str) -> tuple[str, bool, bool]:
    """Classes, whether a role or a hidden mark leaves the element out, and whether a class or the id names a side."""
    found: dict[str, str] = {}
    for name, double, single, bare, alone in _ATTRIBUTE.findall(rest.rstrip(">")):
        found.setdefault((name or alone).lower(), html.unescape(double or single or bare))
    style = found.get("style", "").replace(" ", "").lower()
    out = found.get("role", "").lower() in _LEFT_OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
    classes = found.get("class", "")
    return classes, out, _is_side(classes) or _is_side(found.get("id", ""))


def parsed(markup: str) -> Page:
    """Elements and blocks of a page's markup, however broken it is.

    Comments, declarations, scripts and styles hold no text. Tags that aren't closed end with
    what holds them, end tags without a start are passed over, and a tag that the markup breaks
    off in is dropped. Inline tags don't part blocks; a line break is white space.
    """
    page = Page([Element(-1, "body", "", False, False, False)])
    elements, blocks = page.elements, page.blocks
    stack, opened = [0], defaultdict(int)
    pieces: list[str] = []
    link_chars, link_from = 0, -1
    at = 0

    def flush() -> None:
        nonlocal link_chars, link_from
        if pieces and not elements[stack[-1]].out:
            text = " ".join(html.unescape("".join(pieces)).split())
            if link_from >= 0:
                link_chars += sum(map(len, pieces[link_from:]))
            if text:
                blocks.append((stack[-1], text, min(link_chars, len(text))))
        pieces.clear()
        link_chars, link_from = 0, 0 if link_from >= 0 else -1

    def close(to: int) -> None:
        for e in stack[to:]:
            opened[elements[e].tag] -= 1
        del stack[to:]

    for m in _MARKUP.finditer(markup):
        start, end = m.span()
        if start > at:
            pieces.append(markup[at:start])
        at = end
        _, ends, name, rest = m.groups()
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                if link_from >= 0:
                    link_chars += sum(map(len, pieces[link_from:]))
                link_from = -1 if ends else len(pieces)
        elif name in _VOID:
            if name == "br":
                pieces.append("\n")
            elif name == "hr":
                flush()
        elif ends:
            flush()
            link_from = -1
            if opened[name]:
                place = len(stack) - 1
                while elements[stack[place]].tag != name:
                    place -= 1
                close(place)
        elif name in ("html", "body"):
            flush()
        else:
            flush()
            top = elements[stack[-1]].tag
            if top == "p" or (top in _HEADINGS and name in _HEADINGS and top != "hgroup"):
                close(len(stack) - 1)
            elif name in _ENDS:
                ended, holders = _ENDS[name]
                place, lowest = len(stack) - 1 if any(opened[t] for t in ended) else 0, 0
                while place > 0 and elements[stack[place]].tag not in holders:
                    lowest = place if elements[stack[place]].tag in ended else lowest
                    place -= 1
                if lowest:
                    close(lowest)
            classes, out, side = _attributes(rest) if len(rest) > 1 else ("", False, False)
            parent = elements[stack[-1]]
            in_article = opened["article"] + opened["main"] > 0
            out = out or parent.out or name in _LEFT_OUT or (name == "header" and not in_article)
            elements.append(Element(stack[-1], name, classes, out, side and name != "main", parent.headings_only or (name == "header" and in_article)))
            stack.append(len(elements) - 1)
            opened[name] += 1
    pieces.append(markup[at:])
    flush()
    return page


def judged(page: Page) -> Page:
    """Marks the elements that are left out, and gives containers their scores.

    What a class or id calls a side is left out, unless it holds an article and most of the text.
    A list of short links is a menu. A block counts its characters outside of links for the
    container that it stands in; the ones around that get six tenths from level to level.
    """
    elements = page.elements
    own_chars, lists = [0] * len(elements), {}
    for e, text, links in page.blocks:
        own_chars[e] += len(text)
        holder = e
        while holder > 0 and elements[holder].tag in ("li", "p"):
            holder = elements[holder].parent
        if elements[holder].tag in ("ul", "ol"):
            n, short, chars = lists.get(holder, (0, True, 0))
            lists[holder] = n + 1, short and links >= 0.9 * len(text), chars + len(text)
    for holder, (n, short, chars) in lists.items():
        elements[holder].out |= n >= 3 and short and chars < 40 * n
    for i in range(len(elements) - 1, 0, -1):
        e, parent = elements[i], elements[elements[i].parent]
        e.chars += own_chars[i]
        parent.chars += 0 if e.out else e.chars
        parent.has_article |= e.has_article or (e.tag in _ARTICLES and not e.side and not e.out)
    total = elements[0].chars + own_chars[0]
    for e in elements[1:]:
        e.out |= elements[e.parent].out or (e.side and not (e.has_article and 2 * e.chars > total))
    for e, text, links in page.blocks:
        if not elements[e].out and not (elements[e].headings_only and elements[e].tag not in _HEADINGS):
            elements[e].score += len(text) - links
    for i in range(len(elements) - 1, 0, -1):
        e, parent = elements[i], elements[elements[i].parent]
        if e.out:
            e.score = 0
        elif e.tag in _PASSED_THROUGH:
            parent.score += e.score
            e.score = 0
        else:
            parent.score += e.score * _PASSED_ON // 10
            e.score *= _ARTICLE_WEIGHT if e.tag in _ARTICLES else 1
    return page


def path_of(page: Page, place: int) -> str:
    """Generalised path of an element, from below the body."""
    names = []
    while place > 0:
        e = page.elements[place]
        names.append(f"{e.tag}.{own}" if (own := _general(e.classes)) else e.tag)
        place = e.parent
    return ">".join(reversed(names))


def candidates(page: Page) -> list[tuple[int, int]]:
    """(element, votes) of the containers of at least half the best score: best first, outer before inner."""
    most = max(e.score for e in page.elements)
    if most == 0:
        return []
    found = [(i, e.score * _VOTES // most) for i, e in enumerate(page.elements) if 2 * e.score >= most]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def text_of(page: Page, containers: set[int]) -> str:
    """Blocks within the containers, without what is left out."""
    elements, inside = page.elements, [False] * len(page.elements)
    for i, e in enumerate(elements):
        inside[i] = i in containers or (i > 0 and inside[e.parent])
    return "\n\n".join(text for e, text, _ in page.blocks if inside[e] and not elements[e].out and not (elements[e].headings_only and elements[e].tag not in _HEADINGS))


def main_text(markup: str, winners: list[str]) -> str:
    """Text of the first winning path that the page has text at, else of the path of its own best container."""
    page = judged(parsed(markup))
    best = candidates(page)
    if not best:
        return ""
    winners = [*winners, path_of(page, best[0][0])]
    depths = {w.count(">") + 1 if w else 0 for w in winners}
    by_path: dict[str, set[int]] = {}
    depth = [0] * len(page.elements)
    for i, e in enumerate(page.elements):
        depth[i] = depth[e.parent] + 1 if i else 0
        if e.score and depth[i] in depths:
            by_path.setdefault(path_of(page, i), set()).add(i)
    return text_of(page, next(by_path[w] for w in winners if w in by_path))


def path_votes(pages: DataFrame) -> DataFrame:
    """host, path, votes (thousandths of a page): each page's votes for the paths of its best containers."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter[tuple[str, str]] = Counter()
            for host, markup in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                page = judged(parsed(markup))
                own: dict[str, int] = {}
                for place, n in candidates(page):
                    own.setdefault(path_of(page, place), n)
                votes.update({(host, path): n for path, n in own.items()})
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in votes], pa.string()) for i in (0, 1)] + [pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])

    hosted = pages.select("host", "html").where("host <> '' and html <> ''")
    return hosted.mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(votes: DataFrame, pages: DataFrame) -> DataFrame:
    """host, winners: a host's paths with the votes of a tenth of its pages, most votes first, ties by path."""
    sizes = pages.where("host <> '' and html <> ''").groupBy("host").agg(F.count("*").alias("n_pages"))
    won = votes.join(sizes, "host").where(F.col("votes") * 100 >= F.col("n_pages") * (_VOTES * LEAST_VOTES_PCT))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path")))  # a few: each has a tenth of the pages
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("winners"))


def extract_main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html); other columns are ignored.

    Blocks of the main text are joined in page order by an empty line; character references are
    decoded and white space in a block is one space. Left out are menus, headers, footers, sides,
    notices, adverts, forms, scripts, styles and comments; of a header inside an article its
    headings stay. Null or empty markup, or one without text, gives the empty text. Pages without
    a host (null url, or none in it) are read by their own scores. Repeated rows are answered each
    for itself and vote each; an empty table gives no rows; markup is read whole.
    """
    hosted = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))).select("page_id", "url", "host", "html")
    winners = checkpointed(winning_paths(path_votes(hosted), hosted))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_OUT):
                batch = whole.slice(at, _ROWS_OUT)
                texts = [main_text(markup, winning or []) for markup, winning in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = winners.agg(F.sum(F.octet_length("host") + F.aggregate("winners", F.lit(0), lambda n, p: n + F.octet_length(p)) + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = hosted.join(F.broadcast(winners), "host", "left")
    else:
        dealt = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(_SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "winners").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of `pages`."""
    return extract_main_text(table(spark, sf_dir, "pages"))
