"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores positive, by the kind of block it stands in; a tag
scores negative, by its name and by the words of its class, id and role; what a page marks as chrome
(menus, adverts, forms, comments) scores nothing, unless it holds the body (``settled``, ``without_wrappers``).
One scan finds the contiguous run with the largest sum; its blocks are the text. The weights come from
labelled pages: those with one article element, where every word and tag is known to be inside or outside.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text.
RAW = frozenset("canvas head iframe noscript object script style svg template textarea title".split())
#: Elements, and words of class, id and role, that name the parts around an article.
CHROME_TAGS = frozenset("aside button dialog fieldset footer form header label legend menu nav option select".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget widgets"
    " anzeige fusszeile hinweis hinweise kommentar kommentare kommentarbereich kopfzeile seitenleiste werbung"
    " anuncio anuncios aviso avisos barra cabecera comentario comentarios formulario publicidad"
    " annonce annonces avis barre commentaire commentaires entete formulaire publicite".split()
)
#: Parts of a name that say where or what kind of box an element is: ``site-header`` is a header, ``share-price``
#: is about something else than sharing.
BOX_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content count desktop div fixed float global group head holder icon icons inline inner item items js label layout left link links list main mobile module my nav outer page pages panel post posts primary region right row secondary section single site slot small sticky stories tablet text title top topic topics unit wrap wrapper".split()
)
#: Parts of a name that tell a state of the page (``no-sidebar``, ``comments-open``), not what the element is.
STATE_WORDS = frozenset("closed disabled enabled has is no not open opened with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text: a label or button in them is a part of what they say.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
#: A page whose best run is worth this many times more without the names is wrapped in a named element.
WRAPPED = 4.0
#: A quote begins a value only behind a name and ``=``; elsewhere it is a character like others.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?|[^>])*+)>""")
#: From two characters into ``<!--``: ``<!-->`` and ``<!--->`` are whole comments.
COMMENT_END = re.compile("--!?>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+")
#: Where the content of an element ends that isn't text; a head also ends where the body begins.
ENDS = {name: re.compile("</head|<body" if name == "head" else "</" + name, re.IGNORECASE | re.ASCII) for name in RAW}
#: What a tag costs at most inside an article or main element, and elsewhere.
INSIDE_COST, MOST_COST = 0.05, 8.0
CLOSES_P = BLOCKS - {"body", "caption", "html", "option", "title"}


@dataclass(slots=True)
class Unit:
    """One word run or tag in page order. ``block`` numbers the blocks of the page; ``kind`` is the
    innermost block element of a text, or the features of a tag. ``within`` is the innermost named element
    around it, ``own`` the named element that a tag opens or closes (-1: none)."""

    is_tag: bool
    block: int
    kind: tuple[str, ...]
    text: str
    within: int
    in_article: bool
    own: int = -1


@dataclass(slots=True)
class Named:
    """An element that is chrome by its name, and the named element around it (-1: none). Outer elements
    come first in a page's list."""

    kind: tuple[str, ...]
    parent: int


@dataclass(slots=True)
class Body:
    """A main or article element: the named element that it is or is in, and its words."""

    is_main: bool
    within: int
    words: int = 0


def features(name: str, rest: str) -> tuple[str, ...]:
    """``<name`` and the words of its class, id and role."""
    found = set()
    for m in NAMED.finditer(rest) if rest else ():
        for one in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(NAME_WORD.findall(one))
            names = words.isdisjoint(STATE_WORDS) and words <= CHROME_WORDS | BOX_WORDS
            found |= words if names else words - CHROME_WORDS
    return (name, *sorted("." + w for w in found))


def is_chrome(kind: tuple[str, ...]) -> bool:
    return kind[0] in CHROME_TAGS or any(w[1:] in CHROME_WORDS for w in kind[1:])


def parsed(page: str) -> tuple[list[Unit], list[Named], list[Body]]:
    """Words and tags in page order; comments, scripts, styles and the head are left out. Elements that
    aren't closed end with their parent, an open paragraph at the next block. A header, by tag or name, is
    no chrome in a main or article element, and a heading named so nowhere."""
    at, block = 0, 0
    seen: list[Unit] = []
    named: list[Named] = []
    bodies: list[Body] = []
    # name, named element, in an article, body, own named element, plain, place of the innermost block element
    stack: list[tuple[str, int, bool, int, int, bool, int]] = []
    root = ("", -1, False, -1, -1, False, -1)
    opened = Counter()
    while at < len(page):
        _, within, inside, body, _, _, innermost = stack[-1] if stack else root
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            text = html.unescape(page[at:end])
            name = stack[innermost][0] if innermost >= 0 else ""
            seen.append(Unit(False, block, (name,), text, within, inside))
            if body >= 0:
                bodies[body].words += len(text.split())
            at = end
            continue
        if page.startswith("<!--", at):
            end = COMMENT_END.search(page, at + 2)
            at = end.end() if end else len(page)
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        m = TAG.match(page, at) or LOOSE_TAG.match(page, at)
        if m is None:
            seen.append(Unit(False, block, ("",), "<", within, inside))
            at += 1
            continue
        at, name, own = m.end(), m[2].lower(), -1
        if name in RAW and not m[1]:
            end = ENDS[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name == "br":
            seen.append(Unit(False, block, ("",), " ", within, inside))
            continue
        if m[1]:
            kind = ("/" + name,)
            inside = inside and name != "article"
            if opened[name]:
                while (last := stack.pop())[0] != name:
                    opened[last[0]] -= 1
                opened[name] -= 1
                own, kind = last[4], () if last[5] else kind
        else:
            kind = features(name, m[3])
            if name in CLOSES_P or name == "li":
                if innermost >= 0 and stack[innermost][0] == ("li" if name == "li" else "p"):
                    opened.subtract(e[0] for e in stack[innermost:])
                    del stack[innermost:]
                    _, within, inside, body, _, _, innermost = stack[-1] if stack else root
            if name in HEADINGS or (name != "header" and body >= 0):
                kind = tuple(f for f in kind if f != ".header")
            said = (name in ("button", "label") and innermost >= 0 and stack[innermost][0] in PROSE) or (name in ("fieldset", "legend") and body >= 0)
            plain = (said or (name == "header" and body >= 0)) and not is_chrome(("", *(f for f in kind[1:] if f != ".header")))
            if name == "blockquote" and body >= 0:  # a quotation, however it is named
                kind = tuple(f for f in kind if f[1:] not in CHROME_WORDS)
            kind = () if plain else kind
            if name not in VOID and not m[3].endswith("/"):
                if not plain and name not in ("html", "body") and is_chrome(kind):
                    own = len(named)
                    named.append(Named(kind, within))
                around = own if own >= 0 else within
                if name in ("main", "article"):
                    body = len(bodies)
                    bodies.append(Body(name == "main", around))
                stack.append((name, around, inside or name == "article", body, own, plain, len(stack) if name in BLOCKS else innermost))
                opened[name] += 1
        block += name in BLOCKS
        seen.append(Unit(True, block, kind, "", within, inside, own))
    return seen, named, bodies


def chain(named: list[Named], within: int) -> Iterator[int]:
    """A named element and the named ones around it."""
    while within >= 0:
        yield within
        within = named[within].parent


def hidden(named: list[Named], free: set[int]) -> list[bool]:
    """Of each named element, whether it or one around it is chrome; the last entry is for no element."""
    out = [False] * (len(named) + 1)
    for k, e in enumerate(named):
        out[k] = k not in free or out[e.parent]
    return out


def settled(seen: list[Unit], named: list[Named], bodies: list[Body]) -> set[int]:
    """Named elements that are a main element or hold one; and the articles that the fewest names hide,
    with what is around them, where they have more words than what no name hides."""
    free = {k for b in bodies if b.is_main for k in chain(named, b.within)}
    articles = [b for b in bodies if not b.is_main and b.words]
    if not named or not articles:
        return free
    depth = [0] * (len(named) + 1)  # names that hide an element
    for k, e in enumerate(named):
        depth[k] = depth[e.parent] + (k not in free)
    least = min(depth[b.within] for b in articles)
    if least:
        first = [b for b in articles if depth[b.within] == least]
        hides = hidden(named, free)
        if sum(b.words for b in first) > sum(len(u.text.split()) for u in seen if not u.is_tag and not hides[u.within]):
            around = set()
            for b in first:
                for k in chain(named, b.within):
                    if k in around:
                        break
                    around.add(k)
            free |= around
    return free


@dataclass
class Weights:
    """``words``: block element to the score of a word in it; ``tags``: feature to the cost of a tag."""

    words: dict[str, float]
    tags: dict[str, float]
    word: float = 0.5  # in an element that no labelled page has
    tag: float = 0.3

    def of_tag(self, kind: tuple[str, ...], free: bool = False) -> float:
        """``free``: the tag is of an element that is no chrome despite its name."""
        if free or not kind:
            return -self.tag
        known = [self.tags.get(f, self.tag if f[0] != "." else 0.0) for f in kind]
        return -max(known) - (4.0 if is_chrome(kind) or is_chrome((kind[0].lstrip("/"),)) else 0.0)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, inside, outside) counts of labelled pages; a word's feature has no mark, a tag's ``<``. What
    is chrome by its names scores nothing and so tells nothing about lists or links in articles."""
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column("html").to_pylist():
            seen, named, bodies = parsed(page)
            free = settled(seen, named, bodies)
            hides = hidden(named, free)
            for u in seen:
                if hides[u.within]:
                    continue
                into = inside if u.in_article else outside
                if u.is_tag and u.own in free:
                    continue
                if u.is_tag:
                    into.update("<" + f for f in u.kind)
                elif n := len(u.text.split()):
                    into[u.kind[0]] += n
        names = list(inside | outside)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[f] for f in names], pa.int64()), pa.array([outside[f] for f in names], pa.int64())], names=["feature", "inside", "outside"])


def fit(pages: DataFrame, html_col: str = "html", max_fit_pages: int = 2_000) -> Weights:
    """Weights from at most about ``max_fit_pages`` labelled pages, the same ones each time (by a hash of
    the page). Without labelled pages all elements weigh alike."""
    marked = pages.select(F.col(html_col).alias("html")).where(F.regexp_count("html", F.lit("(?i)<article[ >]")) == 1)
    n = marked.count()
    if n > max_fit_pages:
        marked = marked.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int((1 << 20) * max_fit_pages / n))
    rows = marked.mapInArrow(counted, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    words, tags = {}, {}
    for r in rows:
        odds = math.log((r.inside + 0.5) / (r.outside + 0.5))
        if r.feature.startswith("<"):
            tags[r.feature[1:]] = min(MOST_COST, max(0.01, -odds))
        else:
            words[r.feature] = min(1.0, max(0.1, odds))
    return Weights(words, tags)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, the first and longest of those; (0, 0) if none
    is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best + 1e-9:
            best, where = total, (start, k + 1)
    return where


def scored(seen: list[Unit], named: list[Named], weights: Weights, free: set[int]) -> tuple[list[float], list[bool]]:
    """Scores of the units, and which named elements hide their words."""
    hides, scores = hidden(named, free), []
    for u in seen:
        if u.is_tag:
            cost = -weights.of_tag(u.kind, u.own in free)
            scores.append(-min(cost, INSIDE_COST) if u.in_article and not hides[u.within] else -cost)
        else:
            scores.append(0.0 if hides[u.within] else weights.words.get(u.kind[0], weights.word) * len(u.text.split()))
    return scores, hides


def without_wrappers(seen: list[Unit], named: list[Named], weights: Weights, free: set[int]) -> set[int]:
    """``free`` and, where names hide most of what the weights find, the named elements around it: from the
    outside, in each the one with the most words of the best run that hides nothing, as few as are needed.
    Elements named by words free their like beside them (the results of a search)."""
    scores, _ = scored(seen, named, weights, free)
    start, end = best_run(scores)
    left = sum(scores[start:end])
    for k, u in enumerate(seen):
        if not u.is_tag:
            scores[k] = weights.words.get(u.kind[0], weights.word) * len(u.text.split())
    start, end = best_run(scores)
    goal = sum(scores[start:end])
    if left * WRAPPED >= goal:
        return free
    words = [0] * (len(named) + 1)
    for u in seen[start:end]:
        if not u.is_tag:
            words[u.within] += len(u.text.split())
    for k in range(len(named) - 1, -1, -1):
        words[named[k].parent] += words[k]
    heaviest, like = [-1] * (len(named) + 1), {}
    for k, e in enumerate(named):
        if words[k] and (heaviest[e.parent] < 0 or words[k] > words[heaviest[e.parent]]):
            heaviest[e.parent] = k
        like.setdefault((e.parent, e.kind), []).append(k)
    path, k = [], heaviest[-1]
    while k >= 0:
        path.append(like[named[k].parent, named[k].kind] if is_chrome(("", *named[k].kind[1:])) else [k])
        k = heaviest[k]

    def more(n: int) -> set[int]:
        return free.union(*path[:n])

    def reached(n: int) -> bool:
        found, _ = scored(seen, named, weights, more(n))
        a, b = best_run(found)
        return sum(found[a:b]) * WRAPPED >= goal

    low, high = 0, len(path)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) else (middle + 1, high)
    return more(low)


def main_text(page: str, weights: Weights) -> str:
    """The text of a page: the blocks of the best run, chrome left out, joined by line feeds."""
    seen, named, bodies = parsed(page)
    free = settled(seen, named, bodies)
    if len(free) < len(named):
        free = without_wrappers(seen, named, weights, free)
    scores, hides = scored(seen, named, weights, free)
    start, end = best_run(scores)
    out: dict[int, list[str]] = {}
    for u in seen[start:end]:
        if not u.is_tag and not hides[u.within]:
            out.setdefault(u.block, []).append(u.text)
    lines = (" ".join("".join(parts).split()) for parts in out.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_fit_pages: int = 2_000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). ``weights`` are fitted on ``pages``
    if none are given.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in
    page order by one line feed. Null or empty html, and pages of tags only, give an empty text; a page
    without tags is one block; rows repeated with one identifier give a row each; null identifiers and
    urls are kept; an empty table gives no rows.
    """
    found = fit(pages, html_col, max_fit_pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), found) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
