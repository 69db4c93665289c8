"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a run of tags and words. A word scores what its surroundings (innermost
element, inside a link or not) were worth on labelled pages, a tag scores below
zero; one linear scan finds the contiguous region with the largest sum. Labelled
pages are those whose own markup says where the article is (``<article>``); at
most ``LABELLED`` of them, by hash of the page, are counted, and kinds never seen
there keep the prior. Of the region, blocks under menus, headers, footers,
sidebars, notices, adverts, forms and comments (by element, role or class) go.

A class name made of such words alone (``site-header``, ``comment-list``) says what
a block is. One that has other words beside them (``has-sidebar``, ``notice-board``,
``share-enabled``) may as well describe the layout around an article: such a block
only goes if it holds neither an article element nor most of the page's words.

White space in a block becomes one space, ``<br>`` is white space, blocks are
joined by one newline, character references are decoded. Null or empty html, and
pages without a positive word, give the empty text. Unclosed elements end where
HTML ends them. Repeated rows get a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, row_key, text_of

LABELLED = 1000
_CLIP = 3.0

# Kinds of HTML elements, and words in class, id or role that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head title nav header footer aside form script style noscript template iframe svg object select button textarea "
    "dialog canvas audio video menu".split()
)
IMPLIED_END = frozenset("p li dt dd td th tr option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adsense adbox sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar sidenav rail footer header masthead topbar cookie cookies gdpr consent notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments reply replies respond disqus discussion search searchbox pagination pager widget toolbar "
    "complementary contentinfo copyright".split()
)
# Words that say where or how large, not what: beside them a furniture word keeps its meaning.
PLACE = frozenset(
    "site page main primary secondary global top bottom left right upper lower inner outer sub first second third last "
    "wrapper wrap container content box area section block list item items link links post posts article entry bar button "
    "buttons btn form group row col column panel slot unit text title icon icons count id js mobile desktop inline story stories "
    "news email user thread toggle large small medium leaderboard skyscraper".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Za-z]+")


def _furniture(name: str, attributes: str) -> int:
    """2 if the element is page furniture, 1 if its marks leave that open, else 0."""
    if name in DROPPED:
        return 2
    if not attributes or name in HEADINGS or name in ("html", "body", "main", "article"):
        return 0
    if _HIDDEN.search(attributes):
        return 2
    found = 0
    for m in _MARK.finditer(attributes):
        for mark in m.group(1).strip("\"'").split():
            parts = [p.lower() for p in _PART.findall(mark)]
            if not FURNITURE.isdisjoint(parts):
                found = max(found, 2 if all(p in FURNITURE or p in PLACE for p in parts) else 1)
    return found


def _walk(page: str):
    """``(tag or None, text, kind, in article, dropped, starts a block, doubtful block)`` for each tag and text, in order.

    Doubtful blocks are numbered, -1 stands for none; the last item holds the list of their parents.
    Every lookup is of the innermost open element of some sort, so unclosed elements cost nothing further."""
    stack: list[tuple[str, int]] = []  # name, furniture
    places: dict[str, list[int]] = {}  # where each name is open
    outer: list[int] = []  # where elements are open that are not inline
    walls: list[int] = []  # where furniture is open that other end tags do not close
    firm: list[int] = []  # where elements are open that neither are inline nor end by themselves
    doubts: list[int] = []
    parents: list[int] = []
    inside = dropped = links = 0
    block = True

    def push(name: str, out: int) -> None:
        nonlocal inside, dropped, links
        at = len(stack)
        stack.append((name, out))
        places.setdefault(name, []).append(at)
        if name not in INLINE:
            outer.append(at)
            if name not in IMPLIED_END:
                firm.append(at)
        if out == 2 and name not in IMPLIED_END:
            walls.append(at)
        inside += name == "article"
        links += name == "a"
        dropped += out == 2
        if out == 1:
            parents.append(doubts[-1] if doubts else -1)
            doubts.append(len(parents) - 1)

    def pop() -> str:
        nonlocal inside, dropped, links
        name, out = stack.pop()
        at = len(stack)
        places[name].pop()
        for held in (outer, firm, walls):
            if held and held[-1] == at:
                held.pop()
        inside -= name == "article"
        links -= name == "a"
        dropped -= out == 2
        if out == 1:
            doubts.pop()
        return name

    def at_last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    for m in _TOKEN.finditer(page):
        text = m.group(5)
        doubt = doubts[-1] if doubts else -1
        if text is not None:
            here = stack[outer[-1]][0] if outer else ""
            yield None, text, f"{here}/a" if links else here, inside > 0, dropped > 0, block, doubt
            block = False
            continue
        name = (m.group(3) or m.group(1) or "").lower()
        if not name or m.group(1):
            if name:
                yield name, "", name, inside > 0, True, False, doubt
            continue
        closing, attributes = m.group(2), m.group(4) or ""
        if name not in INLINE:
            block = True
        if closing:
            at = at_last(name)
            if at >= 0 and (at >= (walls[-1] if walls else -1) or name in ("body", "html", "article", "main")):
                while len(stack) > at:
                    pop()
        else:
            if name not in INLINE:
                # an unclosed p or li ends where a block starts; li and cells only at their like
                while stack and (stack[-1][0] in INLINE and places.get("p") or stack[-1][0] == "p"):
                    if pop() == "p":
                        break
                last = at_last(name)
                if name in IMPLIED_END and last >= 0 and (not firm or firm[-1] < last):
                    while len(stack) > last:
                        pop()
            if name not in VOID and not attributes.rstrip().endswith("/"):
                push(name, _furniture(name, attributes))
        doubt = doubts[-1] if doubts else -1
        yield name, " " if name == "br" else "", name, inside > 0, dropped > 0, False, doubt
    yield None, parents, "", False, False, False, -2


def tokens(page: str) -> list[tuple]:
    """``(tag or None, text, kind, in article, dropped, starts a block)`` for each tag and text, in order; doubtful blocks decided."""
    seen = list(_walk(page))
    parents = seen.pop()[1]
    if not parents:
        return [t[:6] for t in seen]
    words, holds, total = [0] * len(parents), [False] * len(parents), 0
    for tag, text, kind, _, dropped, _, doubt in seen:
        if dropped:
            continue
        if tag is None and not kind.endswith("/a"):
            n = len(text.split())
            total += n
            if doubt >= 0:
                words[doubt] += n
        elif tag in ("article", "main") and doubt >= 0:
            holds[doubt] = True
    for k in range(len(parents) - 1, -1, -1):  # children come after their parents
        if parents[k] >= 0:
            words[parents[k]] += words[k]
            holds[parents[k]] |= holds[k]
    gone = []
    for k, parent in enumerate(parents):
        gone.append(parent >= 0 and gone[parent] or not holds[k] and 2 * words[k] <= total)
    return [(tag, text, kind, inside, dropped or doubt >= 0 and gone[doubt], new) for tag, text, kind, inside, dropped, new, doubt in seen]


def count_kinds(page: str) -> Counter:
    """How often each kind of word and tag stands inside and outside the article of a labelled page."""
    seen: Counter = Counter()
    for tag, text, kind, inside, dropped, _ in tokens(page):
        if not dropped:
            seen["tag" if tag else "word", kind, inside] += 1 if tag else len(text.split())
    return seen


class Weights:
    """Log-odds of standing in an article; tags stay below zero, unseen kinds keep a prior."""

    def __init__(self, seen: Counter):
        self.word: dict[str, float] = {}
        self.tag: dict[str, float] = {}
        for what, kind, _ in list(seen):
            odds = math.log((seen[what, kind, True] + 1) / (seen[what, kind, False] + 1))
            odds = max(-_CLIP, min(_CLIP, odds))
            (self.tag if what == "tag" else self.word)[kind] = min(odds, -0.1) if what == "tag" else odds

    def of(self, tag: str | None, kind: str, words: int) -> float:
        if tag:
            return self.tag.get(kind, -0.1 if kind in INLINE or kind in ("p", *HEADINGS) else -1.0)
        return words * self.word.get(kind, -1.0 if kind.endswith("/a") else 1.0)


def main_text(page: str, weights: Weights) -> str:
    seen = tokens(page)
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (tag, text, kind, _, dropped, _) in enumerate(seen):
        total += -0.05 if dropped else weights.of(tag, kind, len(text.split()))
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    blocks: list[list[str]] = []
    for tag, text, _, _, dropped, new in seen[slice(*best_at)]:
        if dropped or tag and not text:
            continue
        if new or not blocks:
            blocks.append([])
        blocks[-1].append(text)
    done = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in done if b)


def fit(pages: DataFrame, most: int = LABELLED) -> Weights:
    """Weights from at most ``most`` labelled pages, chosen by hash so that reruns agree."""
    labelled = pages.where(F.lower(col("html")).contains("<article")).select(row_key(pages).alias("_key"), col("html").alias("html"))
    chosen = F.broadcast(labelled.select("_key").distinct().orderBy("_key").limit(most))

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for page in batch.column("html"):
                seen += count_kinds(page.as_py())
            rows = [(*k, n) for k, n in seen.items()]
            names = ["what", "kind", "inside", "n"]
            types = [pa.string(), pa.string(), pa.bool_(), pa.int64()]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    counted = labelled.join(chosen, "_key", "left_semi").dropDuplicates(["_key"])
    counted = counted.mapInArrow(count, "what string, kind string, inside boolean, n bigint")
    rows = counted.groupBy("what", "kind", "inside").agg(F.sum("n").alias("n")).collect()  # one row per kind of element
    return Weights(Counter({(r["what"], r["kind"], r["inside"]): r["n"] for r in rows}))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text``."""
    held = weights or fit(pages)

    def run(batches):
        for batch in batches:
            text = [main_text(x.as_py(), held) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"]
            )

    rows = pages.select(col("page_id").cast("bigint").alias("page_id"), col("url").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
