"""Main text of web pages by tag-path ratios.

A page is read in one pass into text blocks, each with its root-to-leaf path of block tags (with class names). Paths
through menus, adverts, forms, comments and the like that a page marks as such by tag, role or class score 0. Over the
others, text length, punctuation and link text are added up for every path and for all that lies below it:

* ratio of a path: characters for each block * log(1.5 + punctuation for each block) * share of text outside links,
* surroundings of a path: the ratio over all blocks below its parent, or FADE of the parent's own surroundings,
* smoothed ratio: the ratios along the page under a kernel of (1/4, 1/2, 1/4), averaged over the path's blocks.

A path's score fuses the three, each as a share of the page's largest, times its share of text outside links, times
OUTSIDE for paths that avoid article and main where those hold a fifth of the text. Paths whose score reaches LEAST of
the mean score (weighted by text) are content: their blocks are the result, in page order.

Defined results: a null, empty or textless page gives the empty string. White space inside a block becomes one space
(a <br> counts as white space), blocks are joined by one line feed, nothing is cut. Every input row gives one row; columns
beside page_id, url and html are ignored, whatever their names, and an empty table gives none. Work and memory are linear
in a page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import arrow

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas select object title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split()
)
#: Elements that an opening tag of the given kind ends.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# What marks an element as no part of the article.
SIDE_TAGS = frozenset("nav footer aside form head menu dialog button label input fieldset search".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply responses".split())
SIDE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising alert alerts banner banners breadcrumb breadcrumbs consent cookie cookies "
    "copyright footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination "
    "paywall popup promo promoted promotion recommended related share sharing sidebar sidebars signup social sponsor sponsored subscribe "
    "subscription toolbar topbar tracking widget widgets".split()
)
# Words that may stand beside these in a class name without changing its meaning.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box buttons center col column container desktop fixed form global inner item items left line links list "
    "main message mobile module outer page panel posts primary reader readers right row secondary section site sticky text the top user users view wrap wrapper".split()
)
MARKABLE = frozenset("div section ul ol dl p span center details figure".split())
#: Weights of ratio, surroundings and smoothed ratio; see above.
WEIGHTS, FADE, OUTSIDE, LEAST = (0.25, 0.6, 0.15), 0.9, 0.2, 0.2
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_VALUE = re.compile(r""">|=\s*["']""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


def _tag_end(page: str, i: int, unclosed: set[int]) -> int:
    """Index of the '>' that ends the tag at i; a '>' in a quoted value doesn't. -1: none.

    Without an end, the first '>' counts. unclosed: starts of values from which a page has no end, so that no later
    tag reads on from there.
    """
    first, at, seen = page.find(">", i), i, []
    while first >= 0 and (m := _VALUE.search(page, at)):
        if m[0] == ">":
            return m.start()
        if m.end() in unclosed:
            break
        seen.append(m.end())
        at = page.find(m[0][-1], m.end()) + 1
        if not at:
            break
    unclosed.update(seen)
    return first


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or raw.strip(" /") else {}


def _aside(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in SIDE_TAGS or tag == "header" and not inside_article:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in SIDE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if tag in MARKABLE:
        for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
            words = {w.lower() for w in _WORD.findall(name)}
            if words & COMMENT_WORDS and words <= SIDE_WORDS | NEUTRAL_WORDS | {"post", "article", "entry"}:
                return True
            marked = words & SIDE_WORDS
            if inside_article:
                marked -= {"header"}  # an article's own header holds its title
            if marked and words <= SIDE_WORDS | NEUTRAL_WORDS:
                return True
    return False


def blocks(page: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, bool]]]:
    """In page order: path, text, characters in links; and of each path its parent (a smaller number), its last tag and
    whether it is marked as aside, path 0 being the page."""
    found, stack, pieces, link = [], [], [], 0  # stack: tag, aside, path
    paths: dict[tuple[int, str, bool, str], int] = {}
    where: dict[str, list[int]] = {"": []}  # places in the stack by tag, and of all of BLOCK
    unclosed: set[int] = set()
    i, n = 0, len(page)

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def flush() -> None:
        nonlocal link
        if pieces:
            if text := " ".join(entities.unescape("".join(pieces)).split()):
                found.append((stack[-1][2] if stack else 0, text, min(link, len(text))))
            pieces.clear()
        link = 0

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop()[0]
            where[tag].pop()
            if tag in BLOCK:
                where[""].pop()

    def pop(to: int) -> None:
        if last("") >= to:
            flush()
        cut(to)

    while i < n:
        at = page.find("<", i)
        if at < 0:
            at = n
        if at > i:
            pieces.append(page[i:at])
            if where.get("a"):
                link += at - i
        if at >= n:
            break
        i = at
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            i = n if end < 0 else end + 3
        elif page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i)
            i = n if end < 0 else end + 1
        elif page[i + 1 : i + 2] == "/":
            end = page.find(">", i)
            name = _NAME.match(page, i + 2)
            i = n if end < 0 else end + 1
            if name:
                tag = name[0].lower()
                k = last(tag)
                if k >= 0 and (tag in BLOCK or k >= last("article", "main", "table")):
                    pop(k)
        elif name := _NAME.match(page, i + 1):
            tag = name[0].lower()
            end = _tag_end(page, i, unclosed)
            if end < 0:
                break
            raw = page[name.end() : end]
            i = end + 1
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, i) if not raw.endswith("/") else None
                if close:
                    i = close.end()
                elif not raw.endswith("/"):
                    i = n
                continue
            if tag in BLOCK:
                flush()
                if last("p") >= max(0, last("")):  # an open paragraph ends here
                    cut(last("p"))
                if tag in ENDS:
                    ended, within = ENDS[tag]
                    while (k := last(*ended)) > last(*within):
                        cut(k)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
            if tag in VOID:
                pieces.append(" ")
                continue
            attributes = _attributes(raw)
            above = stack[-1] if stack else ("", False, 0)
            aside = above[1] or _aside(tag, attributes, bool(where.get("article") or where.get("main")))
            path = paths.setdefault((above[2], tag, aside, attributes.get("class", "")), len(paths) + 1) if tag in BLOCK or aside != above[1] else above[2]
            where.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                where[""].append(len(stack))
            stack.append((tag, aside, path))
        else:
            pieces.append("<")
            i += 1
    flush()
    return found, [(0, "", False), *(key[:3] for key in paths)]


def _ratio(count: np.ndarray, length: np.ndarray, points: np.ndarray, linked: np.ndarray) -> np.ndarray:
    n = np.maximum(count, 1)
    return length / n * np.log(1.5 + points / n) * (1 - linked / np.maximum(length, 1))


def path_scores(found: list[tuple[int, str, int]], paths: list[tuple[int, str, bool]]) -> np.ndarray:
    """Of each path its fused score; 0 for marked paths and those without blocks."""
    score = np.zeros(len(paths))
    found = [b for b in found if not paths[b[0]][2]]
    if not found:
        return score
    path = np.array([b[0] for b in found])
    length = np.array([len(b[1]) for b in found], float)
    columns = (np.ones(len(found)), length, np.array([len(_PUNCTUATION.findall(b[1])) for b in found], float), np.array([b[2] for b in found], float))
    sums = [np.bincount(path, c, len(paths)) for c in columns]
    below = [c.tolist() for c in sums]
    for p in range(len(paths) - 1, 0, -1):
        for c in below:
            c[paths[p][0]] += c[p]
    own, whole = _ratio(*sums), _ratio(*map(np.array, below))
    around, within = whole.copy(), [False] * len(paths)
    for p, (above, tag, _) in enumerate(paths[1:], 1):
        around[p] = max(whole[above], FADE * around[above])
        within[p] = within[above] or tag in ("article", "main")
    smooth = np.convolve(np.pad(own[path], 1, mode="edge"), (0.25, 0.5, 0.25), mode="valid")
    smooth = np.bincount(path, smooth, len(paths)) / np.maximum(sums[0], 1)
    for w, x in zip(WEIGHTS, (own, around, smooth), strict=True):
        score += w * x / (x.max() or 1)
    score *= (sums[0] > 0) * (1 - sums[3] / np.maximum(sums[1], 1))
    if 5 * sums[1][within].sum() >= length.sum():
        score[~np.array(within)] *= OUTSIDE
    return score


def main_text(page: str | None) -> str:
    """The blocks on content paths, joined by line feeds."""
    found, paths = blocks(page or "")
    if not found:
        return ""
    score = path_scores(found, paths)
    own = np.array([score[b[0]] for b in found])
    length = np.array([len(b[1]) for b in found]) * (own > 0)
    least = LEAST * float(own @ length) / max(1, int(length.sum()))
    return "\n".join(b[1] for b, s in zip(found, own.tolist(), strict=True) if s > 0 and s >= least)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(arrow(work, "page_id long, url string, text string, n_chars long"))
