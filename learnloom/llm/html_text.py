"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read as a flat list of text blocks (what stands between the borders of block
elements), each with its number of words and its link density, those of its neighbours, the
words of the page's marked main part, and where it stands. A decision tree, trained on the driver
from the labelled blocks in ``LABELLED``, keeps a block or drops it. The blocks kept are joined in
order.

Where a block stands: elements and roles that never hold an article (navigation, footer, aside,
...) are boilerplate. Words in class and id are weaker: a page may sit in ``div.with-sidebar`` or
in one form as a whole. So the named elements around a block are counted, and the page's text is
sought at the smallest count that has a main part or running text; blocks further inside named
elements are boilerplate. A ``main`` element starts the count anew.

Every page is read whole, in one pass over its tags; a task holds one batch of pages.

Edge cases: null and empty pages give an empty text, plain text is one block. Tags that are not
closed end with their parent, a paragraph with the next block. Unknown character references stay
as they are. Repeated rows get equal texts. Columns of the input are kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from learnloom.llm.common import boxed, small_batches, unboxed

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th img wbr input".split())  # borders of words, not of blocks
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())  # end at their own end tag only
DROPPED = frozenset(
    "aside button canvas dialog footer head iframe label menu nav noscript object option search select svg template".split()
)
MAIN = frozenset("article main".split())
HOLDERS = frozenset("center div dl ol section table tbody td tr ul".split())  # class words mark these as main, not headings
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
# Class and id words of parts that are never the article, and of parts whose name a wrapper of the page may bear.
DEFINITE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus modal newsletter notice notices pager pagination popup promo promoted promotion recommended related "
    "replies reply respond sponsor sponsored subscribe subscription teaser".split()
)
LAYOUT_NAMES = frozenset(
    "banner feedback footer form login masthead menu nav navbar navigation search share sharing sidebar signup social "
    "toolbar widget widgets".split()
)
MAIN_NAMES = frozenset("article articlebody content entry maincontent post postbody story".split())
STATE_FIRST = frozenset("has hide is no show with without".split())  # has-sidebar, comments-open: states of a wrapper
STATE_LAST = frozenset("active allowed closed disabled enabled off on open".split())
WRAPPERS = frozenset("area block box col container inner layout outer page row wrap wrapper".split())
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Where a block stands: boilerplate element; in a named part; outside a marked main part; page without marks; main part.
DROP, NAMED, BESIDE, UNMARKED, INSIDE = range(5)
DEFINITE = 1000  # depth that a definite name adds
RUNNING = 5  # words outside links that count as running text

# Labelled blocks of invented pages, in page order: (place, words, words in links, main text?).
LABELLED = [
    # an article page with marked parts
    [(DROP, 1, 1, 0), (DROP, 1, 1, 0), (DROP, 3, 3, 0), (DROP, 12, 0, 0), (INSIDE, 7, 0, 1), (INSIDE, 60, 0, 1), (INSIDE, 1, 0, 1),
     (INSIDE, 45, 3, 1), (INSIDE, 4, 0, 1), (INSIDE, 120, 6, 1), (DROP, 25, 2, 0), (DROP, 8, 0, 0)],
    # adverts and comments inside the article's part
    [(DROP, 2, 2, 0), (BESIDE, 5, 0, 0), (INSIDE, 9, 0, 1), (INSIDE, 2, 0, 1), (DROP, 10, 1, 0), (INSIDE, 33, 0, 1), (INSIDE, 80, 2, 1),
     (DROP, 40, 1, 0), (DROP, 55, 0, 0), (DROP, 3, 3, 0), (BESIDE, 30, 0, 0), (BESIDE, 9, 1, 0)],
    # link lists at the end of an article, links inside it
    [(DROP, 4, 4, 0), (INSIDE, 6, 0, 1), (INSIDE, 70, 10, 1), (INSIDE, 3, 3, 1), (INSIDE, 52, 0, 1), (INSIDE, 18, 0, 1), (INSIDE, 5, 5, 0),
     (INSIDE, 4, 4, 0), (INSIDE, 6, 6, 0), (INSIDE, 5, 5, 0), (DROP, 14, 3, 0)],
    # text next to a marked part: teasers, notices, legal lines
    [(BESIDE, 3, 0, 0), (BESIDE, 24, 24, 0), (BESIDE, 60, 4, 0), (INSIDE, 12, 0, 1), (INSIDE, 22, 1, 1), (INSIDE, 8, 0, 1), (BESIDE, 110, 0, 0),
     (BESIDE, 12, 0, 0)],
    # pages without any marks
    [(UNMARKED, 1, 1, 0), (UNMARKED, 1, 1, 0), (UNMARKED, 2, 2, 0), (UNMARKED, 6, 0, 1), (UNMARKED, 55, 0, 1), (UNMARKED, 30, 2, 1),
     (UNMARKED, 3, 0, 1), (UNMARKED, 75, 1, 1), (UNMARKED, 5, 5, 0), (UNMARKED, 4, 4, 0)],
    [(UNMARKED, 3, 3, 0), (UNMARKED, 4, 3, 0), (UNMARKED, 8, 0, 1), (UNMARKED, 41, 0, 1), (UNMARKED, 14, 0, 1), (UNMARKED, 28, 9, 1),
     (UNMARKED, 90, 5, 1), (UNMARKED, 2, 2, 0), (UNMARKED, 7, 6, 0), (UNMARKED, 3, 3, 0)],
    [(UNMARKED, 5, 0, 1), (UNMARKED, 19, 0, 1), (UNMARKED, 11, 0, 1), (UNMARKED, 26, 0, 1)],
    [(UNMARKED, 2, 2, 0), (UNMARKED, 12, 12, 0), (UNMARKED, 10, 9, 0), (UNMARKED, 20, 18, 0), (UNMARKED, 16, 15, 0)],
    [(UNMARKED, 100, 0, 1)], [(UNMARKED, 3, 0, 1)], [(INSIDE, 2, 0, 1)], [(INSIDE, 140, 12, 1)], [(INSIDE, 1, 1, 1)], [(DROP, 200, 0, 0)],
    # named parts
    [(NAMED, 3, 3, 0), (NAMED, 8, 2, 0), (UNMARKED, 5, 0, 1), (UNMARKED, 64, 2, 1), (NAMED, 40, 0, 0), (NAMED, 130, 3, 0), (NAMED, 1, 0, 0)],
    [(NAMED, 20, 0, 0), (INSIDE, 6, 0, 1), (INSIDE, 50, 0, 1), (NAMED, 75, 0, 0), (BESIDE, 45, 0, 0), (NAMED, 6, 6, 0)],
    # the mark is on the headline only, the text stands beside it
    [(DROP, 6, 6, 0), (BESIDE, 4, 4, 0), (INSIDE, 7, 0, 1), (BESIDE, 48, 0, 1), (BESIDE, 85, 4, 1), (BESIDE, 140, 2, 1), (BESIDE, 5, 5, 0)],
    [(INSIDE, 4, 0, 1), (BESIDE, 35, 1, 1), (BESIDE, 70, 0, 1), (BESIDE, 8, 8, 0), (NAMED, 60, 0, 0), (DROP, 30, 0, 0)],
    [(INSIDE, 10, 0, 1), (BESIDE, 6, 6, 0), (BESIDE, 40, 0, 1), (BESIDE, 56, 8, 1), (BESIDE, 12, 12, 0), (BESIDE, 3, 0, 0)],
    # short main parts with short lines beside them
    [(INSIDE, 5, 0, 1), (INSIDE, 9, 0, 1), (BESIDE, 7, 0, 0), (BESIDE, 12, 1, 0), (BESIDE, 16, 0, 0)],
    # long boilerplate: cookie notices, comments, terms
    [(DROP, 90, 4, 0), (DROP, 150, 0, 0), (INSIDE, 10, 0, 1), (INSIDE, 95, 0, 1), (DROP, 70, 0, 0), (DROP, 35, 0, 0)],
]


def features(blocks: list[tuple]) -> np.ndarray:
    """Rows (place, words, link density, words and link density of the block before and after,
    words outside links in the page's main part)."""
    if not blocks:
        return np.zeros((0, 8))
    table = np.array([(b[0], b[1], b[2] / b[1] if b[1] else 0.0) for b in blocks], np.float64)
    edge = np.zeros((1, 2))
    marked = np.full((len(blocks), 1), sum(b[1] - b[2] for b in blocks if b[0] == INSIDE))
    return np.hstack([table, np.vstack([edge, table[:-1, 1:]]), np.vstack([table[1:, 1:], edge]), marked])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """Binary tree by Gini impurity: a share of main text, or (feature, bound, below, above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] < bound
            impurity = sum(y[s].mean() * (1 - y[s].mean()) * s.sum() for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(bound), low)
    if best is None:
        return share
    _, feature, bound, low = best
    return feature, bound, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def tree():
    x = np.vstack([features(page) for page in LABELLED])
    return grow(x, np.array([b[3] for page in LABELLED for b in page], np.float64))


def is_main(node, row: np.ndarray) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] < node[1] else node[3]
    return node >= 0.5


def named(found: dict) -> tuple[int, bool]:
    """Depth that the class and id words of an element add, and whether they name main text."""
    depth, main = 0, False
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in NAME_PART.findall(token)]
        if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
            continue
        head = next((p for p in reversed(parts) if p not in WRAPPERS), "")
        if not DEFINITE_NAMES.isdisjoint(parts):
            depth = DEFINITE
        elif not LAYOUT_NAMES.isdisjoint(parts):
            depth = depth or int(head not in MAIN_NAMES or head == "content")
        else:
            main = main or not MAIN_NAMES.isdisjoint(parts)
    return depth, main


def entered(tag: str, attributes: str, mark: int | None, depth: int) -> tuple[int | None, int]:
    """Mark and depth inside an element that stands at ``mark`` and ``depth``."""
    if mark == DROP or tag in DROPPED or tag == "header" and mark != INSIDE:
        return DROP, depth
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    if hidden or role in DROPPED_ROLES:
        return DROP, depth
    if "main" in (tag, role):
        return INSIDE, 0
    if tag in ("body", "html"):
        return mark, depth
    more, main = named(found)
    more = more or int("form" in (tag, role))
    if tag in MAIN or role in MAIN or main and not more and tag in HOLDERS:
        mark = INSIDE
    return mark, depth + more


def places(blocks: list[tuple]) -> list[int]:
    """Where the blocks (mark, depth, words, words in links, ...) of a page stand."""
    running: dict[int, int] = {}  # words outside links of unmarked blocks by depth
    inside: dict[int, int] = {}  # and of main parts
    for mark, depth, n, linked, *_ in blocks:
        if mark != DROP:
            counted = inside if mark == INSIDE else running
            counted[depth] = counted.get(depth, 0) + n - linked
    base = min([*running, *inside], default=0)
    part = min(inside, default=DEFINITE)
    if part < DEFINITE and inside[part] >= sum(n for d, n in running.items() if d < part):
        base = part
    else:
        total = {d: running.get(d, 0) + inside.get(d, 0) for d in {*running, *inside}}
        for enough in (RUNNING, 1):
            deep = [d for d, n in total.items() if n >= enough and (d < DEFINITE or enough == 1)]
            if deep:
                base = min(deep)
                break
    rest = BESIDE if any(d <= base for d in inside) else UNMARKED
    return [DROP if m == DROP else NAMED if d > base else rest if m is None else INSIDE for m, d, *_ in blocks]


def text_blocks(page: str) -> list[tuple[int, int, int, str]]:
    """(place, words, words in links, text) of every block in page order.

    The positions of open elements are kept by name and for blocks, so an end tag without a
    start costs nothing, whatever stands open.
    """
    blocks: list[tuple[int | None, int, int, int, str]] = []
    stack: list[tuple[str, tuple[int | None, int]]] = []  # open elements, mark and depth inside
    opened: dict[str, list[int]] = {}  # their positions by name
    open_blocks: list[int] = []  # positions of the blocks among them
    pieces: list[str] = []
    linked = 0  # words in links of the open block
    here: tuple[int | None, int] = (None, 0)

    def flush() -> None:
        nonlocal linked
        words = entities.unescape("".join(pieces)).split()
        if words:
            blocks.append((*here, len(words), min(linked, len(words)), " ".join(words)))
        pieces.clear()
        linked = 0

    def close(position: int) -> None:
        nonlocal here
        if (
            any(t in BLOCK or inside != here for t, inside in stack[position:])
            or (stack[position - 1][1] if position else (None, 0)) != here
        ):
            flush()
        while len(stack) > position:
            tag, _ = stack.pop()
            opened[tag].pop()
            if tag in BLOCK:
                open_blocks.pop()
        here = stack[-1][1] if stack else (None, 0)

    at, last = 0, page.rfind(">")
    while at < len(page):
        token = TOKEN.search(page, at, last + 1) if at <= last else None
        text = page[at : token.start()] if token else page[at:].partition("<!--")[0]
        if text:
            pieces.append(text)
            if opened.get("a"):
                linked += len(text.split())
        if not token:
            break
        at = token.end()
        end, tag, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if not tag:
            if token.group().startswith("<!--") and not token.group().endswith("-->"):
                break  # a comment without an end hides the rest
            continue
        tag = tag.lower()
        if not end and tag in RAW:
            over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        if tag in SPACE:
            pieces.append(" ")
        block = open_blocks[-1] if open_blocks else -1
        if end:
            position = opened[tag][-1] if opened.get(tag) else -1
            if position >= 0 and (tag in BLOCK or position > block):  # an inline end tag does not close a block
                close(position)
            elif position < 0 and tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            if block >= 0 and (stack[block][0] == "p" or tag == stack[block][0] == "li"):
                close(block)  # a block ends an open paragraph
            flush()
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        inside = entered(tag, attributes, *here)
        if inside != here:
            flush()
        here = inside
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append((tag, inside))
    flush()
    return [(place, *b[2:]) for place, b in zip(places(blocks), blocks)]


def main_text(page: str | None, node=None) -> str:
    blocks = text_blocks(page) if isinstance(page, str) else []
    if not blocks:
        return ""
    node = tree() if node is None else node
    return "\n".join(b[3] for b, row in zip(blocks, features(blocks)) if is_main(node, row))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` to every page."""
    small_batches(pages.sparkSession)
    node = tree()  # trained here, sent with the function

    @F.pandas_udf("struct<text string, n_chars long>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, node) for page in batch]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    done = pages.select(boxed(pages), read(column).alias("_main"))
    return done.select(*unboxed(kept), F.col("_main.text").alias("text"), F.col("_main.n_chars").alias("n_chars"))
