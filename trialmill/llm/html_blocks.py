"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text. Each block carries its word count and link density, those of the blocks
beside it, and where it stands (inside the article, inside a part of the page's frame). A decision tree trained
on the small labelled table below says which blocks belong to the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import slices

#: Element names and words of class, id and role by their part in a page.
RAW = frozenset("script style title textarea template noscript svg math iframe object canvas audio video select".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME_TAGS = frozenset("head nav footer aside form button menu dialog".split())
FRAME_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer footer login menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget widgets alert complementary contentinfo search".split()
)
#: These count as frame only outside the article, where an article may have a head of its own.
HEAD_TAGS, HEAD_WORDS = frozenset(["header"]), frozenset(["header", "masthead", "banner", "toolbar"])
ARTICLE_TAGS = frozenset("article main".split())
#: These hold the text of the page itself: words of their class or id say how it is laid out, not what it is.
WHOLE_TAGS = frozenset("html body article main".split())
ARTICLE_WORDS = frozenset("article articlebody content entry main post story".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|</?[A-Za-z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Columns of the labelled table and of what the tree sees.
FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "scope", "frame")
#: Small labelled table. scope: 2 inside an article, 1 on a page without one, 0 outside the article of a page;
#: frame: 1 inside menus, footers, sidebars, notices, adverts, forms or comments. The last value is the label.
LABELLED = (
    (12, 0.0, 0, 0.0, 80, 0.0, 2, 0, 1),
    (1, 0.0, 40, 0.0, 55, 0.0, 2, 0, 1),
    (3, 0.0, 1, 0.0, 2, 0.0, 2, 0, 1),
    (85, 0.0, 12, 0.0, 60, 0.0, 2, 0, 1),
    (240, 0.05, 85, 0.0, 1, 0.0, 2, 0, 1),
    (30, 0.4, 90, 0.0, 40, 0.1, 2, 0, 1),
    (6, 1.0, 70, 0.0, 80, 0.0, 2, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 2, 0, 1),
    (45, 0.0, 9, 1.0, 8, 1.0, 2, 0, 1),
    (1, 0.0, 1, 1.0, 14, 0.0, 2, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 1),
    (8, 0.9, 2, 1.0, 30, 0.0, 2, 0, 1),
    (3, 1.0, 0, 0.0, 3, 1.0, 2, 0, 1),
    (2, 1.0, 30, 0.0, 0, 0.0, 2, 0, 1),
    (12, 0.8, 3, 1.0, 4, 0.9, 2, 0, 1),
    (20, 0.9, 40, 0.0, 5, 1.0, 2, 0, 1),
    (25, 0.0, 10, 0.2, 18, 0.0, 2, 1, 0),
    (8, 0.0, 200, 0.0, 10, 0.0, 2, 1, 0),
    (1, 1.0, 60, 0.0, 1, 1.0, 2, 1, 0),
    (60, 0.0, 4, 0.0, 70, 0.0, 2, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0),
    (3, 1.0, 2, 1.0, 9, 0.0, 0, 1, 0),
    (12, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0),
    (90, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0),
    (10, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0),
    (1, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0),
    (9, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0),
    (40, 0.0, 1, 1.0, 30, 0.0, 0, 0, 0),
    (4, 1.0, 3, 1.0, 4, 1.0, 0, 0, 0),
    (60, 0.0, 40, 0.0, 80, 0.0, 0, 0, 0),
    (25, 0.0, 0, 0.0, 5, 1.0, 0, 0, 0),
    (120, 0.02, 10, 0.0, 90, 0.0, 0, 0, 0),
    (15, 0.0, 30, 0.0, 20, 0.0, 0, 0, 0),
    (30, 0.0, 20, 0.0, 40, 0.0, 1, 0, 1),
    (80, 0.05, 5, 0.0, 60, 0.0, 1, 0, 1),
    (18, 0.1, 40, 0.0, 0, 0.0, 1, 0, 1),
    (5, 0.0, 40, 0.0, 60, 0.0, 1, 0, 1),
    (4, 0.0, 0, 0.0, 70, 0.0, 1, 0, 1),
    (2, 0.0, 35, 0.0, 30, 0.0, 1, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 0),
    (3, 1.0, 0, 0.0, 2, 1.0, 1, 0, 0),
    (12, 0.8, 3, 1.0, 4, 0.9, 1, 0, 0),
    (20, 0.9, 40, 0.0, 5, 1.0, 1, 0, 0),
    (14, 0.0, 3, 1.0, 60, 0.0, 1, 1, 0),
    (70, 0.0, 20, 0.0, 60, 0.0, 1, 1, 0),
    (2, 1.0, 30, 0.0, 2, 1.0, 1, 1, 0),
    (4, 0.0, 40, 0.0, 2, 1.0, 1, 0, 1),
    (25, 0.0, 3, 1.0, 4, 0.0, 1, 0, 1),
    (50, 0.0, 3, 1.0, 4, 1.0, 1, 0, 1),
    (15, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1),
    (3, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0),
    (2, 0.0, 4, 1.0, 2, 1.0, 1, 0, 0),
    (4, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0),
    (25, 0.6, 80, 0.0, 70, 0.0, 1, 0, 1),
    (18, 0.7, 60, 0.0, 50, 0.0, 1, 0, 1),
    (2, 1.0, 4, 0.0, 0, 0.0, 1, 0, 0),
    (2, 1.0, 0, 0.0, 40, 0.0, 1, 0, 0),
    (3, 1.0, 40, 0.0, 40, 0.0, 1, 0, 0),
)


@dataclass(frozen=True)
class Split:
    """An inner node: values up to the limit go low."""

    feature: int
    limit: float
    low: "Split | int"
    high: "Split | int"


def _gini(labels: np.ndarray) -> float:
    share = labels.mean() if len(labels) else 0.0
    return 2 * share * (1 - share)


def train_tree(rows, depth: int = 6) -> Split | int:
    """Decision tree on rows of features with the label last; splits by Gini impurity, ties to the earlier column.

    A block's own words and link density come first, so ties go to them.
    """
    data = np.asarray(rows, float)
    x, y = data[:, :-1], data[:, -1]
    majority = int(y.mean() >= 0.5)
    if depth == 0 or len(set(y)) == 1:
        return majority
    best = (_gini(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            impurity = (low.sum() * _gini(y[low]) + (~low).sum() * _gini(y[~low])) / len(y)
            if impurity < best[0] - 1e-9:
                best = (impurity, f, limit)
    if best[1] is None:
        return majority
    low = x[:, best[1]] <= best[2]
    return Split(best[1], float(best[2]), train_tree(data[low], depth - 1), train_tree(data[~low], depth - 1))


def classify(tree: Split | int, row) -> int:
    """Label of a row of features."""
    while not isinstance(tree, int):
        tree = tree.low if row[tree.feature] <= tree.limit else tree.high
    return tree


@lru_cache(maxsize=1)
def block_tree() -> Split | int:
    """The tree trained on the labelled table."""
    return train_tree(LABELLED)


def _standing(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element belongs to the frame of a page, and whether it opens an article."""
    frame, words = tag in FRAME_TAGS, set()
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "style":
                frame |= bool(_HIDDEN.search(value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                frame = True
            elif name in ("class", "id", "role"):
                words.update(_WORD.findall(value))
    heads = tag in HEAD_TAGS or words & HEAD_WORDS
    if tag not in WHOLE_TAGS:
        frame |= bool(words & (FRAME_WORDS - HEAD_WORDS)) or (bool(heads) and not in_article)
    article = not frame and (tag in ARTICLE_TAGS or (tag in ("div", "section") and bool(words & ARTICLE_WORDS)))
    return frame, article


@dataclass
class Block:
    """A flat block: its text, words, words in links, and where it stands."""

    text: str
    words: int
    linked: int
    in_article: bool
    frame: bool


def blocks_of(page: str) -> list[Block]:
    """Flat text blocks of a page in order."""
    blocks: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, frame, article
    frames = articles = anchors = 0
    at = 0

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                linked = len(html.unescape(" ".join(links)).split()) if links else 0
                blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), articles > 0, frames > 0))
        parts.clear()
        links.clear()

    def say(text: str) -> None:
        parts.append(text)
        if anchors:
            links.append(text)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[1] or s[2] for s in stack[k:]):
                        flush()
                    for _, frame, article in stack[k:]:
                        frames, articles = frames - frame, articles - article
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":  # a paragraph ends where another block begins
                _, frame, article = stack.pop()
                frames, articles = frames - frame, articles - article
        if tag in VOID:
            continue
        if tag == "a":
            anchors += 1
        frame, article = _standing(tag, m[3], articles > 0)
        if frame or article:
            flush()
        if frame or article or tag in BLOCKS:
            stack.append((tag, frame, article))
            frames, articles = frames + frame, articles + article
    flush()
    return blocks


def features_of(blocks: list[Block]) -> Iterator[tuple[float, ...]]:
    """Features of each block with those of its neighbours."""
    has_article = any(b.in_article for b in blocks)
    own = [(b.words, b.linked / b.words) for b in blocks]
    for k, b in enumerate(blocks):
        before = own[k - 1] if k else (0, 0.0)
        after = own[k + 1] if k + 1 < len(own) else (0, 0.0)
        yield (*own[k], *before, *after, 2 if b.in_article else 0 if has_article else 1, int(b.frame))


def main_text(page: str | None, tree: Split | int | None = None) -> str:
    """Text of a page's article; blocks are joined by one line break."""
    if not page:
        return ""
    tree = block_tree() if tree is None else tree
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features_of(blocks)) if classify(tree, row))


def extract(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """Add `into`: the main text of each whole page, empty if there is none.

    Character references are decoded and white space inside a block becomes one space. A null or empty page
    gives an empty text; equal pages give equal texts; broken markup is read as far as it goes, and a
    tag that the end of the page cuts off is markup, not text. Other
    columns pass unchanged, one named like `into` is replaced. One pass over the rows, without a shuffle.
    """
    keep = [c for c in pages.columns if c not in (into, html_column)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(into, T.StringType())])

    tree = block_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            names = part.schema.names
            texts = [main_text(p, tree) for p in part.column(names.index(html_column)).to_pylist()]
            columns = [part.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*keep, into])

    return pages.mapInArrow(run, schema)
