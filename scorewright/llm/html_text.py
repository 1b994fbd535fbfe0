"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.tables import bounded_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)", re.S)
_NAME_PARTS = re.compile(r"[a-z]+")
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe".split())
# without text of the page in them; they end with the block they are in, if not before
_SKIPPED = frozenset("svg object select button canvas audio video annotation annotation-xml".split())
_PAGE = frozenset("html body article main".split())
_TAG_AWAY = frozenset("nav aside footer menu dialog search".split())
_ROLE_AWAY = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_COMMENT = frozenset("comment comments disqus respond reply replies".split())
_NAME_AWAY = frozenset("""ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay nav navbar
navigation menu breadcrumb breadcrumbs footer sidebar side widget related recommended share sharing social subscribe newsletter signup login search pagination pager copyright
masthead skip toolbar topbar""".split())
# endings that an open paragraph or item makes implicit
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# Weights of the block classifier, in log odds for content.
WEIGHTS = {"bias": -1.0, "log_words": 0.6, "sentence": 0.5, "link_share": -3.0, "heading": 1.0, "item": -0.3, "article": 3.0, "away": -9.0, "soft_away": -5.0}
# pull between neighbours: next in the page, children of one element, loss for each level to the common one, share left across the edge of an aside, advert and so on
NEXT, SIBLING, DEEPER, ACROSS = 0.5, 1.5, 0.5, 0.1


class _Open:
    __slots__ = ("name", "mode", "number", "depth", "parent")

    def __init__(self, name: str, mode: str, number: int, parent: _Open | None):
        self.name, self.mode, self.number, self.parent = name, mode, number, parent
        self.depth = parent.depth + 1 if parent else 0


def _mode(name: str, attributes: str, above: str) -> str:
    """What an element says of the text in it: gone, away (for good), soft (until an article), article or nothing."""
    if above in ("gone", "away"):
        return above
    named: set[str] = set()
    role = ""
    for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if hidden or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "gone"
        if key in ("class", "id"):
            named.update(_NAME_PARTS.findall(value))
        elif key == "role":
            role = value
    if name in _TAG_AWAY or (name not in _PAGE and named & _COMMENT):
        return "away"
    if role in _ROLE_AWAY or (name not in _PAGE and named & _NAME_AWAY):
        return "soft"
    if name in ("article", "main") or role in ("main", "article"):
        return "article"
    if name == "form" or (name == "header" and above != "article"):
        return "soft"
    return above


def blocks(page: str) -> list[tuple[str, float, _Open]]:
    """(text, share of it in links, element) of each block with text, in page order."""
    found: list[tuple[str, float, _Open]] = []
    here, number = _Open("", "", 0, None), 0
    parts: list[str] = []
    linked, links, at, skip = 0, 0, 0, ""
    inner: list[str] = []  # blocks, and elements of the same name, open in a skipped element

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and here.mode != "gone":
                found.append((text, min(1.0, linked / len(text)), here))
            parts.clear()
        linked = 0

    def leave(to: _Open) -> None:
        nonlocal here, links
        node = here
        while node is not to:
            links -= node.name == "a"
            node = node.parent
        here = to

    for m in _TOKEN.finditer(page):
        end, name, attributes = m.group(1), m.group(2), m.group(3)
        if skip:
            tag = (name or "").lower()
            if end and tag == skip and tag not in inner:
                skip, at = "", m.end()
                inner.clear()
            elif skip in _SKIPPED and (tag in _BLOCKS or tag == skip):
                if not end:
                    if tag not in _VOID and not attributes.endswith("/"):
                        inner.append(tag)
                elif tag in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                else:
                    node = here
                    while node is not None and node.name != tag:
                        node = node.parent
                    if node is not None:
                        skip, at = "", m.start()
                        inner.clear()
            if skip or at == m.end():
                continue
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if links:
                linked += len(text)
        at = m.end()
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        block = name in _BLOCKS
        if block:
            close_block()
        if end:
            node = here
            while node is not None and node.name != name:
                # an inline end does not reach past the block it is in
                node = None if not block and node.name in _BLOCKS else node.parent
            if node is not None and node.parent is not None:
                leave(node.parent)
            continue
        if name in _RAW or name in _SKIPPED:
            if not attributes.endswith("/"):
                skip = name
            continue
        if name in _VOID:
            continue
        if block:
            # a block ends an open paragraph; an item ends the item before it in the same list
            node, ends = here, _ENDS.get(name, ())
            while node.parent is not None:
                if node.name == "p" or node.name in ends:
                    leave(node.parent)
                    break
                if node.name in _BLOCKS:
                    break
                node = node.parent
        number += 1
        here = _Open(name, _mode(name, attributes, here.mode), number, here)
        links += name == "a"
        if attributes.endswith("/") and name not in _BLOCKS:
            leave(here.parent)
    if not skip and at < len(page):
        parts.append(page[at:])
    close_block()
    return found


def _score(text: str, link_share: float, node: _Open, w: dict[str, float]) -> float:
    words = text.count(" ") + 1
    score = w["bias"] + w["log_words"] * min(words, 60) ** 0.5 + w["link_share"] * link_share
    if text[-1] in ".!?…:;\"”»":
        score += w["sentence"]
    mode = {"article": "article", "away": "away", "soft": "soft_away"}.get(node.mode)
    if mode:
        score += w[mode]
    outer: _Open | None = node
    while outer is not None and outer.name not in _BLOCKS:
        outer = outer.parent
    if outer is not None:
        score += w["heading"] * (outer.name in ("h1", "h2", "h3", "h4", "h5", "h6")) + w["item"] * (outer.name == "li")
    return score


def _levels_apart(a: _Open, b: _Open) -> int:
    """Steps from the deeper of the two up to their closest common element."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
            if b.depth > (a.depth if a else 0):
                b = b.parent
        else:
            b = b.parent
        steps += 1
        if a is None or b is None:
            break
    return steps


def min_cut(gains: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut.

    A positive gain is the capacity from the source to the node, a negative one that from the node to the sink; an edge costs its weight when its ends
    part. Flow is sent along shortest paths until none is left.
    """
    n = len(gains)
    room: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, g in enumerate(gains):
        a, b = (n, i) if g >= 0 else (i, n + 1)
        room[a][b] = abs(g)
        room[b].setdefault(a, 0.0)
    for (i, j), c in edges.items():
        room[i][j] = room[i].get(j, 0.0) + c
        room[j][i] = room[j].get(i, 0.0) + c
    while True:
        came = {n: n}
        queue = deque([n])
        while queue and n + 1 not in came:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if n + 1 not in came:
            return [i in came for i in range(n)]
        path, j = [], n + 1
        while j != n:
            path.append((came[j], j))
            j = came[j]
        most = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= most
            room[j][i] += most


def main_text(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """Content blocks of a page, one a line."""
    found = blocks(page or "")
    if not found:
        return ""
    gains = [_score(text, share, node, weights) for text, share, node in found]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (_, _, node) in enumerate(found):
        if i:
            pull = max(NEXT, NEXT + SIBLING - DEEPER * _levels_apart(found[i - 1][2], node))
            edges[(i - 1, i)] = pull * (1.0 if found[i - 1][2].mode == node.mode else ACROSS)
        around = node.parent.number if node.parent else 0
        j = last.get(around)
        if j is not None and j != i - 1:
            edges[(j, i)] = edges.get((j, i), 0.0) + SIBLING * (1.0 if found[j][2].mode == node.mode else ACROSS)
        last[around] = i
    kept = min_cut(gains, edges)
    return "\n".join(text for (text, _, _), keep in zip(found, kept) if keep)


def extract_text(pages: DataFrame, html_column: str = "html", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``pages`` with text and n_chars (its code points) in place of the html.

    A page is cut into blocks at block elements; scripts, styles, comments in the markup, hidden elements, buttons and the head are no
    text. A linear classifier gives each block a gain for content, which becomes its capacity to a terminal; neighbours in the page and in the
    element tree are tied by edges; the minimum cut labels the blocks. White space in a block is one space, character references are
    decoded, blocks are joined by line feeds. A null, empty or all-boilerplate page gives an empty string. Repeated rows give repeated
    results; columns named like a result are replaced. A page is one task's work, in time that grows with its blocks.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(lambda page: main_text(page, weights) if isinstance(page, str) else "")

    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    out = pages.select(*kept, text_of(F.col(html_column)).alias("text"))
    return out.select(*kept, "text", F.char_length("text").cast("long").alias("n_chars"))
