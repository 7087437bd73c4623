"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block the log-odds of being content; its two
losses become the capacities to the two terminals. Neighbours in the page and neighbours under one parent are joined by
smoothness edges. The minimum cut of that graph is the labelling of least total cost; blocks on the content side are
the text. Elements that can only be furniture by their tag (navigation, footers, controls, what is hidden ...) are not
left to the classifier: their capacity is larger than all smoothness edges of a block can be. Names (class, id, role) and
forms are evidence of finite weight. They say nothing on a heading, in a compound with has-, no- or with-, in an id of
which a part is another word (such ids are made from headings), or on an element that holds an article or, in a page
without one, more than ``MOST`` of the words.

Work is per page and pages are independent, so nothing is shuffled.

Defined cases: a null or empty html gives an empty text; markup that is cut off or wrongly nested is read as far as it
goes; rows with equal ids are read one by one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gradelake.llm import common as C

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")

SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
FURNITURE = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "fieldset", "head"}
BODY = {"article", "main"}
CLOSES_P = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "section", "article", "blockquote", "pre", "form", "nav", "aside", "header", "footer", "main", "figure", "dl"}

FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|sidebar|side|footer|foot|masthead|site-?header|page-?header|breadcrumbs?|cookies?|consent|gdpr|"
    r"notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|commentlist|disqus|respond|replies|reply|widget|toolbar|pagination|pager|legal|copyright|skip)(?:$|[\s_-])",
    re.I,
)
BODY_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|body|text|main)(?:$|[\s_-])", re.I)

#: Parts of an id that only tell the place or kind of a piece of furniture.
PLACE = re.compile(r"(?:site|page|top|bottom|left|right|main|primary|secondary|global|bar|box|list|links|container|wrapper|wrap|inner|area|block|section|panel|cookie|buttons?|form|slot|unit|posts?|articles?|\d*)", re.I)
#: Names that negate or only mention what they are compounded with.
MENTION = re.compile(r"(?:has|no|with|without|not|is|hide|show)[_-]", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element with more of the page's words than this is not furniture by its name.
MOST = 0.5

#: Weights of the classifier, in log-odds: what speaks for content.
WEIGHTS = {"bias": -1.0, "in_body": 4.0, "body_name": 2.0, "words": 0.08, "words_most": 2.0, "links": -4.0, "sentence": 0.7, "heading": 0.5, "furniture_name": -9.0}
CERTAIN = 40.0
ADJACENT = 0.5
SIBLING = 0.5


class Block:
    __slots__ = ("words", "text", "linked", "parent", "furniture", "body", "named", "heading", "suspects")


def furniture_name(tag: str, names: list[str], ids: list[str]) -> bool:
    """Whether a class, role or id names the element as furniture."""
    if tag in HEADINGS:
        return False
    if any(FURNITURE_NAME.search(n) and not MENTION.match(n) for n in names):
        return True
    return any(FURNITURE_NAME.search(n) and all(FURNITURE_NAME.search(p) or PLACE.fullmatch(p) for p in re.split("[_-]", n)) for n in ids)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    # an open element: tag, number, furniture, body, named as body, numbers of the elements around that may be furniture
    stack: list[tuple[str, int, bool, bool, bool, tuple[int, ...]]] = [("", 0, False, False, False, ())]
    holds: set[int] = set()
    parts: list[str] = []
    linked = 0
    links = 0
    number = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            words = html.unescape("".join(parts)).split()
            parts.clear()
            if words:
                b = Block()
                b.words, b.text, b.linked = len(words), " ".join(words), linked
                holder = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
                top = stack[-1]
                b.furniture, b.body, b.named, b.suspects = top[2], top[3], top[4], top[5]
                b.heading = holder[0] in HEADINGS
                at = stack.index(holder)
                b.parent = stack[at - 1][1] if at else 0
                out.append(b)
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.split())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in SKIPPED:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                over = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = over.end() if over else end
            if tag not in INLINE:
                flush()
            continue
        if tag in VOID:
            if tag == "br" or tag in INLINE:
                parts.append(" ")
            else:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    links -= sum(e[0] == "a" for e in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    links -= sum(e[0] == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        number += 1
        _, _, furniture, body, named, suspects = stack[-1]
        given = m[3] or m[6] or ""
        names, ids, hidden = "", "", False
        if given.strip(" /"):
            for name, x, y, z, alone in ATTRIBUTE.findall(given):
                value = x or y or z
                if name.lower() in ("class", "id", "role"):
                    names += f" {value}"
                    ids += f" {value}" if name.lower() == "id" else ""
                elif alone or name.lower() == "aria-hidden" and value == "true" or name.lower() == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
        is_body = tag in BODY or "main" in names.split()
        outer = tag == "header" and not body
        furniture = furniture or tag in FURNITURE or outer or hidden
        called = bool(names) and tag not in ("html", "body") and furniture_name(tag, [n for n in names.split() if n not in ids.split()], ids.split())
        if is_body and not called:
            holds.update(suspects)
        if tag == "form" or called and not is_body:
            suspects = (*suspects, number)
        stack.append((tag, number, furniture, body or is_body, named or bool(names and BODY_NAME.search(names)), suspects))
        links += tag == "a"
    flush()
    size: dict[int, int] = {}
    for b in out:
        for e in b.suspects:
            size[e] = size.get(e, 0) + b.words
    # an article outside leaves no doubt what the page is about, however long its comments are
    most = float("inf") if any(b.body for b in out) else MOST * sum(b.words for b in out)
    for b in out:
        b.suspects = tuple(e for e in b.suspects if e not in holds and size[e] <= most)
    return out


def log_odds(b: Block) -> float:
    if b.furniture:
        return -CERTAIN
    w = WEIGHTS
    odds = w["bias"] + w["furniture_name"] * bool(b.suspects) + w["in_body"] * b.body + w["body_name"] * b.named + min(w["words_most"], w["words"] * b.words)
    return odds + w["links"] * b.linked / b.words + w["sentence"] * (b.text[-1] in ".!?…\"'") + w["heading"] * b.heading


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source (content) side: Dinic's algorithm on what the terminals leave."""
    n = len(odds)
    # losses are log(1 + exp(-o)) and log(1 + exp(o)); the smaller passes straight through and the difference is abs(o)
    spare = [abs(o) for o in odds]
    to: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        to[a].append(len(head))
        head.append(b)
        room.append(forth)
        to[b].append(len(head))
        head.append(a)
        room.append(back)

    source, sink = n, n + 1
    for i, o in enumerate(odds):
        if o > 0:
            join(source, i, spare[i], 0.0)
        elif o < 0:
            join(i, sink, spare[i], 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in to[x]:
                y = head[e]
                if level[y] < 0 and room[e] > 1e-9:
                    level[y] = level[x] + 1
                    queue.append(y)
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                x = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[x] < len(to[x]):
                e = to[x][turn[x]]
                if room[e] > 1e-9 and level[head[e]] == level[x] + 1:
                    break
                turn[x] += 1
            if turn[x] < len(to[x]):
                path.append(to[x][turn[x]])
                x = head[path[-1]]
            elif path:
                level[x] = -1
                x = head[path.pop() ^ 1]
            else:
                break


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = edges.get((i - 1, i), 0.0) + ADJACENT
        if b.parent in last:
            edges[last[b.parent], i] = edges.get((last[b.parent], i), 0.0) + SIBLING
        last[b.parent] = i
    labels = minimum_cut([log_odds(b) for b in found], [(a, b, w) for (a, b), w in edges.items()])
    return "\n".join(b.text for b, content in zip(found, labels) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        counts = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), counts], [*batch.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kinds = ", ".join(f"{n} {t}" for n, t in pages.select("page_id", "url").dtypes)
    return C.map_texts(pages.select("html", "page_id", "url"), _extract, f"{kinds}, text string, n_chars bigint")
