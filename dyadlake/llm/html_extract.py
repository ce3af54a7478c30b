"""Main-text extraction by minimum-cut labelling.

A page becomes text blocks. A logistic classifier over what a block says (length, link share, punctuation, heading or list item, its neighbours'
lengths) and fixed evidence of the elements around it (their names, classes, ids and roles) give its cost as content or
boilerplate: the capacities from the source and to the sink. Neighbouring blocks, and blocks near in the element tree, are joined by smoothness
edges. The minimum cut labels all blocks at once; those on the source's side are the main text. Every block is a node of its own. Nodes of at most
two edges, and those that outweigh all their edges, are solved exactly and taken out one by one, which leaves nothing of chains and
nested siblings and takes linear time; maximum flow cuts what remains.

The classifier learns from blocks whose enclosing elements name their part (article or main; nav, footer and the like), and sees nothing of
those elements itself: what it learns of texts holds for pages that name nothing. It is fitted to at most ``SAMPLE`` pages, the first by a hash of their
HTML, and at most ``PER_PAGE`` blocks of each, with a ridge towards fixed starting weights, so it is defined even without any such page.
Pages are handled one by one in a map, whole and without a shuffle, in time that grows with their length.

Of a class, id or role of several words (``site-footer``, ``comment-list``) the last word counts, or the first where only words for containers follow;
classes of html and body say nothing. A tag's end is the first ``>`` outside quotes; where a quote is never closed, it and all after it count as plain characters.

Defined results: null and blockless pages have the empty text, length 0; repeated rows get the same result each; an empty table gives an empty one;
columns of the input named text or n_chars are replaced; scripts, styles, comments, form controls and the
head are never text; character references are decoded, a block's white space becomes one space, blocks are joined by a line feed.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

SAMPLE, PER_PAGE = 500, 64
SMOOTH = 0.7

_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?]|/(?![a-zA-Z]))|(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*))")
_PLAIN = re.compile(r"[^\"'>]*")
_ATTR = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
#: Elements, and the words of classes, ids and roles.
_RAW = frozenset("script style noscript template svg iframe object textarea select button canvas title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption".split())
_VOID = frozenset(["hr"])
_LINKABLE = frozenset("div h1 h2 h3 h4 h5 h6 figure".split())
_AGAINST_TAGS = frozenset("nav footer aside form menu dialog dir head".split())
_FOR_TAGS = frozenset("article main".split())
_AGAINST = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments respond reply replies disqus consent contentinfo cookie cookies copyright disclaimer footer form header legal login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related rss search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split())
_FOR = frozenset("article content entry main post story text".split())
_CONTAINERS = frozenset("area bar block body bottom box button buttons center column container content contents form group holder inner item items left link links list main outer panel posts right row section slot space text thread title top unit widget wrap wrapper zone".split())
#: Starting weights: bias, length, link share, punctuation, heading, list item, length of the block before and of the one after.
START = np.array([-0.7, 1.2, -3.0, 1.0, 0.8, -0.8, 0.1, 0.1])
#: What elements that speak against and for content add to the classifier's logit, which is held within ``MOST``.
AGAINST, INSIDE, MOST = -6.0, 4.0, 3.0


class Block:
    __slots__ = ("against", "favour", "links", "parent", "path", "tag", "text", "words")

    def __init__(self, text: str, links: int, tag: str, parent: int, path: tuple, against: bool, favour: bool):
        self.text, self.links, self.tag, self.parent, self.path, self.against, self.favour = text, links, tag, parent, path, against, favour
        self.words = text.count(" ") + 1


def speaks_against(words: list[str]) -> bool:
    """Whether a class, id or role of these words names boilerplate."""
    if not words:
        return False
    if words[-1] in _AGAINST:
        return words[-1] != "header" or _FOR.isdisjoint(words)  # an article's own header has its title
    return words[0] in _AGAINST and all(w in _CONTAINERS for w in words[1:])


def evidence(attributes: str) -> tuple[bool, bool]:
    """Whether the classes, ids and roles of an element speak against and for content."""
    names = [[w.lower() for w in _NAME.findall(n)] for a in _ATTR.findall(attributes) for n in "".join(a).split()]
    return any(map(speaks_against, names)), any(n and (n[-1] in _FOR or n[0] in _FOR and n[-1] in _CONTAINERS) for n in names)


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Begin, end, slash, tag and attributes of every tag; comments, declarations and elements without text have no tag."""
    at, closed, never = 0, True, set()
    last = page.rfind(">")
    while m := _OPEN.search(page, at):
        begin, at = m.start(), m.end()
        if m["comment"]:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            yield begin, at, "", "", ""
            continue
        if at > last:  # no tag can end any more
            if not m["tag"]:
                yield begin, len(page), "", "", ""
                return
            continue
        if m["other"]:
            at = page.find(">", at) + 1
            yield begin, at, "", "", ""
            continue
        end = at
        while closed:
            end = _PLAIN.match(page, end).end()
            if end < len(page) and page[end] == ">":
                break
            end = page.find(page[end], end + 1) + 1 if end < len(page) else 0
            closed = end > 0
        if not closed:
            end = page.find(">", at)
        attributes, at = page[at:end], end + 1
        tag = m["tag"].lower()
        if tag in _RAW and not m["close"] and tag not in never:
            stop = _STOPS[tag].search(page, at)
            if stop:
                at = stop.end()
                yield begin, at, "", "", ""
                continue
            never.add(tag)
            if tag in ("script", "style"):  # never text, closed or not
                yield begin, len(page), "", "", ""
                return
        yield begin, at, m["close"], tag, attributes


_STOPS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _RAW}


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    # an open element: tag, number, its place in the tree (depth, the place above), whether any of the open ones speaks against or for
    stack: list[tuple[str, int, tuple, bool, bool]] = [("", 0, (0, None), False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    number = links = linked = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(_html.unescape("".join(parts)).split()) if parts else ""
        if text:
            tag, own, path, against, favour = stack[-1]
            if tag in _LEAF and len(stack) > 1:
                _, own, path, _, _ = stack[-2]
            out.append(Block(text, links, tag, own, path, against, favour))
        parts.clear()
        links = 0

    def say(s: str) -> None:
        nonlocal links
        parts.append(s)
        if linked:
            links += len(s)

    def shut(k: int) -> None:
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]

    for begin, end, close, tag, attributes in tokens(page):
        if begin > at:
            say(page[at:begin])
        at = end
        if tag == "a":
            linked = 0 if close else 1
        elif tag == "br":
            say(" ")
        elif tag in _BLOCK:
            flush()
            if close or tag not in _LINKABLE:
                linked = 0  # a link that was never closed
            if close:
                if opened[tag] > 0:
                    shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                continue
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in _LEAF):
                shut(len(stack) - 1)
            if tag in _VOID or attributes.endswith("/"):
                continue
            number += 1
            _, _, path, against, favour = stack[-1]
            said = evidence(attributes) if attributes and tag not in ("html", "body") else (False, False)
            against = against or tag in _AGAINST_TAGS or (tag == "header" and not favour) or said[0]
            favour = favour or tag in _FOR_TAGS or said[1]
            stack.append((tag, number, (path[0] + 1, path), against, favour))
            opened[tag] += 1
    if at < len(page):
        say(page[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees: of each block's text, and of its neighbours'."""
    size = [math.log1p(b.words) / 3 for b in found]
    rows = []
    for k, b in enumerate(found):
        stops = b.text.count(".") + b.text.count("!") + b.text.count("?") + b.text.count(",") + b.text.count("。")
        rows.append((1.0, size[k], min(1.0, b.links / max(1, len(b.text))), min(1.0, 5 * stops / b.words), float(b.tag in ("h1", "h2", "h3")), float(b.tag == "li"), size[k - 1] if k else 0.0, size[k + 1] if k + 1 < len(size) else 0.0))
    return np.array(rows)


def costs(found: list[Block], weights: np.ndarray) -> list[float]:
    """What content is worth for each block, beyond boilerplate: the classifier's logit and what the elements around it say."""
    markup = [AGAINST if b.against else INSIDE if b.favour else 0.0 for b in found]
    return (np.clip(features(found) @ weights, -MOST, MOST) + markup).tolist()


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source (content), by maximum flow over blocking flows. score: positive for content."""
    n = len(score)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(score):
        if s > 0:
            link(source, i, s, 0.0)
        elif s < 0:
            link(i, sink, -s, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
            while nexts[u] < len(out[u]) and not (room[out[u][nexts[u]]] > 1e-9 and level[to[out[u][nexts[u]]]] == level[u] + 1):
                nexts[u] += 1
            if nexts[u] < len(out[u]):
                path.append(out[u][nexts[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                level[u] = -2
                u = to[path.pop() ^ 1]


def steps(p: tuple, q: tuple) -> int:
    """How far apart two places in the tree are."""
    n = 0
    while p is not q:
        if p[0] >= q[0]:
            p = p[1]
        else:
            q = q[1]
        n += 1
    return n


def reduced_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """``min_cut`` of the same graph. A node of at most two edges goes into what its best label costs for either label of its neighbours."""
    s = list(score)
    near: list[dict[int, float]] = [{} for _ in s]
    for a, b, c in edges:
        near[a][b] = near[b][a] = near[a].get(b, 0.0) + c
    gone = [False] * len(s)
    order: list[int] = []
    queue = deque(range(len(s)))
    while queue:
        i = queue.popleft()
        own = near[i]
        if gone[i] or len(own) > 2 and abs(s[i]) <= sum(own.values()):
            continue
        gone[i] = True
        order.append(i)
        for a in own:
            del near[a][i]
            queue.append(a)
        if len(own) == 1:
            ((a, c),) = own.items()
            s[a] += min(0.0, c - s[i]) - min(c, -s[i])
        elif len(own) == 2:
            (a, c), (b, d) = own.items()
            none, only_a, only_b, both = min(0.0, c + d - s[i]), min(c, d - s[i]), min(d, c - s[i]), min(c + d, -s[i])
            joint = max(0.0, (only_a + only_b - none - both) / 2)
            s[a] -= only_a - none - joint
            s[b] -= only_b - none - joint
            if joint > 1e-12:
                near[a][b] = near[b][a] = near[a].get(b, 0.0) + joint
        else:  # it outweighs its edges
            for a, c in own.items():
                s[a] += c if s[i] > 0 else -c
    content = [False] * len(s)
    rest = [i for i in range(len(s)) if not gone[i]]
    number = {i: k for k, i in enumerate(rest)}
    if rest:
        for i, keep in zip(rest, min_cut([s[i] for i in rest], [(number[i], number[a], c) for i in rest for a, c in near[i].items() if i < a]), strict=True):
            content[i] = keep
    for i in reversed(order):
        content[i] = s[i] + sum(c if content[a] else -c for a, c in near[i].items()) > 1e-9
    return content


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are main text."""
    if not found:
        return []
    edges = []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, SMOOTH / (1 + steps(found[k - 1].path, b.path))))
        if b.parent in last and last[b.parent] < k - 1:
            edges.append((last[b.parent], k, SMOOTH))
        last[b.parent] = k
    return reduced_cut(costs(found, weights), edges)


def extract(page: str | None, weights: np.ndarray) -> str:
    """The main text of a page."""
    found = blocks(page) if page else []
    return "\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights with a ridge towards ``START``, by Newton's method."""
    w = START.copy()
    if not len(y):
        return w
    ridge = 0.02 * len(y)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * (w - START))
    return w


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from the blocks of at most ``sample`` pages whose elements name their part."""
    chosen = pages.select(F.col(html).alias("html")).where("html is not null")
    chosen = S.sample_by_hash(chosen, "html", sample).distinct()

    def work():
        def f(texts: list) -> list[list]:
            out = []
            for t in texts:
                found = blocks(t or "")
                named = [k for k, b in enumerate(found) if b.against or b.favour]
                named = named[:: -(-len(named) // PER_PAGE) or 1]
                x = features(found)
                out.append([",".join(map(str, [*x[k].tolist(), float(not found[k].against)])) for k in named])
            return [out]

        return f

    rows = S.add_columns(chosen, "html", {"x": "array<string>"}, work, []).select(F.explode("x").alias("x")).collect()
    values = np.array([[float(v) for v in r.x.split(",")] for r in rows]).reshape(-1, len(START) + 1)
    return fit(values[:, :-1], values[:, -1])


def main_text(pages: DataFrame, weights: np.ndarray, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and text, n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def work():
        def f(texts: list) -> list[list]:
            out = [extract(t, sent.value) for t in texts]
            return [out, [len(t) for t in out]]

        return f

    return S.add_columns(pages, html, {"text": "string", "n_chars": "long"}, work, keep)
