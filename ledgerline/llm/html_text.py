"""Operator 6: main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier's log-odds of being content are the capacity of a
block's edge to the source (content) or the sink (boilerplate). Blocks that follow each other, and blocks
of one parent element, are joined by smoothness edges that are stronger the deeper their common ancestor
is. The maximum flow separates the page; the blocks on the source's side are the text.

The log-odds add what marking says (semantic elements, class and id words: fixed values below), at most
MARK an element and half as much for each element further out, to a logistic model of the text itself,
MODEL at most. Both are of the size of the smoothness edges, so a block whose own evidence is weak goes with its
neighbours. An ``article`` or ``main`` shields its blocks from what stands around it, and a form that holds most of
a page's text says nothing. The model is trained on the blocks of at most SAMPLE pages (the smallest hashes of
their ids; the only sample taken) that marking labels clearly; with few of them it stays at PRIOR.

Cases: a null or empty page, and one without content, gives an empty text; a page cut off anywhere is
read to its end; an unclosed comment, script or style runs to the end; very long and deeply nested pages
take time in proportion to their length; repeated rows give repeated rows; ties of a cut go to boilerplate;
extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import map_batches, sample_texts, table

SAMPLE = 300
#: Bounds of an element's marking and of the model; what an element says beside an article elsewhere on the page;
#: weights of smoothness edges, and the scale to whole numbers.
MARK, MODEL, BESIDE, FOLLOWS, TOGETHER, SCALE = 3.0, 2.5, -1.0, 1.5, 0.6, 100
#: Log-odds of a semantic element, of boilerplate words and of content words of an element.
SEMANTIC, OUT_WORD, IN_WORD = 2.5, -3.0, 2.0
#: The model before training: bias, words, links, closing mark, marks inside, heading, neighbours' words and links.
PRIOR = np.array([-2.0, 0.6, -4.0, 0.8, 0.4, 1.0, 0.3, -1.0])
# Element names and class/id words.
_RAW = "script style noscript template iframe textarea select head title".split()
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OUT = set("nav footer aside form menu button dialog fieldset label".split())
_IN = set("article main".split())
_OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent copyright adbox adslot adsense adunit alert disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related recommendations replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar trending widget widgets".split()
)
_IN_WORDS = set("article articlebody body content entry main maincontent post story text".split())
#: A name that begins or ends so says something about its element, not what it is.
_ABOUT = set("has with without no is js tag category type status format".split())
_STATE = set("open closed enabled disabled active allowed visible left right on off".split())
#: A name with one of these is a layout's.
_LAYOUT = set("wrap wrapper wrapped container layout grid outer".split())
_LISTED = set("li dt dd tr td th option".split())
_HEADINGS = ("h1", "h2", "h3")
# End of fixed values.
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")


class Block:
    """A text with how much of it is linked, its parent's number, its depth, the depth it shares with the block before, and its evidence."""

    __slots__ = ("text", "links", "parent", "depth", "common", "evidence", "inside", "heading")

    def __init__(self, text: str, links: int, parent: int, depth: int, common: int, evidence: float, inside: bool, heading: bool) -> None:
        self.text, self.links, self.parent, self.depth, self.common, self.evidence, self.inside, self.heading = text, links, parent, depth, common, evidence, inside, heading


def marking(tag: str, rest: str, inside: bool) -> float:
    """Log-odds that an element's name and its class, id and role words say, within MARK."""
    out = tag in _OUT or tag == "header" and not inside
    said = -MARK if out else SEMANTIC if tag in _IN else 0.0
    if rest and tag not in ("html", "body"):
        if "hidden" in rest.lower().split():
            return -MARK
        for m in _ATTRIBUTE.finditer(rest):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = [w.lower() for w in _WORD.findall(name)]
                if not words or words[0] in _ABOUT or len(words) > 1 and words[-1] in _STATE or not _LAYOUT.isdisjoint(words):
                    continue
                if any(w in _OUT_WORDS or w == "header" and not inside for w in words):
                    said += OUT_WORD
                elif any(w in _IN_WORDS for w in words):
                    said += IN_WORD
    return max(-MARK, min(MARK, said))


class _Reader:
    """One pass over a page; every step takes time in proportion to what it reads or closes."""

    def __init__(self, page: str) -> None:
        self.page, self.blocks = page, []
        # Open elements: tag, number, evidence with and without forms, whether in an article, form.
        self.stack: list[tuple[str, int, float, float, bool, int]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # open places by tag
        self.blocks_at: list[int] = []  # places of open block elements
        self.parts: list[str] = []
        self.links = self.number = self.in_link = self.low = 0
        self.forms: list[tuple[Block, int, float]] = []
        self.chars: defaultdict[int, int] = defaultdict(int)

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.in_link:
                self.links += len(text)

    def flush(self) -> None:
        if self.parts and (text := " ".join(html.unescape("".join(self.parts)).split())):
            _, _, evidence, plain, inside, form = self.stack[-1] if self.stack else ("", 0, 0.0, 0.0, False, 0)
            at = self.blocks_at
            block = Block(text, min(self.links, len(text)), self.stack[at[-2]][1] if len(at) > 1 else 0, len(at), min(self.low, len(at)), evidence, inside, any(x[0] in _HEADINGS for x in self.stack[-3:]))
            self.blocks.append(block)
            self.chars[form] += len(text)
            if form:
                self.forms.append((block, form, plain))
            self.low = len(at)
        self.parts, self.links = [], 0

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if self.blocks_at and self.blocks_at[-1] == len(self.stack):
                self.blocks_at.pop()
            self.in_link -= tag == "a"
        self.low = min(self.low, len(self.blocks_at))

    def open(self, tag: str, rest: str) -> None:
        if tag in _BLOCK and self.blocks_at:
            # What the new element ends by itself: an open paragraph, or an item of the same kind.
            top = self.stack[self.blocks_at[-1]][0]
            if top == "p" or top == tag and tag in _LISTED:
                self.close(self.blocks_at[-1])
        self.number += 1
        _, _, evidence, plain, inside, form = self.stack[-1] if self.stack else ("", 0, 0.0, 0.0, False, 0)
        said = marking(tag, rest, inside)
        if tag in _IN and said >= 0:
            evidence = plain = said
            inside = True
        elif said:
            evidence = said + evidence / 2
            if tag != "form":
                plain = said + plain / 2
        if tag == "form" and not form:
            form = self.number
        if tag in _BLOCK:
            self.blocks_at.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, self.number, evidence, plain, inside, form))
        self.in_link += tag == "a"

    def end(self, tag: str) -> None:
        if self.places[tag] and (tag in _BLOCK or not self.blocks_at or self.places[tag][-1] > self.blocks_at[-1]):
            self.close(self.places[tag][-1])

    def read(self) -> list[Block]:
        page, at, text_from, last = self.page, 0, 0, self.page.rfind(">")
        quotes, unclosed = True, set()
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                self.add(page[text_from:at])
                end = page.find("-->", at + 4)
                at = text_from = len(page) if end < 0 else end + 3
                continue
            if m := _NAME.match(page, at):
                if at > last:  # a tag that is cut off
                    self.add(page[text_from:at])
                    text_from = len(page)
                    break
                whole = _QUOTED.match(page, m.end()) if quotes else None
                if whole is None:
                    quotes = False  # a quote is open to the page's end: from here on a tag ends at its first >
                    stop = page.find(">", m.end()) + 1
                else:
                    stop = whole.end()
                rest = page[m.end() : stop - 1]
            elif page.startswith(("<!", "<?"), at):
                stop = page.find(">", at) + 1
                if not stop:
                    self.add(page[text_from:at])
                    text_from = len(page)
                    break
                rest = ""
            else:
                at += 2 if page.startswith("</", at) and not last > at else 1
                continue
            self.add(page[text_from:at])
            at = text_from = stop
            if not m:
                continue
            tag = m[2].lower()
            if tag in _RAW and not m[1] and not rest.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end is None:
                    unclosed.add(tag)
                if end is not None or tag not in ("head", "select"):
                    at = text_from = len(page) if end is None else end.end()
                continue
            if tag == "br":
                self.add(" ")
            if tag in _BLOCK:
                self.flush()
            if m[1]:
                self.end(tag)
            elif tag not in _VOID and not rest.endswith("/"):
                self.open(tag, rest)
        self.add(page[text_from:])
        self.flush()
        for block, form, plain in self.forms:
            if 2 * self.chars[form] > sum(self.chars.values()):
                block.evidence = plain
        return self.blocks


def parse(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    return _Reader(page or "").read()


def features(blocks: list[Block]) -> np.ndarray:
    """What the text itself says; the marking isn't among it."""
    words = [min(8.0, np.log1p(b.text.count(" ") + 1)) for b in blocks]
    links = [b.links / len(b.text) for b in blocks]
    around = lambda x, k: (x[k - 1] if k else 0.0) + (x[k + 1] if k + 1 < len(x) else 0.0)
    rows = [(1.0, words[k], links[k], float(b.text[-1] in ".!?…"), min(2.0, (b.text.count(".") + b.text.count(",")) / 5), float(b.heading), around(words, k) / 4, around(links, k) / 2) for k, b in enumerate(blocks)]
    return np.array(rows, np.float64).reshape(len(rows), len(PRIOR))


def train(pages: list[str]) -> np.ndarray:
    """Weights of a logistic regression held to PRIOR, from blocks that marking labels clearly."""
    xs, ys = [], []
    for page in pages:
        blocks = parse(page)
        said = np.array([b.evidence for b in blocks])
        known = abs(said) >= 2
        if known.any():
            xs.append(features(blocks)[known])
            ys.append((said[known] > 0).astype(float))
    w = PRIOR.copy()
    if not xs or not 0 < (y := np.concatenate(ys)).sum() < len(y):
        return w
    x = np.concatenate(xs)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both kinds count alike
    hold = 10 + 0.02 * len(y)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - hold * (w - PRIOR))
    return w


def _settle(gain: list[int], edges: list[tuple[int, int, int]]) -> tuple[list[bool | None], list[int]]:
    """Labels of nodes whose gain outweighs all of their edges, one after the other, and the gains that this leaves.

    Such a node has its own label in every best labelling; its edges then pull its neighbours.
    """
    near: list[list[tuple[int, int]]] = [[] for _ in gain]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    pull = [sum(c for _, c in x) for x in near]
    label: list[bool | None] = [None] * len(gain)
    gain, todo = list(gain), deque(range(len(gain)))
    while todo:
        a = todo.popleft()
        if label[a] is not None or abs(gain[a]) <= pull[a] and pull[a]:
            continue
        label[a] = gain[a] > 0
        for b, c in near[a]:
            if label[b] is None:
                gain[b] += c if label[a] else -c
                pull[b] -= c
                todo.append(b)
    return label, gain


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels with the largest sum of gains of chosen nodes less the weights of cut edges (Dinic's flow).

    Nodes that settle by themselves become part of the terminals before the flow is sought.
    """
    label, left = _settle(gain, edges)
    open_ = [i for i, x in enumerate(label) if x is None]
    place = {i: k for k, i in enumerate(open_)}
    found = _flow([left[i] for i in open_], [(place[a], place[b], c) for a, b, c in edges if a in place and b in place])
    for i, x in zip(open_, found):
        label[i] = x
    return [bool(x) for x in label]


def _flow(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source's side of a minimum cut."""
    n = len(gain)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, forth: int, back: int) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, g in enumerate(gain):
        if g > 0:
            edge(s, i, g, 0)
        elif g < 0:
            edge(i, t, -g, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in graph[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                turn[to[path[-1] ^ 1]] += 1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, int(SCALE * FOLLOWS * min(1.0, b.common / max(1, blocks[i - 1].depth - 1, b.depth - 1))) + 1))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, int(SCALE * TOGETHER)))
        last[b.parent] = i
    return edges


def gains(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """Log-odds of each block, scaled."""
    odds = np.clip(features(blocks) @ weights, -MODEL, MODEL)
    beside = BESIDE if any(b.inside and b.evidence > 0 for b in blocks) else 0.0
    return [int(SCALE * (o + b.evidence + (0.0 if b.inside else beside))) for o, b in zip(odds.tolist(), blocks)]


def extract(page: str | None, weights: np.ndarray = PRIOR) -> str:
    blocks = parse(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, chosen in zip(blocks, minimum_cut(gains(blocks, weights), smoothness(blocks))) if chosen)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    weights = train(sample_texts(plain, "page_id", "html", SAMPLE))

    def each(page_id: list, url: list, page: list) -> dict:
        text = [extract(p, weights) for p in page]
        return {"page_id": page_id, "url": url, "text": text, "n_chars": list(map(len, text))}

    return map_batches(plain, each, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
