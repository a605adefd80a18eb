"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks of text. A classifier gives each block costs for
being content or boilerplate, which become capacities to the two terminals;
neighbouring blocks and blocks that are close in the DOM are tied by
smoothness edges. The minimum cut labels all blocks of a page at once.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import spread, text_or_empty

# Element names of HTML.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template title textarea select iframe svg".split())
SECTIONS = set("article section div main nav aside footer header form".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements that may be open at once; deeper ones are read as part of the deepest, as browsers do.
DEPTH = 512

# The classifier: log odds of being content. What surrounds a block adds up to
# a bounded sum, so no single name outweighs the block's own text and its neighbours.
TAG_ODDS = {"nav": -3.8, "footer": -3.8, "aside": -4.2, "form": -3.8, "button": -3.8, "menu": -3.8, "dialog": -3.8, "fieldset": -2.5, "search": -3.8, "header": -2.5, "article": 0.8, "main": 0.6}
NOISE_ODDS, MIXED_ODDS, COMMENT_ODDS, BODY_ODDS, HIDDEN_ODDS = -3.8, -1.0, -4.2, 0.8, -4.2
LEAST_NAME_ODDS, LEAST_ODDS, MOST_ODDS = -4.2, -5.0, 1.6
OWN_TAG_ODDS = {"h1": 0.9, "h2": 0.6, "h3": 0.6, "p": 0.3, "pre": 0.3, "blockquote": 0.4, "figcaption": 0.4, "li": 1.0, "dt": 1.0, "dd": 1.0, "td": 0.8, "th": 0.8, "caption": 0.6}
LENGTH_ODDS, LONG_TEXT, SHORT_ODDS = 3.0, 220, -1.1
LINK_ODDS, SENTENCE_ODDS, PHRASE_ODDS, EDGE_OF_PAGE_ODDS = -4.0, 0.4, -0.8, -0.2
# Capacity between neighbours of one section at no distance in the DOM, between
# neighbours of two sections, and between blocks of a section that are not neighbours.
SAME_SECTION, OTHER_SECTION, NEXT_OF_SECTION = 2.2, 0.25, 0.4

NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|sidebar|side-bar|rail|widget\w*|menu\w*|nav\w*|navbar|breadcrumb\w*|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|trending|popular|tags|toc|pagination|pager|skip\w*|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus\w*|replies|reply|respond|discussion)(?:$|[\s_-])", re.I)
BODY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main|body|text|prose)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PHRASE = re.compile(r"©|all rights reserved|cookies?\b|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign in|log in", re.I)
SENTENCE = re.compile(r"[.!?…。！？][\"'»”)]?$")

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*)|=)(?:\s*=\s*)?")
HAS_VALUE = re.compile(r"=\s*$")
BARE = re.compile(r"[^\s>]+")
SPACES = re.compile(r"\s+")
LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


@dataclass
class Block:
    text: str
    odds: float
    section: int
    #: Steps in the DOM from the block before.
    distance: int
    links: int = 0
    tag: str = "body"


@dataclass
class _Node:
    tag: str
    section: int
    odds: float
    in_article: bool
    link: bool = False


class Scanner:
    """Tags and text of a page, each character seen a bounded number of times whatever the page."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.quotes = {'"': -1, "'": -1}

    def next_quote(self, quote: str, at: int) -> int:
        """The first such quote from `at` on, or the page's length; places are asked for in ascending order."""
        if self.quotes[quote] < at:
            p = self.page.find(quote, at)
            self.quotes[quote] = self.n if p < 0 else p
        return self.quotes[quote]

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from a tag's name on, whether it closes itself, and where the tag ends.

        A quote that ends in the middle of a word, or nowhere, with a > within
        is taken as forgotten: the value ends at that >.
        """
        page, n, found = self.page, self.n, {}
        while at < n:
            m = ATTR.match(page, at)
            if m is None:
                end = page.find(">", at)
                return found, page[at:end].rstrip().endswith("/"), n if end < 0 else end + 1
            name, value, at = (m[1] or "").lower(), "", m.end()
            if m[1] and HAS_VALUE.search(m[0]) and at < n:
                if (quote := page[at]) in self.quotes:
                    end = self.next_quote(quote, at + 1)
                    after = page[end + 1 : end + 2]
                    if (end == n or after and after not in " \t\r\n\f/>") and (close := page.find(">", at, end)) >= 0:
                        found.setdefault(name, page[at + 1 : close])
                        return found, False, close + 1
                    value, at = page[at + 1 : end], min(end + 1, n)
                elif page[at] != ">":
                    b = BARE.match(page, at)
                    value, at = b[0], b.end()
            found.setdefault(name, value)
        return found, False, n

    def tokens(self):
        """(text, None, None) for text, (name, attributes, kind) for tags, kind being open, self or close."""
        page, n, at, start = self.page, self.n, 0, 0
        while (p := page.find("<", at)) >= 0:
            nxt = page[p + 1 : p + 2]
            close = nxt == "/"
            name = NAME.match(page, p + 1 + close)
            if name is None:
                if page.startswith("<!--", p):
                    end = page.find("-->", p + 4)
                    end = n if end < 0 else end + 3
                elif nxt and nxt in "!?/":
                    end = page.find(">", p)
                    end = n if end < 0 else end + 1
                else:
                    at = p + 1  # a mere < in the text
                    continue
                if p > start:
                    yield page[start:p], None, None
                at = start = end
                continue
            if p > start:
                yield page[start:p], None, None
            attrs, closed, at = self.attributes(name.end())
            tag = name[0].lower()
            yield tag, attrs, "close" if close else "self" if closed else "open"
            if tag in RAW and not close and not closed:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = n if stop < 0 else stop + 1
            start = at
        if n > start:
            yield page[start:], None, None


def _odds_of(tag: str, attrs: dict[str, str], parent: _Node) -> float:
    """Log odds that an element adds to those around it."""
    odds = TAG_ODDS.get(tag, 0.0)
    if tag == "header" and parent.in_article:
        odds = 0.0
    if attrs:
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".split() if tag not in ("html", "body") else []
        of_names = 0.0
        for name in names:
            if COMMENT.search(name):
                of_names += COMMENT_ODDS
            elif NOISE.search(name):
                of_names += MIXED_ODDS if BODY.search(name) or tag in ("article", "main") else NOISE_ODDS
            elif BODY.search(name) and tag not in ("p", "span", "a"):
                of_names += BODY_ODDS
        odds += min(max(of_names, LEAST_NAME_ODDS), BODY_ODDS)
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
            odds += HIDDEN_ODDS
    return odds


def _number(m: re.Match) -> str:
    """A numeric reference without its leading zeros; beyond Unicode it is the replacement character."""
    body = m[0][2:].rstrip(";").lower()
    digits = body.lstrip("x").lstrip("0") or "0"
    return "\ufffd" if len(digits) > 7 else f"&#{'x' * body.startswith('x')}{digits};"


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order: maximal runs of inline text between block-level tags."""
    stack, made, out = [_Node("#root", 0, 0.0, False)], 0, []
    opened, swallowed = Counter(), Counter()
    text: list[str] = []
    links, in_link = 0, 0
    last, low = 0, 1  # depth of the block before, and the least depth since

    def flush():
        nonlocal text, links, last, low
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = html_lib.unescape(LONG_NUMBER.sub(_number, joined))
            clean = SPACES.sub(" ", joined).strip()
            if clean:
                depth = len(stack)
                while depth > 1 and stack[depth - 1].tag not in BLOCKS:
                    depth -= 1
                top = stack[depth - 1]
                low = min(low, depth)
                out.append(Block(clean, top.odds, top.section, last - low + depth - low, min(links, len(clean)), top.tag))
                last = low = depth
        text, links = [], 0

    def pop_to(k: int):
        nonlocal in_link, low
        while len(stack) > k:
            node = stack.pop()
            opened[node.tag] -= 1
            in_link -= node.link
        low = min(low, k)

    for token, attrs, kind in Scanner(page).tokens():
        if kind is None:
            text.append(token)
            if in_link:
                links += len(token.strip())
            continue
        tag = token
        if tag in RAW:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if kind == "close":
            if swallowed[tag]:
                swallowed[tag] -= 1
            elif opened[tag]:
                pop_to(max(k for k in range(1, len(stack)) if stack[k].tag == tag))
            continue
        if tag in VOID or kind == "self" and tag not in BLOCKS:
            continue
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            stop, at = SCOPES.get(tag, BLOCKS), None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    at = k
                elif stack[k].tag in stop:
                    break
            if at is not None:
                pop_to(at)
        elif tag in BLOCKS and opened["p"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in BLOCKS), 0)
            if stack[k].tag == "p":
                pop_to(k)
        if len(stack) >= DEPTH:
            swallowed[tag] += 1
            continue
        parent = stack[-1]
        made += tag in SECTIONS
        odds = min(max(parent.odds + _odds_of(tag, attrs, parent), LEAST_ODDS), MOST_ODDS)
        node = _Node(tag, made if tag in SECTIONS else parent.section, odds, parent.in_article or tag in ("article", "main"), tag == "a")
        in_link += node.link
        opened[tag] += 1
        stack.append(node)
    flush()
    return out


def block_costs(blocks: list[Block]) -> list[float]:
    """Log odds of content: those of the elements around a block, and of its own length, links, ending, tag, wording and place."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        odds = b.odds + SHORT_ODDS + LENGTH_ODDS * min(n / LONG_TEXT, 1.0) + OWN_TAG_ODDS.get(b.tag, 0.0)
        odds += LINK_ODDS * max(b.links / n - 0.2, 0.0) / 0.8
        odds += SENTENCE_ODDS if SENTENCE.search(b.text[-3:]) else 0.0
        odds += PHRASE_ODDS if n < LONG_TEXT and PHRASE.search(b.text) else 0.0
        odds += EDGE_OF_PAGE_ODDS if len(blocks) > 4 and i in (0, len(blocks) - 1) else 0.0
        out.append(odds)
    return out


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, the stronger the closer they are in the DOM, and between successive blocks of a section."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SAME_SECTION / (1 + b.distance / 2) if blocks[i - 1].section == b.section else OTHER_SECTION))
        j = last.get(b.section)
        if j is not None and j < i - 1:
            edges.append((j, i, NEXT_OF_SECTION))
        last[b.section] = i
    return edges


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of a minimum cut; where several are minimal, the one with the fewest content blocks.

    Costs are the capacities from the source (content) or to the sink, edges
    have theirs both ways, all in thousandths, so that flows are exact. Pieces
    of the graph whose costs are all of one sign need no flow.
    """
    n = len(costs)
    cost, near = [round(1000 * c) for c in costs], [dict() for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[b][a] = near[a].get(b, 0) + round(1000 * w)
    label, seen = [False] * n, [False] * n
    for i in range(n):
        if not seen[i]:
            piece, seen[i] = [i], True
            for j in piece:
                for k in near[j]:
                    if not seen[k]:
                        seen[k] = True
                        piece.append(k)
            if any(cost[j] > 0 for j in piece):
                for j in _content_side(piece, cost, near):
                    label[j] = True
    return label


def _content_side(nodes: list[int], cost: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes on the source's side of a minimum cut of one piece: blocking flows along shortest paths, then what is still reached."""
    left = {i: dict(near[i]) for i in nodes}
    source, sink = {i: max(cost[i], 0) for i in nodes}, {i: max(-cost[i], 0) for i in nodes}
    while True:
        level = {i: 0 for i in nodes if source[i]}
        queue, found = deque(level), None
        while queue:
            i = queue.popleft()
            if found is not None and level[i] > found:
                break
            if sink[i]:
                found = level[i]
            for j, w in left[i].items():
                if w and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if found is None:
            return set(level)
        arcs = {i: iter(list(left[i])) for i in level}
        for s in [i for i in level if source[i]]:
            path = [s]
            while path and source[s]:
                i = path[-1]
                if sink[i]:
                    flow = min(sink[i], source[s], *(left[a][b] for a, b in zip(path, path[1:])))
                    sink[i] -= flow
                    source[s] -= flow
                    for a, b in zip(path, path[1:]):
                        left[a][b] -= flow
                        left[b][a] += flow
                    if len(path) > 1:
                        cut = next((k for k, (a, b) in enumerate(zip(path, path[1:])) if not left[a][b]), None)
                        path = path[: cut + 1] if cut is not None else path
                    continue
                step = next((j for j in arcs[i] if left[i][j] and level.get(j) == level[i] + 1), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by an empty line; empty where there are none."""
    blocks = blocks_of(page or "")
    keep = min_cut(block_costs(blocks), smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_main_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null html counts as empty and gives an empty text; null keys and urls
    stay null; repeated rows give repeated results; no rows give none.
    Map-only, one page at a time, whole pages.
    """

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [main_text(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = spread(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_or_empty(html).alias("html")))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
