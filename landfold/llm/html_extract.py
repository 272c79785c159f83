"""Main-text extraction by minimum-cut labelling of a page's blocks.

A block is the text between two block-level boundaries. A logistic classifier over what its ancestors are and are
called, its links and its words gives the cost of either label, which become capacities to the two terminals; blocks
that follow one another, and blocks near in the element tree, are tied by smoothness capacities. The minimum cut
separates article from boilerplate. The classifier is fitted to generated pages whose blocks are known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.html_samples import made_page

# Names of elements and of what their classes and ids tell.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "caption tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object math canvas audio video".split())
#: Of these the text runs to the page's end if they are not closed; the others are then taken as empty.
RAW_TO_END = frozenset("script style textarea title iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT = frozenset("nav footer aside menu dialog button select search option fieldset label".split())
IN = frozenset("article main".split())
QUOTES = HEADINGS | {"p", "blockquote", "q"}
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion promotions banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side widget "
    "widgets related recommend recommended recommendation recommendations share sharing social comment comments commentlist disqus "
    "replies reply respond discussion breadcrumb breadcrumbs menu nav navbar navigation footer copyright pager pagination login "
    "search toolbar skip disclaimer outbrain taboola".split()
)
#: Words that say nothing by themselves: a name of these and of words of the list above is one for boilerplate.
HELP_WORDS = frozenset(
    "site page post article entry main top bottom left right global primary secondary list lists box bar buttons button btn link links "
    "item items container wrapper wrap inner outer section block area group panel form text content body title heading icon icons row "
    "col column holder unit slot zone region module mobile desktop fixed sticky js my id the up sign in log bar head header thread feed "
    "tags tag cloud media news story stories more policy message bottombar topbar view 1 2 3 4 5".split()
)
#: On a paragraph, quotation or heading these may name what it says rather than what it is.
MILD_WORDS = frozenset("reply replies respond notice notices alert side discussion promotion recommended recommendation recommendations disclaimer search skip subscription".split())
NOT_WORDS = frozenset("with has no without non".split())
IN_WORDS = frozenset("article content post entry story main body text".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
HIDDEN_STYLE = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
#: Elements that a new element of these names closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "article": ("nav", "header"), "main": ("nav", "header")}

NAME = re.compile(r"/?+[a-zA-Z][^\s/>]*+")
#: From a tag's name to its end: quotes count after an equals sign only. No part can match in two ways.
TAG_END = re.compile(r"""(?>[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
CUT_OFF = re.compile(r"\s++[\w:-]++\s*+=")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
WORDS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ENDED = re.compile(r"[.!?…:;][\"'”’»)\]]*\Z")
#: Broken tags of one page that are ended at the next ``>`` instead; the page's later ones are text.
MENDED = 16

FEATURES = ("base", "inside", "outside", "named in", "outside named", "out element", "form", "named out", "partly named out", "partly named inside", "hidden", "header", "words", "few words", "ended", "linked", "linked inside", "kin linked", "kin linked inside", "heading", "cell")
#: Capacities of the two kinds of ties.
NEXT_TIE, SIBLING_TIE, COUSIN_TIE = 0.4, 0.5, 0.2


class Element:
    """What the classifier knows of an element and those around it."""

    __slots__ = ("name", "parent", "block", "link", "inside", "named", "out", "form", "strong", "weak", "hidden", "header")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        if parent is None:
            self.block, self.link = self, False
            self.inside = self.named = self.out = self.form = self.strong = self.weak = self.hidden = self.header = False
        else:
            self.block = self if name in BLOCKS else parent.block
            for k in ("link", "inside", "named", "out", "form", "strong", "weak", "hidden", "header"):
                setattr(self, k, getattr(parent, k))
        self.link |= name == "a"
        if name in IN:
            self.inside, self.form, self.header, self.weak = True, False, False, False
        elif name in OUT:
            self.out = True
        elif name == "form":
            self.form = True
        elif name == "header" and not self.inside:
            self.header = True
        if attributes and name not in ("body", "html"):
            self.take(attributes)

    def take(self, attributes: str) -> None:
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            if key in ("class", "id"):
                for token in (m[2] or m[3] or m[4] or "").split():
                    self.take_name(token)
            elif key == "role":
                self.out |= (m[2] or m[3] or m[4] or "").strip().lower() in OUT_ROLES
            elif key == "hidden" or (key == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true"):
                self.hidden = True
            elif key == "style" and HIDDEN_STYLE.search(m[2] or m[3] or m[4] or ""):
                self.hidden = True

    def take_name(self, token: str) -> None:
        words = _words_of(token)
        if not words or words[0] in NOT_WORDS:
            return
        if any(w in OUT_WORDS for w in words):
            sure = all(w in OUT_WORDS or w in HELP_WORDS for w in words)
            if sure and not (self.name in QUOTES and all(w in MILD_WORDS or w in HELP_WORDS for w in words)):
                self.strong = True
            else:
                self.weak = True
        elif not self.inside and any(w in HEADER_WORDS for w in words):
            self.header = True
        elif any(w in IN_WORDS for w in words):
            self.named = True


@lru_cache(100_000)
def _words_of(token: str) -> tuple[str, ...]:
    return tuple(WORDS.findall(CAMEL.sub(" ", token).lower()))


class Block:
    __slots__ = ("text", "home", "linked")

    def __init__(self, text: str, home: Element, linked: int):
        self.text, self.home, self.linked = text, home, linked


class _Page:
    """One pass over a page; each step moves on, so that the time is in proportion to the page."""

    def __init__(self, page: str):
        self.page, self.at, self.out = page, Element("html", None, ""), []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.unclosed: set[str] = set()

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append(Block(text, self.at.block, self.linked))
            self.parts, self.linked = [], 0

    def add(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.at.link:
                self.linked += len(text.strip())

    def leave(self, up: Element) -> None:
        """Close the open elements down to ``up``, itself included."""
        while self.at is not up:
            self.open[self.at.name] -= 1
            self.at = self.at.parent
        self.open[up.name] -= 1
        self.at = up.parent

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.close_block()
            closed = ("p", *CLOSES.get(name, ()))
            up, wide = self.at, name in IN
            while any(self.open[c] for c in closed) and up.parent is not None:
                here, up = up, up.parent
                if here.name in closed:
                    self.leave(here)
                    if here.name != "p" and not wide:
                        break
                elif here.name in BLOCKS and not wide:
                    break
        if name not in VOID:
            self.at = Element(name, self.at, attributes)
            self.open[name] += 1

    def end(self, name: str) -> None:
        if name == "p" or name in BLOCKS:
            self.close_block()
        if self.open[name]:
            up = self.at
            while up.name != name:
                up = up.parent
            self.leave(up)

    def raw_end(self, name: str, after: int) -> int:
        """Where the text of a raw element ends: behind its end tag."""
        if name not in self.unclosed:
            if (m := _raw_end(name).search(self.page, after)) is not None:
                return m.end()
            self.unclosed.add(name)
        return len(self.page) if name in RAW_TO_END else after

    def blocks(self) -> list[Block]:
        page, size, place, text, mended = self.page, len(self.page), 0, 0, 0
        while (a := page.find("<", place)) >= 0:
            if page.startswith("<!--", a):
                self.add(page[text:a])
                end = page.find("-->", a + 4)
                place = text = size if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), a):
                self.add(page[text:a])
                end = page.find(">", a)
                place = text = size if end < 0 else end + 1
                continue
            if (m := NAME.match(page, a + 1)) is None:
                place = a + 1
                continue
            rest, end = m.end(), -1
            if mended <= MENDED:
                if (e := TAG_END.match(page, rest)) is not None:
                    end = e.end()
                else:
                    mended += 1
                    end = page.find(">", rest) + 1 or -1
                    mended += (end < 0) * (MENDED + 1)
            if end < 0:  # nothing ends it: an attribute that was cut off goes, other words are text
                if CUT_OFF.match(page, rest):
                    self.add(page[text:a])
                    cut = page.find("<", rest)
                    place = text = size if cut < 0 else cut
                else:
                    place = rest
                continue
            self.add(page[text:a])
            place = text = end
            name = m[0].lower()
            if name[0] == "/":
                self.end(name[1:])
            elif name in RAW:
                if page[end - 2] != "/" or name in RAW_TO_END:
                    place = text = self.raw_end(name, end)
            elif name == "br":
                self.parts.append(" ")
            else:
                self.start(name, page[rest : end - 1])
        self.add(page[text:])
        self.close_block()
        return self.out


@lru_cache(None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order: references decoded, white space made single, empty ones left out.

    A tag that nothing ends is text, unless an attribute follows its name.
    """
    return _Page(page).blocks()


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; its kin are the blocks under the same parent, as the items of a list are."""
    marked, named = any(b.home.inside for b in blocks), any(b.home.named for b in blocks)
    rows = np.zeros((len(blocks), len(FEATURES)))
    kin: dict[int, list[float]] = {}
    for b in blocks:
        kin.setdefault(id(b.home.parent or b.home), []).append(min(1.0, b.linked / len(b.text)))
    shares = {k: sum(v) / len(v) for k, v in kin.items()}
    for row, b in zip(rows, blocks):
        e, words, linked, share = b.home, b.text.count(" ") + 1, min(1.0, b.linked / len(b.text)), shares[id(b.home.parent or b.home)]
        row[:] = (
            1.0, e.inside, marked and not e.inside, e.named, not marked and named and not e.named, e.out, e.form, e.strong, e.weak and not e.inside, e.weak and e.inside, e.hidden, e.header,
            min(words, 50) / 50, words <= 3, ENDED.search(b.text, max(0, len(b.text) - 8)) is not None, linked, linked * e.inside, share, share * e.inside, e.name in HEADINGS, e.name in ("td", "th"),
        )
    return rows


def fit_weights(pages: list[tuple[str, list[str]]], ridge: float = 2.0, most: float = 9.0) -> np.ndarray:
    """Logistic weights from (html, texts of the article's blocks in order), by Newton steps; none exceeds ``most``."""
    xs, ys = [], []
    for page, kept in pages:
        blocks, k = blocks_of(page), 0
        y = np.zeros(len(blocks))
        for i, b in enumerate(blocks):
            if k < len(kept) and b.text == " ".join(kept[k].split()):
                y[i], k = 1, k + 1
        xs.append(features_of(blocks))
        ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return np.clip(w, -most, most)


@lru_cache(1)
def trained_weights(pages: int = 600, seed: int = 23) -> tuple[float, ...]:
    rnd = random.Random(seed)
    return tuple(fit_weights([made_page(rnd) for _ in range(pages)]).tolist())


def log_odds(blocks: list[Block], weights: tuple[float, ...]) -> list[float]:
    """The classifier: how much likelier article than boilerplate each block is."""
    return (features_of(blocks) @ np.array(weights)).tolist()


def ties_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block, and to the next block under the same parent or grandparent."""
    ties = [(k, k + 1, NEXT_TIE) for k in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    far: dict[int, int] = {}
    for k, b in enumerate(blocks):
        parent = b.home.parent or b.home
        grand = parent.parent or parent
        if (p := last.get(id(parent))) is not None:
            ties.append((p, k, SIBLING_TIE))
        elif (p := far.get(id(grand))) is not None:
            ties.append((p, k, COUSIN_TIE))
        last[id(parent)] = far[id(grand)] = k
    return ties


def minimum_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    A node whose cost outweighs all of its ties lies on its own side in every minimum cut: it is taken out and its ties
    are added to its neighbours' costs, until none is left. The flow runs over what remains, one connected part at a time.
    """
    costs, near = list(costs), [[] for _ in costs]
    for a, b, w in ties:
        near[a].append((b, w))
        near[b].append((a, w))
    free = [sum(w for _, w in near[k]) for k in range(len(costs))]
    side: list[bool | None] = [None] * len(costs)
    todo = list(range(len(costs)))
    while todo:
        a = todo.pop()
        if side[a] is None and (abs(costs[a]) > free[a] + 1e-9 or free[a] <= 1e-9):
            side[a] = costs[a] > 0
            for b, w in near[a]:
                if side[b] is None:
                    costs[b] += w if side[a] else -w
                    free[b] -= w
                    todo.append(b)
    for first in range(len(costs)):
        if side[first] is None:
            part, place = [first], {first: 0}
            for a in part:
                for b, _ in near[a]:
                    if side[b] is None and b not in place:
                        place[b] = len(part)
                        part.append(b)
            inner = [(place[a], place[b], w) for a in part for b, w in near[a] if b in place and a < b]
            for a, inside in zip(part, flow_cut([costs[a] for a in part], inner)):
                side[a] = inside
    return side


def flow_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut by the largest flow.

    A positive cost is the node's capacity from the source, a negative one its capacity to the sink. Blocking flows
    over levels (Dinic 1970), walked with a stack.
    """
    n = len(costs)
    if all(c > 0 for c in costs) or all(c <= 0 for c in costs):
        return [c > 0 for c in costs]
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, c in enumerate(costs):
        if c > 0:
            edge(source, k, c, 0.0)
        elif c < 0:
            edge(k, sink, -c, 0.0)
    for a, b, w in ties:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            edges, k = out[a], place[a]
            while k < len(edges) and not (cap[edges[k]] > 1e-12 and level[to[edges[k]]] == level[a] + 1):
                k += 1
            place[a] = k
            if k < len(edges):
                path.append(edges[k])
                a = to[edges[k]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """Article blocks of a whole page, joined by two newlines; empty for a null or empty page."""
    blocks = blocks_of(page or "")
    inside = minimum_cut(log_odds(blocks, trained_weights() if weights is None else weights), ties_of(blocks)) if blocks else []
    return "\n\n".join(b.text for b, kept in zip(blocks, inside) if kept)


def extract_main_text(pages: DataFrame, column: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """pages with ``text``, the main text of the whole page, and ``n_chars``, its code points.

    ``weights`` of the classifier's FEATURES, by default those fitted to generated pages. Null or empty html gives an
    empty text; a page of any length or brokenness takes time in proportion to it. Every row is labelled by itself,
    repeated rows alike; other columns are kept, columns of the two names replaced.
    """
    fitted = trained_weights() if weights is None else tuple(weights)

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p, fitted) for p in part], dtype=object)

    rows = pages.drop(*(c for c in ("text", "n_chars") if c != column))
    return rows.withColumn("text", extract(F.col(column).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
