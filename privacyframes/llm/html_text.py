"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no dropped node has a kept descendant."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .blocks import pack, unpack
from .registry import query, table
from .sampling import bounded

#: Pages learned from at most, rewritten forms of all of them, trees, their depth, the step of each, and bins of a feature.
LEARNED, REWRITTEN, TREES, DEPTH, RATE, BINS = 150, 1200, 150, 5, 0.3, 32
#: Nodes that one tree is grown on, and the weight of a part to drop inside a part to keep.
GROWN, INNER = 6_000, 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object noframes textarea title select button".split())
#: Of these, the ones with a syntax of their own, and the ones that can lie within each other.
FOREIGN = frozenset("svg math".split())
NESTED = FOREIGN | frozenset("template object".split())
#: Of these, the ones that hide the rest of the page when they are not closed.
HIDING = frozenset("script style title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = BLOCKS - frozenset("body caption head html legend option tbody td tfoot th thead tr li dd dt summary figcaption".split())
#: A start tag ends an open element of these kinds, unless one of the second kinds lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
TAGS = ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "span", "figure", "#text", "body")
#: Stems of attribute tokens: what names the parts around an article, and the article itself.
AROUND = ("nav", "menu", "head", "foot", "side", "notice", "cookie", "consent", "banner", "ad", "advert", "promo", "sponsor", "comment", "reply", "form", "login", "subscribe", "newsletter", "related", "share", "social", "breadcrumb", "popup", "modal", "widget", "pager", "copyright", "toolbar", "search")
INSIDE = ("article", "content", "main", "post", "entry", "story", "body", "text", "page")
_WORD = re.compile(r"[a-z]+")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"\s+")
#: One attribute of a tag, up to the opening quote of its value if that is quoted.
_NEXT = re.compile(r"""[\s/]*=?[^\s/>=]*(?:\s*=\s*(?:(["'])|[^\s"'>][^\s>]*)?)?""")


class Page:
    """Nodes in page order (parents first): elements, and leaves ``#text`` for each run of text within one block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.text, self.linked = ["#page"], [-1], [()], [""], [0]
        self.stack, self.open = [0], {}
        self.run: list[str] | None = None
        self.run_linked = 0
        self._parse(source)
        self._end_run()

    def _node(self, tag, tokens=(), text="", linked=0) -> int:
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _end_run(self) -> None:
        if self.run is not None:
            text = _SPACE.sub(" ", "".join(self.run)).strip()
            if text:
                self._node("#text", (), text, self.run_linked)
            self.run, self.run_linked = None, 0

    def _data(self, text: str) -> None:
        if self.run is None:
            if not text or text.isspace():
                return
            self.run = []
        if "&" in text:
            text = html.unescape(text)
        self.run.append(text)
        if self.open.get("a"):
            self.run_linked += len(text)

    def _push(self, tag, tokens) -> None:
        scored = tag in BLOCKS or tokens
        if scored:
            self._end_run()
        self.stack.append(self._node(tag, tokens) if scored else self.stack[-1])
        self.names.append((tag, bool(scored)))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> str:
        tag, scored = self.names.pop()
        if scored:
            self._end_run()
        self.stack.pop()
        self.open[tag] -= 1
        return tag

    def _close(self, kinds, borders) -> None:
        """Ends the nearest open element of some kinds and all within it, if no border lies between."""
        if not any(self.open.get(k) for k in kinds):
            return
        for at in range(len(self.names) - 1, -1, -1):
            tag = self.names[at][0]
            if tag in kinds:
                while len(self.names) > at:
                    self._pop()
                return
            if tag in borders:
                return

    def _parse(self, source: str) -> None:
        self.names: list[tuple[str, bool]] = []
        at, n = 0, len(source)
        endless: set[str] = set()
        while at < n:
            found = _START.search(source, at)
            if not found:
                self._data(source[at:])
                return
            if found.start() > at:
                self._data(source[at : found.start()])
            at = found.start()
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if source[at + 1] in "!?":
                end = source.find(">", at)
                at = n if end < 0 else end + 1
                continue
            name = _NAME.match(source, at + 1)[0].lower()
            head = at + 1 + len(name)
            end = _tag_end(source, head)
            if end < 0:
                return
            attributes = source[head:end]
            at = end + 1
            if name[0] == "/":
                name = name[1:]
                if name == "br" or (name == "p" and not self.open.get("p")):
                    self._data(" ")
                elif self.open.get(name):
                    self._close((name,), ("table",) if name not in ("table", "body", "html") else ())
                continue
            if name == "br":
                if self.run is not None:
                    self.run.append(" ")
                continue
            # A slash at the end empties only foreign elements; elsewhere it belongs to a value or is ignored.
            if name in RAW and not (name in FOREIGN and attributes.endswith("/")):
                end = -1 if name in endless else _raw_end(source, name, at)
                if end < 0 and name in HIDING:
                    return
                if end < 0:
                    endless.add(name)
                    continue
                close = source.find(">", end)
                at = n if close < 0 else close + 1
                continue
            if name in ("html", "head", "body"):
                if name == "body":
                    self._close(("head",), ())
                if self.open.get(name):
                    continue
            if name in CLOSED_BY_BLOCK:
                self._close(("p",), ("table", "td", "th", "button"))
            if name in ENDS:
                self._close(*ENDS[name])
            if name in VOID:
                if name == "hr":
                    self._end_run()
                continue
            self._push(name, _tokens(attributes) if attributes else ())
            if attributes.endswith("/") and name not in BLOCKS:
                self._pop()


def _raw_end(source: str, name: str, at: int) -> int:
    """Place of the end tag of a raw element. Those that hold elements (all but texts) may hold others of their own kind, which end first."""
    if name not in NESTED:
        found = re.compile(f"</{name}(?![a-z0-9])", re.I | re.A).search(source, at)
        return found.start() if found else -1
    open_elements = 1
    for found in re.compile(f"<(/?){name}(?![a-z0-9-])", re.I | re.A).finditer(source, at):
        if found[1]:
            open_elements -= 1
        else:
            end = _tag_end(source, found.end())
            open_elements += not (end > 0 and source[end - 1] == "/" and name in FOREIGN)
        if not open_elements:
            return found.start()
    return -1


def _tag_end(source: str, head: int) -> int:
    """Place of the ">" that ends a tag. One in a quoted value does not; a quote that is never closed, or after which no tag ends, is none."""
    at = head
    while at < len(source) and source[at] != ">":
        found = _NEXT.match(source, at)
        at = found.end()
        if found[1]:
            at = max(at, source.find(found[1], at) + 1)
    return at if at < len(source) else source.find(">", head)


def _tokens(attributes: str) -> tuple[str, ...]:
    """Words of the class, id, role and label of an element, and what hides it."""
    out = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            out += _WORD.findall(html.unescape(value.strip("\"'")).lower())
        elif name == "hidden" or (name == "style" and "none" in value) or (name == "aria-hidden" and "true" in value):
            out.append("hidden")
    return tuple(out)


def _stems(tokens, stems) -> int:
    """Bits of the stems some token is or starts with; "ad" must be whole."""
    bits = 0
    for t in tokens:
        for i, s in enumerate(stems):
            if t == s or (len(s) > 3 and t.startswith(s)) or (s == "ad" and t == "ads"):
                bits |= 1 << i
    return bits


TOKEN_SLOTS = 24
FEATURES = 2 * len(TAGS) + len(AROUND) + len(INSIDE) + TOKEN_SLOTS + 24


def _log(x: float) -> int:
    return min(BINS - 1, int(x).bit_length())


def _share(a: float, b: float) -> int:
    return min(BINS - 1, int(a / b * 16)) if b else 0


def page_features(page: Page) -> np.ndarray:
    """One row of small numbers per node: own and enclosing tags, attribute tokens, subtree density, depth and siblings."""
    n = len(page.tag)
    parent, tag = page.parent, page.tag
    chars, linked, stops, marks, digits = ([0] * n for _ in range(5))
    nodes, leaves, paragraphs = [1] * n, [0] * n, [0] * n
    depth, index, siblings, last = [0] * n, [0] * n, [0] * n, [0] * n
    around, inside, kinds = [0] * n, [0] * n, [0] * n
    before: list[int] = [-1] * n
    for i in range(1, n):
        p = parent[i]
        depth[i], index[i], before[i], last[p] = depth[p] + 1, siblings[p], last[p] if siblings[p] else -1, i
        siblings[p] += 1
        around[i] = around[p] | (_stems(page.tokens[i], AROUND) if page.tokens[i] else 0)
        inside[i] = inside[p] | (_stems(page.tokens[i], INSIDE) if page.tokens[i] else 0)
        kinds[i] = kinds[p] | (1 << _TAG[tag[i]] if tag[i] in _TAG else 0)
        if tag[i] == "#text":
            t = page.text[i]
            chars[i], linked[i], leaves[i] = len(t), page.linked[i], 1
            stops[i], marks[i] = t.count(". ") + t.endswith("."), t.count(",")
        elif tag[i] == "p":
            paragraphs[i] = 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for x in (chars, linked, stops, marks, nodes, leaves, paragraphs):
            x[p] += x[i]
    total = max(1, chars[0])
    out = np.zeros((n, FEATURES), np.uint8)
    base = 2 * len(TAGS)
    rest = FEATURES - 24
    for i in range(1, n):
        p, row = parent[i], out[i]
        if tag[i] in _TAG:
            row[_TAG[tag[i]]] = 1
        bits, at = kinds[p], len(TAGS)
        while bits:
            low = bits & -bits
            row[at + low.bit_length() - 1] = 1
            bits ^= low
        for bits, at in ((around[i], base), (inside[i], base + len(AROUND))):
            while bits:
                low = bits & -bits
                row[at + low.bit_length() - 1] = 1
                bits ^= low
        for t in page.tokens[i]:
            row[base + len(AROUND) + len(INSIDE) + zlib.crc32(t.encode()) % TOKEN_SLOTS] = 1
        c, b = chars[i], before[i]
        row[rest:] = (
            _log(c), _log(linked[i]), _share(linked[i], c), _log(c // max(1, nodes[i])), _log(c // max(1, leaves[i])), _log(nodes[i]), _log(leaves[i]),
            min(BINS - 1, stops[i]), min(BINS - 1, marks[i]), min(BINS - 1, paragraphs[i]), _share(c, total), min(BINS - 1, depth[i]),
            min(BINS - 1, index[i]), _log(siblings[p]), min(BINS - 1, siblings[p] - 1 - index[i]), _share(c, max(1, chars[p])), _share(paragraphs[i], max(1, paragraphs[0])),
            _log(chars[p]), _share(linked[p], max(1, chars[p])), min(BINS - 1, paragraphs[p]),
            _log(chars[b]) if b > 0 else 0, 1 + _TAG.get(tag[b], len(TAGS)) if b > 0 else 0, _share(linked[b], max(1, chars[b])) if b > 0 else 0, _share(stops[i] * 60, max(1, c)),
        )
    return out


_TAG = {t: i for i, t in enumerate(TAGS)}


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
    """Stochastic gradient boosting on the logistic loss over small whole-number features: per tree, the feature and bound of each inner

    node (level order, a complete tree) and the value of each leaf. A tree sees ``GROWN`` rows, drawn by weight in a fixed order."""
    random = np.random.default_rng(11)
    f = x.shape[1]
    margin = np.full(len(x), np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    start = float(margin[0]) if len(x) else 0.0
    offset = np.arange(f) * BINS
    pool = np.repeat(np.arange(len(x)), weight)
    out = []
    for _ in range(trees):
        rows = random.choice(pool, min(GROWN, len(pool)), replace=False)
        part = x[rows]
        cells = part.astype(np.int64) + offset
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = y[rows] - p, p * (1 - p) + 1e-6
        each_g, each_h = np.repeat(g, f), np.repeat(h, f)
        leaf, feature, bound, n = np.zeros(len(rows), np.int64), [], [], np.arange(len(rows))
        for level in range(depth):
            width = 1 << level
            at = (leaf[:, None] * (f * BINS) + cells).ravel()
            gl, hl = (np.bincount(at, v, width * f * BINS).reshape(width, f, BINS).cumsum(axis=2) for v in (each_g, each_h))
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl * gl / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt * gt / (ht + 1)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            feature.append(best // BINS)
            bound.append(best % BINS)
            leaf = 2 * leaf + (part[n, feature[-1][leaf]] > bound[-1][leaf])
        width = 1 << depth
        value = rate * np.bincount(leaf, g, width) / (np.bincount(leaf, h, width) + 1)
        out.append((feature, bound, value))
        margin += boosted((0.0, out[-1:]), x)
    return start, out


def boosted(model, x: np.ndarray) -> np.ndarray:
    start, trees = model
    margin, rows = np.full(len(x), start), np.arange(len(x))
    for feature, bound, value in trees:
        leaf = np.zeros(len(x), np.int64)
        for f, b in zip(feature, bound, strict=True):
            leaf = 2 * leaf + (x[rows, f[leaf]] > b[leaf])
        margin += value[leaf]
    return margin


def decode(parent: list[int], margin) -> list[bool]:
    """The likeliest choice of kept nodes in which every kept node's parent is kept."""
    n = len(parent)
    m = np.clip(margin, -20, 20)
    keep, drop = (-np.log1p(np.exp(-m))).tolist(), (-np.log1p(np.exp(m))).tolist()
    for i in range(n - 1, 0, -1):  # keep[i]: best with i kept; drop[i]: its whole subtree dropped
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] > drop[i]
    return kept


# Training: pages label themselves by their semantic elements, and are rewritten so that the trees meet other ways to mark the same parts.
_WRAPS = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("section", 'class="post-body"'), ("div", 'class="entry story"'), ("div", 'class="article text"'), ("div", "")]
_PARTS = [("aside", ""), ("form", ""), ("section", 'class="comments"'), ("nav", ""), ("div", 'class="nav"'), ("ul", 'class="menu"'), ("header", ""), ("div", 'id="header"'), ("footer", ""), ("div", 'class="footer copyright"'), ("aside", ""), ("div", 'class="sidebar"'), ("div", 'class="widget"'), ("div", 'class="notice"'), ("div", 'id="cookie-notice"'), ("div", 'class="cookie consent banner"'), ("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert sponsor"'), ("section", 'class="promo"'), ("form", ""), ("form", 'class="newsletter subscribe"'), ("div", 'class="login form"'), ("div", 'class="comments"'), ("section", 'id="comments"'), ("div", 'class="comment reply"'), ("div", 'class="related"'), ("div", 'class="share social"'), ("div", 'class="breadcrumb"'), ("div", 'class="popup modal"'), ("div", 'class="newsletter signup"'), ("div", 'class="banner"'), ("p", 'class="ad"'), ("p", 'class="notice"'), ("aside", 'class="related"')]


def _labelled(source: str, random) -> tuple[Page, np.ndarray] | None:
    """A rewritten page and whether each node holds main text: text from the article of the source, marked while the page is built."""
    page = Page(source)
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        inside[i] = inside[page.parent[i]] or page.tag[i] in ("article", "main")
    core = [(page.tag[page.parent[i]], page.text[i]) for i in range(len(page.tag)) if page.tag[i] == "#text" and inside[i]]
    rest = [page.text[i] for i in range(len(page.tag)) if page.tag[i] == "#text" and not inside[i]]
    if not core:
        return None
    pool = [t for _, t in core] + rest
    first = random.integers(len(core))
    core = core[first : first + random.integers(1, 20)]

    def part() -> str:
        tag, attributes = _PARTS[random.integers(len(_PARTS))]
        own = [html.escape(pool[random.integers(len(pool))]) for _ in range(random.integers(1, 4))]
        how = random.integers(4)
        if tag == "p":
            body = own[0][:300]
        elif how == 0 or tag in ("nav", "ul"):
            body = "".join(f'<li><a href="#">{" ".join(t.split()[:3])}</a></li>' for t in own)
            body = body if tag == "ul" else f"<ul>{body}</ul>"
        elif how == 1:
            body = own[0]
        elif how == 2:
            body = f"<h2>{' '.join(own[0].split()[:2])}</h2>" + "".join(f"<p>{t}</p>" for t in own)
        else:
            body = "".join(f"<div><b>{' '.join(t.split()[:2])}</b><p>{t}</p></div>" for t in own)
        return f"<{tag} {attributes}>{body}</{tag}>"

    tag, attributes = _WRAPS[random.integers(len(_WRAPS))]
    body = []
    for kind, text in core:
        kind = kind if kind in ("p", "h1", "h2", "h3", "li", "blockquote", "pre") else "p"
        body.append(f"<{kind}>\x01{html.escape(text)}</{kind}>")
        if random.random() < 0.12:
            body.append(part())
    parts = lambda most: "".join(part() for _ in range(random.integers(most)))
    outer = f"<{tag} {attributes}>{''.join(body)}</{tag}>{parts(2)}"
    if random.random() < 0.5:
        outer = f'<div class="{["wrapper", "container", "page", "site"][random.integers(4)]}">{outer}</div>'
    built = Page(f"<html><head><title>x</title></head><body>{parts(4)}{outer}{parts(4)}</body></html>")
    return built, _holds(built, [t.startswith("\x01") for t in built.text])


def _holds(page: Page, leaf: list[bool]) -> np.ndarray:
    y = np.array(leaf, float)
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    page.text = [t.lstrip("\x01") for t in page.text]
    return y


def _as_it_is(source: str):
    page = Page(source)
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        inside[i] = inside[page.parent[i]] or page.tag[i] in ("article", "main")
    return (page, _holds(page, [t == "#text" and x for t, x in zip(page.tag, inside, strict=True)])) if any(inside) else None


def learn(sources: list[str]):
    """Trees from some pages: each twice as it is and rewritten some times, in a fixed order of random choices. None without an article."""
    random = np.random.default_rng(7)
    made = [m for s in sources for m in (_as_it_is(s), _as_it_is(s), *(_labelled(s, random) for _ in range(-(-REWRITTEN // len(sources))))) if m]
    if not made:
        return None
    x, y = np.concatenate([page_features(p)[1:] for p, _ in made]), np.concatenate([y[1:] for _, y in made])
    within = np.concatenate([y[np.array(p.parent[1:], int)] for p, y in made])
    return boost(x, y, np.where((within == 1) & (y == 0), INNER, 1))


def main_text(model, sources: list[str | None]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if model is None:
        return ["" for _ in pages]
    margins = boosted(model, np.concatenate([page_features(p) for p in pages])) if pages else []
    out, first = [], 0
    for p in pages:
        margin = margins[first : first + len(p.tag)]
        first += len(p.tag)
        kept = decode(p.parent, margin)
        out.append("\n".join(t for t, k, tag in zip(p.text, kept, p.tag, strict=True) if k and tag == "#text"))
    return out


def start_pages(n: int = 24) -> list[str]:
    """Pages made from a rule, to learn from where no given page marks its article: paragraphs between the usual parts of a page."""
    random = np.random.default_rng(11)
    word = lambda: "".join(random.choice(["ka", "lo", "mi", "ter", "en", "ast", "ur", "ve", "no", "si"], random.integers(1, 5)))
    words = lambda low, high: " ".join(word() for _ in range(random.integers(low, high)))
    links = lambda most: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(random.integers(2, most)))
    out = []
    for _ in range(n):
        blocks = [f"<h1>{words(2, 9)}</h1>", *(f"<p>{words(12, 70)}.</p>" for _ in range(random.integers(3, 12)))]
        blocks.insert(random.integers(2, len(blocks)), f"<h2>{words(2, 6)}</h2><ul><li>{words(4, 15)}</li><li>{words(4, 15)}</li></ul>")
        out.append(
            f"<html><body><header><a href=/>{words(1, 3)}</a><nav><ul>{links(8)}</ul></nav></header><article>{''.join(blocks)}</article>"
            f'<aside class="sidebar"><h3>{words(1, 3)}</h3><ul>{links(9)}</ul></aside><footer><p>{words(3, 12)}</p></footer></body></html>'
        )
    return out


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", learned: int = LEARNED, longest: int = 20_000) -> DataFrame:
    """``pages`` with ``main_text``: blocks of the main text in page order, joined by line ends; references decoded, white space as one blank.

    Learns from at most ``learned`` different pages (by a hash of id and page) of at most ``longest`` characters that mark their article by an element;
    if all such pages are longer, from the shortest of them; if no page marks its article, from pages made from a rule.
    Every page is extracted whole, however long. Null and empty pages give an empty text. Pages with one id or none are
    extracted each. All rows and columns come back (a column named ``main_text`` is replaced). The trees, some kilobytes, are all that is broadcast.
    """
    spark = pages.sparkSession

    def fit(rows):
        rows = rows.sort_by([("id", "ascending"), ("html", "ascending")])
        return pa.table({"model": pa.array([pack(learn(rows["html"].to_pylist()))], pa.binary())})

    marked = pages.select(F.col(id_column).cast("string").alias("id"), F.col(html_column).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    sample = bounded(marked.filter(F.length("html") <= longest), ["id", "html"], learned)
    if sample.isEmpty():
        sample = marked.orderBy(F.length("html"), "html").limit(learned)
    if sample.isEmpty():
        sample = spark.createDataFrame([(str(i), page) for i, page in enumerate(start_pages())], "id string, html string")
    found = sample.withColumn("all_rows", F.lit(0)).groupBy("all_rows").applyInArrow(fit, "model binary").collect()
    shared = spark.sparkContext.broadcast(unpack(bytes(found[0]["model"])) if found else None)
    rows = pages.drop("main_text")
    names = rows.columns
    at = names.index(html_column)

    def extract(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = main_text(shared.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "main_text"])

    return rows.mapInArrow(extract, StructType(rows.schema.fields + [StructField("main_text", StringType())]))


@query("op2_html_text")
def op2_html_text(spark, sf_dir):
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
