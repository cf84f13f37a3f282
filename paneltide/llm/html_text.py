"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded hierarchically.

A tolerant parser turns a page into its block elements and the text blocks between their tags.
Each element becomes a vector of features: text and link density of its subtree, attribute words,
depth, place among its siblings, what stands around it. Boosted trees give the probability that
an element's text is article text. Decoding then chooses for the whole tree: an element is kept
whole, dropped whole, or opened up, whichever is likeliest in sum, so no kept element stands in a
dropped one. The trees are trained on pages that :func:`training_page` composes, because no page
of the corpus is labelled; the number of those pages is a parameter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneltide.llm import common

#: The element kinds of HTML that matter here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never text of a page: code, the head, stand-ins that browsers with frames do not show, and the controls of forms.
UNSEEN = frozenset("script style title head template iframe noembed noframes textarea select option button datalist".split())
#: What an opening tag ends, where that is open and nothing in between holds it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
HOLDS = frozenset("table td th ul ol dl button object html body div article section main aside nav form".split())

_NAME = re.compile(r"[^\s/>]+")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

#: Words of class, id and role attributes that name a part of a page.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager toolbar tabs topbar".split(),
    "frame": "header head masthead footer foot bottom copyright legal branding logo site".split(),
    "side": "sidebar side aside widget widgets related recommended popular trending more rail links tags tag".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner teaser".split(),
    "notice": "cookie cookies consent notice alert warning popup modal overlay gdpr message newsletter subscribe subscription paywall signup".split(),
    "social": "share sharing social follow like likes tweet".split(),
    "comment": "comment comments disqus reply replies respond discussion thread feedback reviews".split(),
    "form": "form search login input field contact".split(),
    "content": "content article post entry story main text body page blog single".split(),
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws}
_KINDS = tuple(HINTS)
_TAGS = "p div li ul ol td tr table section article main nav header footer aside form h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dd dt dl body html".split()
_ITAG = {t: i + 1 for i, t in enumerate(_TAGS)}


class Page:
    """Block elements and text blocks of a page, in page order.

    Every step looks only at what it moves past or closes, so the work is linear in the length of the page, whatever it holds.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.hints, self.begin, self.end = [], [], [], [], []
        self.text: list[str] = []
        self.owner: list[int] = []
        self.linked: list[int] = []
        self._buffer: list[str] = []
        self._link_chars = 0
        # Open tags as (tag, element or -1 for an inline one), and where each name stands among them.
        self._open: list[tuple[str, int]] = []
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []  # open block elements
        self._inline: list[dict[str, list[int]]] = [{}]  # open inline tags since each open block
        self._held: list[tuple[str, dict[str, list[int]]]] = [("", {})]  # open tags since each that holds others
        self._hidden = self._links = 0
        self._push("html", self._element("html", ""))
        self._read(source)
        self._pop(0)

    @property
    def _now(self) -> int:
        return self._blocks[-1] if self._blocks else 0

    def _element(self, tag: str, attributes: str) -> int:
        words = set()
        if attributes:
            for name, a, b, c in _ATTR.findall(attributes):
                name = name.lower()
                if name in ("class", "id", "role", "itemprop"):
                    words.update(_SPLIT.split((a or b or c).lower()))
                elif name == "hidden" or (name == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
                    words.add("popup")
        self.tag.append(tag)
        self.parent.append(self._blocks[-1] if self._blocks else -1)
        self.hints.append({_HINT[w] for w in words if w in _HINT})
        self.begin.append(len(self.text))
        self.end.append(len(self.text))
        return len(self.tag) - 1

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                self.text.append(text)
                self.owner.append(self._now)
                self.linked.append(min(self._link_chars, len(text)))
            self._buffer, self._link_chars = [], 0

    def _say(self, piece: str) -> None:
        if piece and not self._hidden:
            piece = html.unescape(piece) if "&" in piece else piece
            self._buffer.append(piece)
            if self._links:
                self._link_chars += len(piece.strip())

    def _push(self, tag: str, element: int) -> None:
        at = len(self._open)
        self._open.append((tag, element))
        self._places.setdefault(tag, []).append(at)
        if element >= 0:
            self._blocks.append(element)
            self._inline.append({})
        else:
            self._inline[-1].setdefault(tag, []).append(at)
        if tag in HOLDS:
            self._held.append((tag, {}))
        else:
            self._held[-1][1].setdefault(tag, []).append(at)
        self._hidden += tag in UNSEEN
        self._links += tag == "a"

    def _pop(self, to: int) -> None:
        while len(self._open) > to:
            tag, e = self._open[-1]
            if e >= 0:
                self._flush()
                self.end[e] = len(self.text)
                self._blocks.pop()
                self._inline.pop()
            else:
                self._inline[-1][tag].pop()
            self._open.pop()
            self._places[tag].pop()
            if tag in HOLDS:
                self._held.pop()
            else:
                self._held[-1][1][tag].pop()
            self._hidden -= tag in UNSEEN
            self._links -= tag == "a"

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if tag == "br":
            self._say(" ")
            return
        if tag in BLOCKS:
            places = self._held[-1][1].get("p")  # an open paragraph ends, unless something holds this block
            if places:
                self._pop(places[0])
        if tag in VOID:
            return
        ends = ENDS.get(tag)
        if ends:
            while True:
                holder, inside = self._held[-1]
                first = min((inside[t][0] for t in ends if inside.get(t)), default=None)
                if holder in ends:
                    first = self._places[holder][-1]
                if first is None:
                    break
                self._pop(first)
        elif tag == "a" and self._links:
            self._finish("a")
        if tag in BLOCKS:
            self._flush()
            self._push(tag, self._element(tag, attributes))
        else:
            self._push(tag, -1)

    def _finish(self, tag: str) -> None:
        """An end tag closes the last open tag of its name; that of an inline tag only within the block at hand."""
        places = self._places.get(tag) if tag in BLOCKS or tag in UNSEEN else self._inline[-1].get(tag)
        if places and tag != "html":
            self._pop(places[-1])

    def _read(self, source: str) -> None:
        at, size, paired = 0, len(source), True
        last = source.rfind(">")
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self._say(source[at:])
                return
            self._say(source[at:lt])
            if source.startswith("<!--", lt):
                stop = source.find("-->", lt + 4)
                at = size if stop < 0 else stop + 3
                continue
            mark = source[lt + 1 : lt + 2]
            closing = mark == "/"
            start = source[lt + 2 : lt + 3] if closing else mark
            letter = start.isascii() and start.isalpha()
            if not letter and not closing and mark not in ("!", "?"):
                self._say("<")
                at = lt + 1
                continue
            if lt > last:  # the tag never ends: it is dropped, what follows the next mark is read
                at = source.find("<", lt + 1)
                at = size if at < 0 else at
                continue
            name = _NAME.match(source, lt + 1 + closing) if letter else None
            begin = name.end() if name else lt + 2
            end, pairing = self._tag_end(source, begin, paired and letter)
            at = end + 1
            if not letter:  # a declaration: quoted marks end it, which says nothing about the tags that follow
                continue
            paired = pairing
            tag = name[0].lower()
            if closing:
                self._finish(tag)
                continue
            attributes = source[begin:end]
            self._start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                stop = _RAW_END[tag].search(source, at)
                close = source.find(">", stop.end()) if stop else -1
                at = size if close < 0 else close + 1
                self._finish(tag)

    @staticmethod
    def _tag_end(source: str, begin: int, paired: bool) -> tuple[int, bool]:
        """Where a tag that begins before ``begin`` ends; there is a later ``>``. Quoted marks do not end it, unless the
        quotes of the page do not pair up from here to its end: then, and from then on, every first mark ends a tag."""
        at = begin
        while paired:
            m = _QUOTE_OR_END.search(source, at)
            if m and m[0] == ">":
                return m.start(), True
            at = source.find(m[0], m.end()) + 1 if m else 0
            paired = at > 0
        return source.find(">", begin), False


def node_features(page: Page) -> np.ndarray:
    """Elements x features."""
    n = len(page.tag)
    lengths = np.array([len(t) for t in page.text], float)
    links = np.array(page.linked, float)
    marks = np.array([t.count(". ") + t.count(", ") + t.endswith((".", "!", "?")) for t in page.text], float)
    words = np.array([t.count(" ") + 1 for t in page.text], float)
    cum = lambda v: np.r_[0.0, np.cumsum(v)] if len(v) else np.zeros(1)
    b, e = np.array(page.begin), np.array(page.end)
    sums = [cum(v)[e] - cum(v)[b] for v in (lengths, links, marks, words, np.ones(len(lengths)), (lengths > 80) * lengths)]
    text, link, mark, word, blocks, long = sums
    own = np.bincount(page.owner, weights=lengths, minlength=n) if len(lengths) else np.zeros(n)
    parent = np.array(page.parent)
    up = np.maximum(parent, 0)
    depth = np.zeros(n)
    inner = np.zeros(n)
    place = np.zeros(n)
    kids = np.zeros(n)
    same = np.zeros(n)
    last: dict[tuple[int, str], int] = {}
    before = np.zeros(n)
    previous: dict[int, int] = {}
    after = np.zeros(n)
    for i in range(1, n):
        p = up[i]
        depth[i] = depth[p] + 1
        place[i] = kids[p]
        kids[p] += 1
        key = (int(p), page.tag[i])
        same[i] = last.get(key, 0)
        last[key] = last.get(key, 0) + 1
        if p in previous:
            before[i] = text[previous[p]]
            after[previous[p]] = text[i]
        previous[int(p)] = i
    for i in range(n - 1, 0, -1):
        inner[up[i]] += inner[i] + 1
    total = max(1.0, text[0])
    tags = np.array([_ITAG.get(t, 0) for t in page.tag], float)
    mine = np.zeros((n, len(_KINDS)))
    for i, hints in enumerate(page.hints):
        for k in hints:
            mine[i, _KINDS.index(k)] = 1
    above = np.zeros((n, len(_KINDS)))
    semantic = np.zeros((n, 6))
    for i in range(n):
        if i:
            above[i] = np.maximum(above[up[i]], mine[up[i]])
            semantic[i] = semantic[up[i]]
        t = page.tag[i]
        for k, group in enumerate((("article", "main"), ("nav", "menu"), ("header", "footer"), ("aside",), ("form", "fieldset"), ("li", "td", "dd"))):
            if t in group:
                semantic[i, k] = 1
    density = link / np.maximum(text, 1)
    cols = [
        tags, depth, np.log1p(text), np.log1p(own), density, text / total, mark / np.maximum(word, 1), np.log1p(word / np.maximum(blocks, 1)), np.log1p(blocks), np.log1p(inner),
        inner / np.maximum(text, 1) * 100, place, np.log1p(kids), kids[up], same, np.log1p(before), np.log1p(after), cum(lengths)[b] / total, density[up], long / np.maximum(text, 1),
        text / np.maximum(text[up], 1), np.log1p(text[up]), np.array([t[0] == "h" and t[1:].isdigit() for t in page.tag], float), tags[up],
    ]
    return np.column_stack([*cols, semantic, mine, above])


# -- boosted trees ----------------------------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> dict:
    """Logistic gradient boosting by histograms. A tree is its nodes' features, cuts and leaf values, level by level."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f = np.full(len(y), base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        where = np.zeros(len(y), np.int64)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-3)
            chosen = np.full((width, 2), -1)
            for j in range(x.shape[1]):
                key = (where - first) * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[:, len(cuts[j]) :] = -1
                gain[(hs < 1) | (ht - hs < 1)] = -1
                k = gain.argmax(1)
                v = gain[np.arange(width), k]
                better = v > best
                best[better] = v[better]
                chosen[better] = np.stack([np.full(width, j), k], 1)[better]
            for i, (j, k) in enumerate(chosen):
                if j >= 0:
                    feature[first + i], cut[first + i] = j, cuts[j][k]
            where = 2 * where + 1 + (x[np.arange(len(y)), feature[where]] > cut[where])
        leaf = where - ((1 << depth) - 1)
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
        f += value[leaf]
        out.append((feature, cut, value))
    return {"base": base, "depth": depth, "trees": out}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, cut, value in model["trees"]:
        where = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            where = 2 * where + 1 + (x[rows, feature[where]] > cut[where])
        f += value[where - ((1 << model["depth"]) - 1)]
    return 1 / (1 + np.exp(-f))


# -- decoding ---------------------------------------------------------------------------------


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Which text blocks are kept: the likeliest choice of whole, nothing or opened for every element."""
    pick = choose(page, p)
    state = np.zeros(len(page.tag), np.int64)
    for i, q in enumerate(page.parent):
        state[i] = state[q] if q >= 0 and state[q] != OPENED else pick[i]
    return [bool(state[o] == KEPT or (state[o] == OPENED and p[o] >= 0.5)) for o in page.owner]


KEPT, DROPPED, OPENED = 0, 1, 2


def choice_scores(page: Page, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each element adds to the score of a tree's choices if it is kept (with all inside), dropped (with all inside), or opened."""
    lengths = np.array([len(t) for t in page.text], float)
    own = np.bincount(page.owner, weights=lengths, minlength=len(page.tag)) if page.text else np.zeros(len(page.tag))
    upto = np.r_[0.0, np.cumsum(lengths)]
    weight = np.log1p(upto[page.end] - upto[page.begin]) * 0.5
    plain = np.log1p(own)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    # Most elements are of one piece, so opening one costs its weight.
    return (weight + plain) * np.log(p), (weight + plain) * np.log(1 - p), plain * np.maximum(np.log(p), np.log(1 - p)) - weight


def choose(page: Page, p: np.ndarray) -> np.ndarray:
    """The choices of the largest sum, from the leaves up. An element without text is dropped, at no score."""
    keep, drop, mixed = choice_scores(page, p)
    pick = np.full(len(page.tag), DROPPED)
    for i in range(len(page.tag) - 1, -1, -1):  # children come after their parent
        best = 0.0
        if page.begin[i] < page.end[i]:
            options = (keep[i], drop[i], mixed[i])
            pick[i] = int(np.argmax(options))
            best = options[pick[i]]
        q = page.parent[i]
        if q >= 0:
            keep[q] += keep[i]
            drop[q] += drop[i]
            mixed[q] += best
    return pick


def extract(sources: list[str | None], model: dict) -> list[str]:
    """Main text of each page: kept blocks in page order, joined by line breaks."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    x = [node_features(page) for page in pages]
    p = np.split(predict(model, np.concatenate(x)), np.cumsum([len(v) for v in x])[:-1])
    return ["\n".join([t for t, k in zip(page.text, decode(page, q)) if k]) for page, q in zip(pages, p)]


def train(pages: int = 700, seed: int = 7) -> dict:
    """Boosted trees fitted on ``pages`` composed pages; the same at every run."""
    from paneltide.llm.html_pages import training_page, vocabulary

    rng = np.random.default_rng(seed)
    xs, ys = [], []
    words = vocabulary(rng)
    for _ in range(pages):
        source, article = training_page(rng, words)
        page = Page(source)
        truth = np.array([t in article for t in page.text], float) * [len(t) for t in page.text]
        share = np.r_[0, np.cumsum(truth)]
        size = np.r_[0, np.cumsum([len(t) for t in page.text])]
        b, e = np.array(page.begin), np.array(page.end)
        part = (share[e] - share[b]) / np.maximum(size[e] - size[b], 1)
        clear = (e > b) & ((part == 0) | (part == 1))
        xs.append(node_features(page)[clear])
        ys.append(part[clear])
    return boost(np.concatenate(xs), np.concatenate(ys))


def _extract(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "html", 2 << 20):
                texts = extract(batch.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def _texts(rows: DataFrame, model: dict | None) -> DataFrame:
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_extract(model or train()), f"row {kind}, text string")


def main_text(pages: DataFrame, model: dict | None = None, source: str = "html") -> DataFrame:
    """``row`` (all columns of ``pages``) and ``text``, the page's main text, empty if it has none.

    Null and empty pages have none. Code, the head, and the controls of forms are never text; all other text is left to
    the trees to judge. A tag that never ends is dropped as markup. Repeated rows are read each, ties do not arise; an
    empty table stays empty; columns of any name stay inside ``row``.
    """
    return _texts(pages.select(F.struct("*").alias("row"), F.col(source).alias("html")), model)


def digest(pages: DataFrame) -> DataFrame:
    """The query's rows, one for each row of ``pages``; null and empty pages have an empty text. See :func:`main_text`."""
    out = _texts(pages.select(F.struct("page_id", "url").alias("row"), "html"), None)
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
