"""Main text of web pages: a linear-chain CRF over the leaf blocks of the document tree.

A page becomes a sequence of leaf blocks, the texts between block-level tags. A
block's features are its ancestors' tags and class names and a few properties of
its text. The field has one weight for each feature and label and one for each
pair of neighbouring labels. It is trained, by gradient steps on the exact
likelihood, on labelled pages made here from many page layouts, and decoded by
Viterbi.
"""

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# One token of markup. A quote counts only behind "=", as in browsers; every part is taken whole,
# so a tag that never ends is read once, to the end of the page.
_GAP, _VALUE = r"[\t\n\f\r ]", r"(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r >\"'][^\t\n\f\r >]*+)"
_ATTRIBUTE = rf"[^\t\n\f\r />][^\t\n\f\r />=]*+(?>{_GAP}*+={_GAP}*+{_VALUE}?+)?+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)"
    rf"|<(/?)([A-Za-z][^\t\n\f\r />]*+)((?>[\t\n\f\r /]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMES = re.compile(rf"(?i)(class|id|role){_GAP}*+={_GAP}*+({_VALUE})|{_ATTRIBUTE}")
_PART = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

# How HTML treats its elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby"
    " s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp noembed noframes".split())
# Elements that end an open paragraph, and those that end one of their own kind.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
               "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Start tags that end an svg element, and elements of svg that hold HTML again.
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu"
    " meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_IN_SVG = frozenset("foreignobject desc title".split())

BUCKETS = 1 << 12
LABELS = 2  # 0: boilerplate, 1: main text


@dataclass
class Block:
    text: str
    context: tuple[int, ...]  # features of all its ancestors; empty where they are summed instead
    score: tuple[float, float]  # the sums of their weights
    linked: int  # characters inside links


@dataclass
class _Open:
    tag: str
    names: frozenset[str]


@functools.cache
def _bucket(name: str) -> int:
    value = 1469598103934665603
    for byte in name.encode():
        value = (value ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return (value ^ value >> 29) % BUCKETS


@functools.lru_cache(maxsize=50_000)
def _own_features(tag: str, names: frozenset[str]) -> tuple[int, ...]:
    return tuple({_bucket("in:" + tag), *(_bucket("name:" + w) for w in names)})


class _Builder:
    """Open elements and finished blocks. What the ancestors add to a block is counted as they open
    and close, at any depth; every tag knows where it is open, so nothing walks down the stack."""

    def __init__(self, weights: list[list[float]] | None) -> None:
        self.weights = weights
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.boxes: list[_Open] = []  # open elements that are not inline
        self.counts: dict[int, int] = {}  # features of those
        self.sums = [0.0, 0.0]  # of their weights
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def start(self, tag: str, names: frozenset[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        element = _Open(tag, names)
        self.stack.append(element)
        if tag not in INLINE:
            self.boxes.append(element)
            for f in _own_features(tag, names):
                n = self.counts.get(f, 0)
                self.counts[f] = n + 1
                if not n:
                    self._add(f, 1)

    def _add(self, feature: int, sign: int) -> None:
        if self.weights:
            a, b = self.weights[feature]
            self.sums[0] += sign * a
            self.sums[1] += sign * b

    def text(self, raw: str) -> None:
        if raw:
            value = html.unescape(raw) if "&" in raw else raw
            self.parts.append(value)
            if self.places.get("a"):
                self.linked += len(value)

    def _nearest(self) -> set[int]:
        """Features of the innermost box and of the place among articles, without those that are counted."""
        # an article inside an article is mostly a comment or a teaser
        found = {_bucket(f"articles:{min(2, len(self.places.get('article', ())))}")}
        if self.boxes:
            found.add(_bucket("own:" + self.boxes[-1].tag))
            found.update(_bucket("ownname:" + w) for w in self.boxes[-1].names)
        return {f for f in found if f not in self.counts}

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if text:
            near = self._nearest()
            if self.weights:
                self.blocks.append(Block(text, (), (
                    self.sums[0] + sum(self.weights[f][0] for f in near),
                    self.sums[1] + sum(self.weights[f][1] for f in near)), self.linked))
            else:
                self.blocks.append(Block(text, tuple(sorted(near | self.counts.keys())), (0.0, 0.0), self.linked))
        self.parts, self.linked = [], 0

    def close(self, tags: set[str], stop: frozenset[str]) -> None:
        """Close the innermost element of ``tags``, unless one of ``stop`` is open inside it, and what it holds."""
        at = -1
        for t in tags:
            if self.places.get(t):
                at = max(at, self.places[t][-1])
        if at < 0 or any(self.places[t][-1] > at for t in stop if self.places.get(t)):
            return
        while len(self.stack) > at:
            element = self.stack.pop()
            self.places[element.tag].pop()
            if element.tag not in INLINE:
                self.boxes.pop()
                for f in _own_features(element.tag, element.names):
                    self.counts[f] -= 1
                    if not self.counts[f]:
                        del self.counts[f]
                        self._add(f, -1)


_SCOPE = frozenset("table td th button object caption ul ol dl".split())
_NO_SCOPE: frozenset[str] = frozenset()


def _after_svg(page: str, at: int) -> int:
    """Where an svg element whose content starts at ``at`` ends, nested ones counted.

    Start tags of HTML end it too, as in browsers. If more are opened than closed,
    the last end tag ends it; without one, the page does.
    """
    depth, inner, last = 1, 0, len(page)
    for m in _TOKEN.finditer(page, at):
        tag, opens = (m.group(2) or "").lower(), not m.group(1)
        if opens and tag in ENDS_SVG and not inner:
            return m.start()
        if opens and (m.group(3) or "").endswith("/"):
            continue
        if tag in HTML_IN_SVG:
            inner = max(0, inner + (1 if opens else -1))
        elif tag == "svg":
            depth += 1 if opens else -1
            last = last if opens else m.end()
            if not depth:
                break
    return last


@functools.cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\t\n\f\r />])[^>]*+>", re.I)


def _after_raw(page: str, tag: str, at: int) -> int:
    """Where an element whose content is no markup ends; without an end tag, with the page."""
    end = _end_tag(tag).search(page, at)
    return end.end() if end else len(page)


def _after_template(page: str, at: int) -> int:
    """Where a template ends whose content starts at ``at``, nested ones counted."""
    depth = 1
    while m := _next_token(page, at):
        tag, at = (m.group(2) or "").lower(), m.end()
        if tag == "template":
            depth += -1 if m.group(1) else 1
            if not depth:
                return at
        elif tag in RAW and tag != "svg" and not m.group(1):
            at = _after_raw(page, tag, at)
    return len(page)


def _next_token(page: str, at: int) -> re.Match | None:
    """The first token of markup from ``at`` on; a "<" that starts none is text."""
    while (at := page.find("<", at)) >= 0:
        if m := _TOKEN.match(page, at):
            return m
        at += 1
    return None


def leaf_blocks(page: str, weights: list[list[float]] | None = None) -> list[Block]:
    """Blocks of a page in order; markup that is not closed or nested well is taken as browsers do.

    With ``weights`` of the features, blocks have the sums of their ancestors' weights, which
    takes the same memory however deep the page is, instead of the features themselves.
    """
    b, at = _Builder(weights), 0
    while m := _next_token(page, at):
        b.text(page[at:m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag, attributes = m.group(2).lower(), m.group(3)
        if tag == "br":
            b.parts.append("\n")
        elif m.group(1):
            if tag not in INLINE:
                b.flush()
            b.close({tag}, _NO_SCOPE)
        elif tag in RAW:
            b.flush()
            if tag == "svg":
                at = at if attributes.endswith("/") else _after_svg(page, at)
            else:
                at = _after_template(page, at) if tag == "template" else _after_raw(page, tag, at)
        else:
            if tag not in INLINE:
                b.flush()
                if tag in CLOSES_P:
                    b.close({"p"}, _SCOPE)
                if tag in CLOSES_SELF:
                    b.close(CLOSES_SELF[tag], _SCOPE - CLOSES_SELF[tag])
            if tag not in VOID and not attributes.endswith("/"):
                words = _NO_SCOPE if not attributes else frozenset(w for name, v in _NAMES.findall(attributes) if name for w in _PART.findall(v.lower()))
                b.start(tag, words)
    b.text(page[at:])
    b.flush()
    return b.blocks


def _text_features(block: Block) -> list[int]:
    text, size = block.text, len(block.text)
    own = ["bias", f"size:{min(3, size.bit_length() // 3)}", f"linked:{min(4, 5 * block.linked // max(size, 1))}",
           f"copyright:{'©' in text}"]
    return list(map(_bucket, own))


def features(block: Block) -> list[int]:
    """All features of a block that came with its context."""
    return [*block.context, *_text_features(block)]


class Field:
    """Weights of the chain and its training and decoding."""

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, LABELS))
        self.steps = np.zeros((LABELS, LABELS))

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows])

    def train(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = 6, rate: float = 0.4,
              decay: float = 1e-3, seed: int = 1) -> None:
        """Gradient steps page by page; a weight's steps shrink with the gradients it has seen."""
        r = random.Random(seed)
        order = list(range(len(pages)))
        seen, seen_steps = np.full_like(self.weights, 1e-6), np.full_like(self.steps, 1e-6)
        for _ in range(epochs):
            r.shuffle(order)
            for i in order:
                rows, labels = pages[i]
                if not rows:
                    continue
                node, pair = self._marginals(self._scores(rows))
                node[np.arange(len(rows)), labels] -= 1
                for a, b in zip(labels, labels[1:]):
                    pair[a, b] -= 1
                flat = np.concatenate([np.array(row) for row in rows])
                touched, where = np.unique(flat, return_inverse=True)
                slope = np.zeros((len(touched), LABELS))
                np.add.at(slope, where, np.repeat(node, [len(row) for row in rows], axis=0))
                slope += decay * self.weights[touched]
                seen[touched] += slope ** 2
                self.weights[touched] -= rate * slope / np.sqrt(seen[touched])
                pair += decay * self.steps
                seen_steps += pair ** 2
                self.steps -= rate * pair / np.sqrt(seen_steps)

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each block and summed probabilities of label pairs."""
        n = len(scores)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for k in range(1, n):
            ahead[k] = scores[k] + _logsum(ahead[k - 1][:, None] + self.steps)
        for k in range(n - 2, -1, -1):
            behind[k] = _logsum((self.steps + scores[k + 1] + behind[k + 1]).T)
        total = _logsum(ahead[-1][:, None])[0]
        node = np.exp(ahead + behind - total)
        pair = np.zeros_like(self.steps)
        if n > 1:
            pair = np.exp(ahead[:-1, :, None] + self.steps + (scores + behind)[1:, None, :] - total).sum(axis=0)
        return node, pair

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest sequence of labels."""
        return self.best(self._scores(rows).tolist()) if rows else []

    def best(self, scores: list[list[float]]) -> list[int]:
        """The same from the blocks' own scores."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            back.append((a + s00 < b + s10, a + s01 < b + s11))
            a, b = x + max(a + s00, b + s10), y + max(a + s01, b + s11)
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def _logsum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the first axis."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


# Names that layouts give to their parts, by what the part is.
_MAIN = ["content", "post", "entry", "story", "article-body", "main-content", "post-content", "body", "text"]
_OTHER = {
    "nav": ["menu", "nav", "navbar", "breadcrumb", "navigation", "toc"],
    "header": ["header", "masthead", "site-header", "top", "banner", "branding"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal"],
    "aside": ["sidebar", "related", "widget", "aside", "popular", "teaser", "recommended"],
    "notice": ["cookie", "notice", "consent", "alert", "banner", "popup", "gdpr", "modal", "warning", "newsletter"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "advertisement", "banner-ad"],
    "form": ["form", "search", "login", "subscribe", "signup", "contact"],
    "comments": ["comments", "comment", "replies", "discussion", "responses", "comment-list", "disqus"],
    "share": ["share", "social", "tags", "meta", "author", "byline", "pagination"],
}
_CONSONANTS, _VOWELS = "bcdfghklmnprstvz", "aeiou"


class _Layouts:
    """Random pages with the label of every block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4)))
                for _ in range(r.randint(low, high))]
        made = [w + r.choice(["", "", "", ",", "!!", " |", "***"]) if r.random() < 0.2 else w for w in made]
        return " ".join(made).capitalize() + r.choice([".", ".", "", ""])

    def named(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.1:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{r.choice(_OTHER[kind])}{r.choice(["", "", " box", " x1"])}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(n))

    def boilerplate(self, kind: str) -> str:
        r, w = self.r, self.words
        name = self.named(kind)
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"],
               "aside": ["aside", "div", "section"], "form": ["form"], "comments": ["section", "div", "ol"],
               }.get(kind, ["div", "section", "div", "p", "aside"])
        chosen = r.choice(tag)
        if chosen in ("div", "section", "p", "ol", "ul") and not name:
            name = f' class="{r.choice(_OTHER[kind])}"'
        long = "".join(f"<p>{w(3, 60)}</p>" for _ in range(r.randint(1, 4)))
        inner = {
            "nav": lambda: f"<ul>{self.links(r.randint(3, 8))}</ul>",
            "header": lambda: r.choice([f"<p>{w(2, 8)}</p>", f"<h1>{w(1, 4)}</h1>", w(1, 6)]) + f"<a href='/'>{w(1, 3)}</a>",
            "footer": lambda: r.choice(["&copy; ", "", "Copyright "]) + w(2, 25) + r.choice(["", f"<ul>{self.links(3)}</ul>", long]),
            "aside": lambda: f"<h3>{w(1, 4)}</h3>" + r.choice([f"<ul>{self.links(4)}</ul>", long, w(5, 40)]),
            "notice": lambda: r.choice([w(5, 40), long]) + r.choice(["", f"<button>{w(1, 2)}</button>"]),
            "advert": lambda: r.choice([w(3, 40), f"<a href='/x'>{w(2, 9)}</a>", long]),
            "form": lambda: f"<label>{w(1, 4)}</label><input name='q'><button>{w(1, 2)}</button>" + r.choice(["", f"<p>{w(4, 25)}</p>"]),
            "comments": lambda: f"<h3>{w(1, 3)}</h3>" + "".join(
                r.choice(["<li>{}</li>", "<div class='comment'><p>{}</p></div>", "<article><p>{}</p></article>"]).format(w(3, 50))
                for _ in range(r.randint(1, 5))),
            "share": lambda: w(1, 8) + f"<a href='/s'>{w(1, 2)}</a>",
        }[kind]()
        if chosen == "p":
            inner = w(3, 40)
        return f"<{chosen}{name}>{inner}</{chosen}>"

    def paragraph(self) -> str:
        r, w = self.r, self.words
        text = w(1, 90)
        kind = r.random()
        if kind < 0.08:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{w(1, 8)}</{h}>"
        if kind < 0.14:
            return "<ul>" + "".join(f"<li>{w(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.18:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.21:
            return f"<pre>{text}</pre>"
        if kind < 0.24:
            return f"<figure><figcaption>{w(2, 12)}</figcaption></figure>"
        if kind < 0.27:
            return "<table>" + "".join(f"<tr><td>{w(1, 4)}</td><td>{w(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.4:
            text += f" <a href='/y'>{w(1, 5)}</a> {w(1, 20)}"
        if kind < 0.5:
            text = f"<b>{text}<br>"
        return f"<p>{text}" + r.choice(["</p>", "</p>", ""])

    def page(self) -> list[tuple[str, int]]:
        """Pieces of markup with the label of their blocks; -1: structure without text."""
        r, out = self.r, []

        def add(kinds: list[str], chance: float) -> None:
            out.extend((self.boilerplate(k), 0) for k in kinds if r.random() < chance)

        out.append((f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>", -1))
        before = ["header", "nav", "notice", "advert", "form", "aside"]
        r.shuffle(before)
        add(before, 0.45)
        opening = r.choice(["<article>", "<article>", "<article class='post'>", "<main>", "<main><article>", "<div class='{}'>", "<div id='{}'>",
                            "<article><div class='{}'>"]).format(r.choice(_MAIN))
        out.append((opening, -1))
        if r.random() < 0.85:
            h1 = f"<h1>{self.words(1, 12)}</h1>"
            out.append((f"<header>{h1}</header>" if opening.startswith("<article") and r.random() < 0.15 else h1, 1))
        if r.random() < 0.2:
            out.append((self.boilerplate("share"), 0))
        inside = ["aside", "advert", "form", "notice", "comments", "share"]
        for _ in range(r.choice([0, 1, 2, 4, 8, 15])):
            out.append((self.paragraph(), 1))
            if r.random() < 0.08:
                out.append((self.boilerplate(r.choice(inside)), 0))
        add(["share", "comments", "aside"], 0.15)
        out.append(("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening))), -1))
        after = ["comments", "aside", "advert", "form", "notice", "nav"]
        r.shuffle(after)
        add(after, 0.3)
        add(["footer"], 0.85)
        return out


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    """Pages of random layouts and the label of each of their leaf blocks."""
    made, layouts = [], _Layouts(seed)
    while len(made) < count:
        pieces, page, labels = layouts.page(), "", []
        for piece, label in pieces:
            page += piece
            if label >= 0:
                labels += [label] * (len(leaf_blocks(page)) - len(labels))
        if len(leaf_blocks(page)) == len(labels):
            made.append((page, labels))
    return made


@functools.cache
def trained(pages: int = 600, seed: int = 20) -> Field:
    """The field trained on labelled pages; the same wherever it is made."""
    model = Field()
    model.train([([features(b) for b in leaf_blocks(p)], labels) for p, labels in labelled_pages(pages, seed)])
    return model


def main_text(page: str, model: Field, weights: list[list[float]]) -> str:
    """``weights`` are the model's, as a list."""
    blocks = leaf_blocks(page, weights)
    scores = []
    for b in blocks:
        own = [weights[f] for f in _text_features(b)]
        scores.append([b.score[k] + sum(w[k] for w in own) for k in range(LABELS)])
    return "\n".join(b.text for b, label in zip(blocks, model.best(scores)) if label)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (the blocks of the main text, one per line) and n_chars.

    A block's white space becomes single spaces, character references are decoded,
    a line break element counts as white space. Null and empty pages and pages
    without main text have an empty text. Repeated rows and null ids give rows of
    their own; other columns are ignored.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(trained())
    fields = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        weights = model.weights.tolist()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(p, model, weights) if p else "" for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars bigint")
