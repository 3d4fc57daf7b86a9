import os
import re

import numpy as np
import pytest

from hostweave.llm import html_text

FOLDER = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in html_text.leaf_blocks(page)]


@pytest.mark.parametrize("page, blocks", [
    ("", []), ("plain", ["plain"]), ("a < b & c", ["a < b & c"]), ("<p>a<b>b</b> c<p>d", ["ab c", "d"]),
    ("<p>x &amp;amp; y&nbsp;\n z</p>", ["x &amp; y z"]), ("<p>a<br>b", ["a b"]), ("<!-- <p>x</p> -->y", ["y"]),
    ("<script>if (a<b) '</p>'</script>z<style>p{}</style>", ["z"]), ("<script>never closed", []),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]), ("<P CLASS='>'>a</P>", ["a"]),
    ("<table><tr><td>a<td>b</table>", ["a", "b"]), ("</div></p>x<div", ["x"]), ("<title>t</title><h1>h</h1>", ["h"]),
])
def test_leaf_blocks(page, blocks):
    assert texts(page) == blocks


@pytest.mark.parametrize("page, blocks", [
    ('<svg class="icon"/><article><p>a</article>', ["a"]), ("<p>a<svg />b<p>c<svg><text>t</text></svg>d", ["a", "b", "c", "d"]),
    ("<svg><svg><text>t</text></svg><text>u</text></SVG >x", ["x"]), ("<svg><svg x='/'/><text>t</text></svg>x", ["x"]),
    ("<svg><!-- </svg> --><text>t</text></svg>x", ["x"]), ("<svg><svg><text>t</text></svg><p>x", ["x"]),
    ("a<svg><text>never closed", ["a"]), ("<svg><svg></svg><p>x<svg></svg>y", ["x", "y"]),
    ("<svg><foreignObject><p>t</p></foreignObject></svg>x", ["x"]),
])
def test_leaf_blocks_beside_svg(page, blocks):
    assert texts(page) == blocks


@pytest.mark.parametrize("page, blocks", [
    ("<p class=it's>Hello there</p><p>We don't stop here</p>", ["Hello there", "We don't stop here"]),
    ("<p class=it's>Hello", ["Hello"]), ('<a href="x>y">z</a><p title=\'a>b\'>c', ["z", "c"]), ('<p x"y=1>q</p>', ["q"]),
    ("<p class= >x", ["x"]), ("<p class=>x", ["x"]), ("<p =a='>'>x", ["x"]), ("<p a = b>x", ["x"]), ("<p/class=x/>y", ["y"]),
    ("<template><template>x</template>leak</template>ok", ["ok"]), ("<template>x", []),
    ("<template><script></template></script>y</template>z", ["z"]), ("<title>a</titles></title >b", ["b"]),
    ("<!-->a<!--->b<!-- c --!>d", ["abd"]), ("a</>b</3 x>c", ["abc"]), ("a<3 b < c", ["a<3 b < c"]), ("x<p a='never closed", ["x"])])
def test_attributes_and_templates(page, blocks):
    assert texts(page) == blocks


def plain_tags(page):
    """Tags and texts of a page, character by character; no raw elements, comments or declarations."""
    out, at, size, text = [], 0, len(page), ""
    gap = "\t\n\f\r "
    while at < size:
        close = page[at + 1:at + 2] == "/"
        first = page[at + 1 + close:at + 2 + close]
        if page[at] != "<" or not (first.isascii() and first.isalpha()):
            text, at = text + page[at], at + 1
            continue
        i, name = at + 1 + close, ""
        while i < size and page[i] not in gap + "/>":
            name, i = name + page[i], i + 1
        attributes = []
        while i < size and page[i] != ">":
            if page[i] in gap + "/":
                i += 1
                continue
            key = page[i]
            i += 1
            while i < size and page[i] not in gap + "/>=":
                key, i = key + page[i], i + 1
            k = i
            while k < size and page[k] in gap:
                k += 1
            value = None
            if k < size and page[k] == "=":
                i = k + 1
                while i < size and page[i] in gap:
                    i += 1
                value = ""
                if i < size and page[i] in "\"'":
                    end = page.find(page[i], i + 1)
                    end = size if end < 0 else end
                    value, i = page[i + 1:end], end + 1
                else:
                    while i < size and page[i] not in gap + ">":
                        value, i = value + page[i], i + 1
            attributes.append((key, value))
        if text:
            out.append(text)
            text = ""
        at = min(size, i + 1)
        out.append((close, name, attributes))
    return out + [text] if text else out


def unquoted(value):
    if value[:1] not in ("'", '"'):
        return value
    return value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]


def test_tokens_against_a_plain_reader():
    import random

    r = random.Random(3)
    parts = ["<", ">", "/", "=", "'", '"', " ", "\n", "a", "p", "class", "id=x", "<p ", "</p>", "<div class=", "=\"a b\"", "='c'", "z"]
    for _ in range(20_000):
        page = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        got, at, text = [], 0, ""
        if re.search("</[^A-Za-z]|</$", page):
            continue  # comments of another kind
        while m := html_text._next_token(page, at):
            text = text + page[at:m.start()]
            if text:
                got.append(text)
            text, at = "", m.end()
            got.append((bool(m.group(1)), m.group(2), [(n, unquoted(v)) for n, v in html_text._NAMES.findall(m.group(3)) if n]))
        if page[at:]:
            got.append(page[at:])
        want = [x if isinstance(x, str) else (x[0], x[1], [
            (k, v) for k, v in x[2] if k.lower() in ("class", "id", "role") and v]) for x in plain_tags(page)]
        clean = [x if isinstance(x, str) else (x[0], x[1], [(k, v) for k, v in x[2] if v]) for x in got]
        assert clean == want, page


@pytest.mark.parametrize("page", [
    "<a " * 330_000 + '"', "<" * 10**6, "<p><button>" + "<div>" * 100_000, "<p class='" * 100_000, "<svg><svg></svg>" * 60_000,
    "<template>" * 100_000, "".join(f"<div class=c{i}>x" for i in range(20_000)), "<!--" * 250_000, "<p a   " * 140_000,
    "<table><p>" * 50_000 + "<li>" * 50_000, "<x a = " * 140_000])
def test_long_malformed_pages(page):
    """Work grows with the page's length: nothing is read again from every tag on."""
    import time

    weights = html_text.trained().weights.tolist()
    start = time.process_time()
    html_text.leaf_blocks(page, weights)
    assert time.process_time() - start < 6


def test_no_depth_is_forgotten():
    model = html_text.trained()
    weights = model.weights.tolist()
    for depth in (10, 40, 200):
        deep = "<div>" * depth + "<nav><ul><li><a href=/>Home and more</a></ul></nav>" + "<div>" * depth + "</div>" * 2 * depth
        page = f"<body>{deep}<article><h1>Head</h1><p>First text of it.</article>"
        assert html_text.main_text(page, model, weights) == "Head\nFirst text of it."
        inside = "<body><nav>" + "<div>" * depth + "<p>Menu words here" + "</div>" * depth + "</nav><article><p>Text of it.</article>"
        assert html_text.main_text(inside, model, weights) == "Text of it."


def test_summed_weights_equal_listed_features():
    model = html_text.trained()
    weights = model.weights.tolist()
    for page, _ in html_text.labelled_pages(40, seed=7):
        listed, summed = html_text.leaf_blocks(page), html_text.leaf_blocks(page, weights)
        assert [b.text for b in listed] == [b.text for b in summed]
        for a, b in zip(listed, summed):
            assert np.allclose(b.score, model.weights[list(a.context)].sum(axis=0))


def test_marginals_and_viterbi_against_all_sequences():
    r = np.random.default_rng(0)
    model = html_text.Field()
    model.weights, model.steps = r.normal(size=model.weights.shape), r.normal(size=(2, 2))
    rows = [list(r.integers(0, html_text.BUCKETS, 4)) for _ in range(6)]
    scores = model._scores(rows)
    ways = [[(n >> k) & 1 for k in range(6)] for n in range(64)]
    value = [sum(scores[k][y] for k, y in enumerate(w)) + sum(model.steps[a, b] for a, b in zip(w, w[1:])) for w in ways]
    p = np.exp(value) / np.exp(value).sum()
    node, pair = model._marginals(scores)
    for k in range(6):
        assert np.allclose(node[k], [sum(q for q, w in zip(p, ways) if w[k] == y) for y in (0, 1)])
    assert np.allclose(pair[1, 0], sum(q * sum((a, b) == (1, 0) for a, b in zip(w, w[1:])) for q, w in zip(p, ways)))
    assert model.decode(rows) == ways[int(np.argmax(value))]
    assert model.decode([]) == []


def test_held_out_layouts():
    model, right, total = html_text.trained(), 0, 0
    for page, labels in html_text.labelled_pages(150, seed=99):
        got = model.decode([html_text.features(b) for b in html_text.leaf_blocks(page)])
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


PAGE = ("<html><head><title>t</title></head><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie notice'>We use cookies.</div><article><h1>Head</h1><p>First  <a href=x>link</a>.<p>Second.</article>"
        "<aside><h3>More</h3><ul><li><a href=y>Other</a></ul></aside><form><label>Search</label></form>"
        "<section class='comments'><h3>Comments</h3><p>I agree with this.</p></section><footer>&copy; Site</footer></body></html>")


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<nav>menu</nav>"), (1, "u", PAGE),
            (4, "u", "<div>" * 30_000 + "<article><p>deep</p>"), (5, "u", "<article><p>" + "long words. " * 50_000)]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id bigint, url string, html string, label int, text string")
    got = html_text.extracted(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == "Head\nFirst link.\nSecond." and by_id[1].n_chars == len(by_id[1].text)
    assert by_id[2].text == by_id[3].text == by_id[None].text == ""
    assert by_id[5].text == ("long words. " * 50_000).strip()
    assert html_text.extracted(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_pages(spark):
    """The article element's blocks, cut out by a plain pattern."""
    import html

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", " ", p))).strip()
                 for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
