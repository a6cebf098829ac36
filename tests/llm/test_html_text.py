"""HTML rendering: layouts by example, and all visible words against a plain parser."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from lacuna.llm.html_text import digest, extract_text, render

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a<div>b</div>c</div>d": "a\nb\nc\nd",
    "a <b> b</b>  c\n<i>d</i>e": "a b c de",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "<h1>T</h1>text<hr>more": "T\n\ntext\n\nmore",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=9><li>a</li><li>b</li></ol>": "9. a\n10. b",
    "<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>": "name       n\nlong name  1\nx          22",
    "<table><caption>C</caption><tbody><tr><td colspan=2>wide cell<td>z</tr><tr><td>a</td><td>b</td><td>c</td></tr></table>after": "C\nwide cell  z\na  b  c\n\nafter",
    "<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>": "a        b\n\nin  ner",
    "<td>loose": "loose",
    "<pre>a  b\n  c</pre>d": "a  b\n  c\n\nd",
    "<script>no()</script><style>p{}</style><!-- no -->yes<template>no</template>": "yes",
    "<head><title>t</title></head><body>b": "b",
    "<p hidden>no</p><div style='Display : none'>no<p>no</div>yes<span style=visibility:hidden>no</span>": "yes",
    "<details><summary>s</summary>no<p>no</p></details><details open><summary>s</summary>yes</details>": "s\ns\nyes",
    "&lt;p&gt; &amp;amp; &eacute;&#x41;": "<p> &amp; éA",
    "a < b <c": "a < b",
    "<a href='>'>x</a><a title=\"<p>\">y</a>": "xy",
    "<textarea>a&lt;\n b</textarea><button>k</button>": "a<\n b\nk",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<blockquote>q<p>r</blockquote>": "    q\n\n    r",
    "</p></div>x</table>y": "xy",
    "<select><option>a<option>b</select>": "a\nb",
    "": "",
    "<!DOCTYPE html><?x y?>z": "z",
    "<script>never closed": "",
    "<li>a<li>b": "- a\n- b",
    "<p> nbsp </p>": " nbsp",
}


CASES |= {
    "<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>": "ab",
    "<ol reversed><li>a<li>b<li>c</ol>": "3. a\n2. b\n1. c",
    "<ol reversed start=9><li>a<li>b</ol>": "9. a\n8. b",
    "<ol><li>a<li value=5>b<li>c<li value=x>d</ol>": "1. a\n5. b\n6. c\n7. d",
    "<ol reversed><li>a<li value=10>b<li>c</ol>": "3. a\n10. b\n9. c",
    "<style>p{display:none!important}</style><p style='display:block'>no</p>yes": "yes",
    "<style>p{display:none!important} p{display:block}</style><p>no</p><p style='display:block !important'>yes": "yes",
    "<style>div p{display:none}</style><p>yes</p><div><b><p>no</p></b></div><p>too": "yes\n\ntoo",
    "<style>.a .b i{display:none}</style><i>1</i><u class=a><i>2</i><u class='x b'><i>no</i></u></u><u class=b><u class=a><i>3</i></u></u>": "123",
    "<style>@media print{p{display:none}} @media screen{b{display:none}} @media (max-width:9px){i{display:none}}</style><p>p<b>no</b><i>i": "pi",
    "<style>.x{display:none} #k{display:inline}</style><b class=x>no</b><b class=x id=k>yes</b>": "yes",
    "<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e<td>f<tr><td>g</table>": "a  b  c\n      d\n   e  f\ng",
    "<table><tr><td rowspan=2>a<td colspan=2>bb<td>c<tr><td>d<td>e<td>f</table>": "a  bb    c\n   d  e  f",
    "<table><tr><td>a</i><td>b</table>": "a  b",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert render(html) == CASES[html]


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_no_visible_word_is_lost():
    r = random.Random(1)
    tags = "p div ul li ol table tr td b i span h2 pre blockquote dl dt dd section".split()
    for _ in range(300):
        parts, k = [], 0
        for _ in range(r.randrange(1, 60)):
            x = r.random()
            t = r.choice(tags)
            if x < 0.4:
                parts.append(f"<{t}>")
            elif x < 0.6:
                parts.append(f"</{t}>")
            elif x < 0.65:
                parts.append("<script>var x = '<p>';</script>")
            else:
                parts.append(f" word{k} ")
                k += 1
        html = "".join(parts)
        plain = Words()
        plain.feed(html)
        plain.close()
        want = sorted(re.findall(r"word\d+", " ".join(plain.out)))
        assert sorted(re.findall(r"word\d+", render(html))) == want, html


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<a " * 300_000, "<a href=\"" * 200_000, "<p>x" * 100_000, "<table><tr><td>" * 3000 + "x", "<ul><li>" * 20_000 + "x", "<!--" * 200_000, "&" * 500_000, "<table><tr><td>" + "y" * 200_000 + "<td>z" + "<tr><td>a<td>b" * 2000])
def test_long_and_deep_pages_take_little_time(html):
    began = time.process_time()
    render(html)
    assert time.process_time() - began < 20


SLOW = {
    "wide spans": "<table><tr>" + "<td rowspan=65534 colspan=1000>" * 2000,
    "spans row by row": "<table>" + "<tr><td rowspan=65534>a" * 5000,
    "short and long spans": "<table>" + "<tr><td rowspan=65534>a<td rowspan=2>b" * 4000,
    "stray end tags": "<i><table><tr><td>" + "<span>" * 4000 + "</i>" * 16_000,
    "stray items": "<div>" * 5000 + "<table><tr><td>" + "<b>" * 5000 + "<li>x" * 5000,
    "long sheet": "<style>" + "".join(f".c{k} #i{k} b{{display:none}} p.c{k}{{visibility:hidden}}" for k in range(2000)) + "</style>" + "".join(f"<p class=c{k} id=i{k}>x</p>" for k in range(4000)),
    "deep under rules": "<style>div b{display:none} .x .y{display:none}</style>" + "<div class=x>" * 20_000 + "<b>no</b>",
}


@pytest.mark.parametrize("name", SLOW)
def test_awkward_pages_take_little_time(name):
    began = time.process_time()
    render(SLOW[name])
    assert time.process_time() - began < 2


class Node:
    """A tree whose text is known by construction: another renderer, top down, for the elements of the test below."""

    def __init__(self, tag, children, gone=False, **attributes):
        self.tag, self.children, self.hidden, self.attributes = tag, list(children), gone, attributes

    def html(self, r):
        inner = "".join(c if isinstance(c, str) else c.html(r) for c in self.children)
        end = "" if self.tag in ("td", "tr") and r.random() < 0.5 else f"</{self.tag}>"
        return f"<{self.tag}" + "".join(f" {k.rstrip('_')}={v}" for k, v in self.attributes.items()) + f">{inner}{end}"

    def blocks(self, indent=0):
        """Lines of the element's blocks; text stands alone in these trees."""
        if self.hidden:
            return []
        if self.tag == "table":
            return [(indent, x) for x in self.grid()]
        out = []
        for k, c in enumerate(x for x in self.children if isinstance(x, str) or not x.hidden):
            if isinstance(c, str):
                out.append((indent, c))
            elif self.tag == "ol":
                own = c.blocks(0)
                mark = f"{k + 1}. "
                out += [(indent, (mark if j == 0 else " " * len(mark)) + " " * i + x) for j, (i, x) in enumerate(own)]
            else:
                out += c.blocks(indent)
        return out

    def grid(self):
        rows, taken = [], {}
        for y, tr in enumerate(self.children):
            x, row = 0, {}
            for td in tr.children:
                while (y, x) in taken:
                    x += 1
                w, h = int(td.attributes.get("colspan", 1)), int(td.attributes.get("rowspan", 1))
                row[x] = (td.children[0], w)
                taken.update({(y + j, x + i): 1 for j in range(1, h) for i in range(w)})
                x += w
            rows.append(row)
        width = {}
        for row in rows:
            for x, (t, w) in row.items():
                if w == 1:
                    width[x] = max(width.get(x, 0), len(t))
        left = lambda x: sum(width[c] + 2 for c in range(x) if width.get(c))
        out = []
        for row in rows:
            line = ""
            for x, (t, _) in sorted(row.items()):
                line = line.ljust(left(x)) + t + "  "
            out.append(line.rstrip())
        return out


def tree(r, depth=0):
    word = lambda: "".join(r.choices("abcdef", k=r.randrange(1, 7)))
    kind = r.choice(["p", "p", "div", "ol", "table"] if depth < 3 else ["p"])
    hide = r.random() < 0.2
    how = r.choice([{"hidden": "hidden"}, {"style": "display:none"}, {"class_": "gone"}, {"id": "away"}]) if hide else r.choice([{}, {"class_": "seen"}])
    if kind == "p":
        return Node("p", [word()], hide, **how)
    if kind == "div":
        return Node("div", [tree(r, depth + 1) for _ in range(r.randrange(1, 4))], hide, **how)
    if kind == "ol":
        return Node("ol", [Node("li", [word()]) for _ in range(r.randrange(1, 12))], hide, **how)
    cells = lambda: Node("td", [word()], **{k: r.randrange(1, 4) for k in ("rowspan", "colspan") if r.random() < 0.3})
    return Node("table", [Node("tr", [cells() for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(1, 5))], hide, **how)


def test_random_trees_against_another_renderer():
    r = random.Random(11)
    sheet = "<style>.gone{display:none} div#away, p#away, #away{display:none!important}</style>"
    for _ in range(400):
        page = Node("div", [tree(r) for _ in range(r.randrange(1, 5))])
        want = [(" " * i + x).rstrip() for i, x in page.blocks()]
        got = [x for x in render(sheet + page.html(r)).split("\n") if x]
        assert got == [x for x in want if x], page.html(random.Random(0))


def test_query_shape(spark):
    rows = [(1, "<p>a", "z"), (1, "<p>a", "z"), (2, None, None), (None, "", "t")]
    got = digest(extract_text(spark.createDataFrame(rows, "page_id long, html string, text string"))).collect()
    assert sorted((str(g.page_id), g.text, g.n_chars) for g in got) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("None", "", 0)]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
