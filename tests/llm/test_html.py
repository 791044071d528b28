from __future__ import annotations

import pytest

from weft.llm.html import extract, extract_pages

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<h1>T</h1>x<h2>U</h2>", "T\n\nx\n\nU"),
    ("<ul><li>x<li>y</ul>z", "- x\n- y\n\nz"),
    ("<ol><li>x<li>y<ul><li>in</ul><li>z</ol>", "1. x\n2. y\n   - in\n3. z"),
    ("<ol start=4><li>d<li>e</ol>", "4. d\n5. e"),
    ("<table><tr><th>Name<th>N<tr><td>Foo bar<td>1<tr><td>x<td>22</table>after", "Name     N\nFoo bar  1\nx        22\n\nafter"),
    ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na  b"),
    ("<table><tr><td>a<td>b<tr><td colspan=2>over both</table>", "a  b\nover both"),
    ("<table><tbody><td>no row</table>", "no row"),
    ("<table><tr><td>中文<td>1<tr><td>abcde<td>2</table>", "中文   1\nabcde  2"),
    ("<table><tr><td><p>in<ul><li>q</ul></td><td>r</td></tr></table>", "in   r\n\n- q"),
    ("<table><tr><td>o<table><tr><td>i</table></td><td>p</table>", "o  p\n\ni"),
    ("<pre>\na\n  b</pre>c", "a\n  b\n\nc"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<head><title>no</title></head><body>yes", "yes"),
    ("<title>no</title><p>yes", "yes"),
    ("<script>var x='</p>';</script>s<style>p{}</style><noscript>n</noscript>", "s"),
    ("a<span hidden>b</span><span style='color:red; DISPLAY : none'>c</span><span style=\"visibility:hidden\">d</span>e", "ae"),
    ("<input value=x>s<select><option>1<option>2</select>t<template>u</template>", "s 1 t"),
    ("<select><option>1<optgroup label=g><option selected>2</optgroup></select>", "2"),
    ("<select multiple><option>1<option>2</select>z", "1\n2\nz"),
    ("a<svg><title/><defs><text>no</text></defs><path d=x /><text>in</text><text>drawing</text></svg>b", "a in drawing b"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "x=1"),
    ("<table><tr><td><h1>T</h1><p>one</p><p>two</p><ul><li>a<li>b</ul></table>", "T\n\none\n\ntwo\n\n- a\n- b"),
    ("<table><tr><td><p>one<p>two<td>side<tr><td>x<td><ol><li>p<li>q</ol></table>", "one  side\n\ntwo\nx    1. p\n     2. q"),
    ("<table><tr><td>" + "w" * 200 + "<td>a<tr><td>b<td>c</table>", "w" * 200 + "  a\nb  c"),
    ("<table><tr><td colspan=900>s<td>t<tr><td>a<td>b</table>", "s     t\na  b"),
    ("x<!-- no > still no -->y<!-- open", "xy"),
    ("&lt;b&gt; &amp; &eacute;&nbsp;&#65;", "<b> & é A"),
    ("</p></div>stray</li>", "stray"),
    ("<p><b>bold<p>more</b> text", "bold\n\nmore text"),
    ("<a title='a>b'>link</a> <b>x</b>y", "link xy"),
    ("<p>a <i> b </i> c", "a b c"),
    ("one<hr>two", "one\n\n---\n\ntwo"),
    ("<textarea><b>raw</b></textarea>", "<b>raw</b>"),
    ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
    ("<div>unclosed <b", "unclosed"),
    ("5 < 6 and <3", "5 < 6 and <3"),
]


@pytest.mark.parametrize(("markup", "text"), CASES)
def test_layout(markup, text):
    assert extract(markup) == text


def test_every_visible_word_survives_in_order():
    markup = "<table>" + "".join(f"<tr><td>r{k}<td><ul><li>i{k}</ul>" for k in range(50)) + "</table>" + "".join(f"<p>p{k}" for k in range(50))
    assert extract(markup).replace("- ", "").split() == [w for k in range(50) for w in (f"r{k}", f"i{k}")] + [f"p{k}" for k in range(50)]


def test_depth_and_length():
    assert extract("<div>" * 30_000 + "deep") == "deep"
    assert extract("<b><i>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    assert len(extract("<p>word " * 40_000).split()) == 40_000


def test_wide_spans_cost_nothing():
    import time
    import tracemalloc

    markup = "<table>" + "<tr><td colspan=1000>x" * 60_000 + "</table>"
    start = time.monotonic()
    tracemalloc.start()
    small = extract(markup[:7] + "<tr><td colspan=1000>x<td>y" * 6_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and small.startswith("x  y\nx  y") and len(small.split()) == 12_000
    assert extract(markup) == "\n".join("x" * 60_000) and time.monotonic() - start < 60
    one = "<table><tr>" + "<td colspan=1000>x" * 60_000 + "</table>"
    assert extract(one) == "  ".join("x" * 60_000)


# A second renderer, for well-formed trees only: every element gives its finished lines, and whoever holds it joins them.


def stacked(items: list[tuple[bool, list[str], bool]]) -> tuple[bool, list[str], bool]:
    """Lines of items one below the other, each with whether blank lines are due before and after it; these collapse."""
    out: list[str] = []
    first = due = False
    for before, lines, after in items:
        due = due or before
        if lines:
            first = first if out else due
            out += [""] * bool(due and out) + lines
            due = False
        due = due or after
    return first, out, due


def plain_flow(children: list, in_list: bool = False) -> tuple[bool, list[str], bool]:
    items: list[tuple[bool, list[str], bool]] = []
    for child in children:
        if isinstance(child, str):
            items.append((False, [child], False))
            continue
        name, inner = child
        if name == "ul":
            before, lines, after = stacked([plain_item(li[1]) for li in inner])
            items.append((before or not in_list, lines, after or not in_list))
        elif name == "table":
            items.append((True, plain_table(inner), True))
        else:
            before, lines, after = plain_flow(inner, in_list)
            items.append((before or name == "p", lines, after or name == "p"))
    return stacked(items)


def plain_item(children: list) -> tuple[bool, list[str], bool]:
    before, lines, after = plain_flow(children, True)
    return before, [("- " if k == 0 else "  ") + line if line else "" for k, line in enumerate(lines)], after


def plain_table(rows: list) -> list[str]:
    grid = [[plain_flow(cell[1])[1] for cell in row[1]] for row in rows]
    grid = [row for row in grid if any(row)]
    columns = max(map(len, grid), default=0)
    wide = [max((len(line) for row in grid if c < len(row) for line in row[c]), default=0) for c in range(columns)]
    out = []
    for row in grid:
        for k in range(max(map(len, row))):
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(wide[c]) for c, cell in enumerate(row)).rstrip())
    return out


def grown(rng, depth: int) -> list:
    """Children of a flow, with never two texts in a row."""
    out: list = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["text", "p", "div", "ul", "table"]) if depth else "text"
        if kind == "text":
            if not (out and isinstance(out[-1], str)):
                out.append("w" * rng.randrange(1, 6))
        elif kind == "p":
            out.append(("p", ["q" * rng.randrange(1, 5)]))
        elif kind == "div":
            out.append(("div", grown(rng, depth - 1)))
        elif kind == "ul":
            out.append(("ul", [("li", ["i", *[x for x in grown(rng, depth - 1) if not isinstance(x, str)]]) for _ in range(rng.randrange(1, 3))]))
        else:
            out.append(("table", [("tr", [("td", grown(rng, depth - 1)) for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 3))]))
    return out


def written(children: list) -> str:
    return "".join(x if isinstance(x, str) else f"<{x[0]}>{written(x[1])}</{x[0]}>" for x in children)


@pytest.mark.parametrize("seed", range(300))
def test_equals_a_second_renderer(seed):
    import random

    tree = grown(random.Random(seed), 3)
    assert extract(written(tree)).split("\n") == plain_flow(tree)[1]


def test_query(spark):
    rows = [(1, "<p>a<p>b"), (2, None), (3, ""), (1, "<p>a<p>b"), (None, "x")]
    df = spark.createDataFrame([(i, h, "t", 0) for i, h in rows], "page_id long, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract_pages(df).collect()), key=str)
    assert got == sorted([(i, extract(h or ""), len(extract(h or "")), len(extract(h or "").split("\n")) if h else 0) for i, h in rows], key=str)
    assert extract_pages(df.limit(0)).count() == 0
