import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attrition.llm import html_layout as h
from tests.llm.cases import as_set

CASES = [
    ("", ""), (None, ""), ("plain", "plain"), ("a  b\n c", "a b c"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>x</div><div>y</div>", "x\ny"), ("x <b>y</b>z <i> w</i>", "x yz w"), ("<head><title>T</title></head>t<script>a<b</script>u<style>p{}</style>", "tu"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"), ("<ul><li><p>x</p><p>y</p></ul>", "- x\n\n  y"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   N\nalpha  1\nb      22"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<table><tr><td colspan=2>wide<tr><td>aa<td>b</table>", "wide\naa  b"),
    ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        y\nin  ner"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("a<!-- x --> b<!doctype x>c<!-- open", "a bc"), ("1 &lt; 2 &amp;&nbsp;3 &copy", "1 < 2 & 3 ©"),
    ("<p hidden>a</p><p style='color:red; DISPLAY : none'>b</p><dialog>c</dialog><p>d", "d"),
    ("<style>.x, #y { display:none } q>z{display:none}</style><i class='w x'>a</i><i id=y>b</i><i class=xx>c</i>", "c"),
    ("<details>a<summary>s</summary>b</details><details open><summary>t</summary>c</details>", "s\nt\nc"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("a</b></div>b<p></i>c", "ab\n\nc"), ("<h1>t</h1>x", "t\n\nx"),
    ("<textarea>a\nb</textarea>", "a\nb"), ("x < y > z <3", "x < y > z <3"), ("<a title='>'>q</a>", "q"), ("<video>fallback</video><img alt=no>z", "z"),
    ("<li>loose</li>", "- loose"), ("<td>cell</td>", "cell"), ("<p>a<table><tr><td>b</table>", "a\n\nb"), ("<ul><li></ul>x", "-\n\nx"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_layout(html, text):
    assert h.render(html) == text


FOREIGN = [
    ("<p>if <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> then", "if x<2 then"),
    ("<math><semantics><mi>y</mi><annotation encoding=tex>\\y</annotation></semantics></math>z", "yz"),
    ("<annotation>kept</annotation>", "kept"), ("<math><mphantom><mi>q</mi></mphantom><mspace/><mi>r</mi></math>", "r"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2 3"),
    ("a<svg viewBox='0 0 9 9'><title>T</title><desc>D</desc><defs><text>no</text></defs> stray "
     "<g><text x=1>Sales</text><text>in <tspan>May</tspan></text></g><path d='M0'/></svg>b", "a Sales in May b"),
    ("<svg><defs/><style/><text>on</text></svg>c", "on c"), ("<svg><foreignObject><p>one<p>two</foreignObject></svg>", "one\n\ntwo"),
    ("<svg><switch><foreignObject>first</foreignObject><text>second</text></switch></svg>", "first"),
    ("<svg><text display=none>a</text><text style='visibility:hidden'>b</text><text><![CDATA[1 < 2 &amp;]]></text></svg>", "1 < 2 &amp;"),
    ("<svg><g><p>outside", "outside"), ("<svg/>x", "x"), ("<text>plain</text>", "plain"), ("<svg hidden><text>a</text></svg>b", "b"),
]


@pytest.mark.parametrize(("html", "text"), FOREIGN)
def test_formulas_and_picture_labels(html, text):
    assert h.render(html) == text


STYLED = [
    ("<style>@media print{.noprint{display:none}}</style><i class=noprint>a</i>", "a"),
    ("<style>@media (max-width:600px){nav{display:none}} nav{color:red}</style><nav>a</nav>", "a"),
    ("<style>@media screen and (min-width: 40em){.m{display:none}}</style><i class=m>a</i>b", "b"),
    ("<style>@media not print{.m{display:none}} @media (width < 900px), print {u{display:none}}</style><i class=m>a</i><u>b</u>", "b"),
    ("<style>@media (400px <= width <= 2000px){.m{display:none}} @media (made-up: 3){u{display:none}}</style><i class=m>a</i><u>b</u>", "b"),
    ("<style media=print>i{display:none}</style><style media='screen, print'>u{display:none}</style><i>a</i><u>b</u>", "a"),
    ("<style>.x{display:none}.x{display:block}</style><i class=x>a</i>", "a"), ("<style>.x{display:block}.x{display:none}</style><i class=x>a</i>b", "b"),
    ("<style>#y{display:inline}.x{display:none}</style><i class=x id=y>a</i>", "a"),
    ("<style>.x{display:none!important}#y{display:inline}</style><i class=x id=y style='display:block'>a</i>b", "b"),
    ("<style>i.x{display:none}.x{display:inline}</style><i class=x>a</i><u class=x>b</u>", "b"),
    ("<style>p .x{display:none} .x:hover{display:none} @font-face{display:none} @keyframes k{from{display:none}}</style><p><i class=x>a</i>", "a"),
    ("<style>@supports (display:grid){.x{display:none}} @supports not (a:b){.y{display:none}} @layer l{.z{display:none}}</style>"
     "<i class=x>a</i><i class=y>b</i><i class=z>c</i>", "b"),
    ("<style>.w:after{content:'} .y{display:none'} .x{display:none</style><i class=y>a</i><i class=x>b</i>", "a"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"), ("<style>div{visibility:hidden}</style><div>a<p>b</div>c", "c"),
    ("<ul><li style='visibility:hidden'>a<li>b</ul>", "- b"), ("<i hidden style='display:inline'>a</i><i hidden>b</i>", "a"),
    ("<style>div{display:block}[hidden]{display:none}</style><div hidden>a</div>b", "b"),
    ("<form><input type=submit value='Send &amp; go'> <input type=password value=p><input value=v><input type=HIDDEN value=h></form>", "Send & go v"),
    ("<input type=submit value=x hidden>y", "y"),
]


@pytest.mark.parametrize(("html", "text"), STYLED)
def test_styles(html, text):
    assert h.render(html) == text


@st.composite
def styled_tree(draw, depth=0):
    """(tag, classes, inline style, children)."""
    kids = st.lists(styled_tree(depth=depth + 1), max_size=3) if depth < 3 else st.just([])
    return (draw(st.sampled_from(["div", "span", "p"])) if depth < 1 else draw(st.sampled_from(["b", "span", "i"])),
            draw(st.sets(st.sampled_from("xyz"), max_size=2)),
            draw(st.sampled_from(["", "display:none", "display:block", "visibility:hidden", "visibility:visible", "color:red"])), draw(kids))


SELECTORS = ["b", "span", "div", ".x", ".y", "*", "b.x", ".x.y", "#q"]
VALUES = ["display:none", "display:inline", "visibility:hidden", "visibility:visible", "visibility:collapse !important", "display:block!important"]
MEDIA = [("", True), ("print", False), ("screen", True), ("(max-width:700px)", False), ("all and (min-width:700px)", True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(styled_tree(), max_size=3), st.lists(st.tuples(st.sampled_from(SELECTORS), st.sampled_from(VALUES), st.sampled_from(MEDIA)), max_size=5))
def test_visible_words_against_brute_force(trees, rules):
    """Every element holds one word of its own; which are visible is worked out by
    trying each declaration on each element, weakest first, the later over the earlier."""
    said, number = [], iter(range(10_000))
    for selector, value, (_, on) in rules:
        prop, _, rest = value.partition(":")
        parts = [x for x in selector.replace(".", " .").split(" ") if x]
        said.append((rest.endswith("!important"), len([x for x in parts if x[0] == "."]), len([x for x in parts if x[0] not in ".#*"]), parts, prop, rest.split("!")[0].strip(), on))

    def walk(tree, shown, seen, words):
        tag, classes, inline, kids = tree
        value = {"display": "inline", "visibility": "visible" if seen else "hidden"}
        has = {tag, "*", *("." + c for c in classes)}
        for strong in (False, True):
            for *_, parts, prop, v, on in sorted((x for x in said if x[0] == strong), key=lambda x: x[1:3]):
                if on and set(parts) <= has:
                    value[prop] = v
            if not strong and ":" in inline:
                value.update([inline.split(":")])
        shown, seen = shown and value["display"] != "none", value["visibility"] == "visible"
        word = f"w{next(number)}"
        if shown and seen:
            words.append(word)
        inside = "".join(walk(k, shown, seen, words) for k in kids)
        return f"<{tag} class='{' '.join(classes)}' style='{inline}'> {word} {inside}</{tag}>"

    expected = []
    body = "".join(walk(t, True, True, expected) for t in trees)
    sheets = "".join(f"<style>@media {m} {{ {s} {{ {v} }} }}</style>" if m else f"<style>{s}{{{v}}}</style>" for s, v, (m, _) in rules)
    assert h.render(f"<head>{sheets}</head><body>{body}").split() == expected


@pytest.mark.parametrize("unit", ["<svg>", "<svg><text>", "<math><mi>", "<svg><g>", "<svg><![CDATA[", "<svg><foreignObject><p>"])
def test_hostile_foreign_pages_stay_linear(unit):
    test_hostile_pages_stay_linear(unit)


@pytest.mark.parametrize("unit", ["<div>", "<p><b>", "<", '<a "', "<a b='", "<!--", "</p>", "<table><tr><td>", "<ul><li>", "<details>", "&", "<td>", "a<br>", "<style>", "<style>a{</style>", "<style>.x{display:none}</style>"])
def test_hostile_pages_stay_linear(unit):
    began = time.process_time()
    h.render(unit * 30_000 + "end")
    assert time.process_time() - began < 20


def test_table(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (None, "<b>x</b>"), (3, "<p>" + "long " * 100_000)]
    df = spark.createDataFrame([(k, "u", x, "own") for k, x in rows], "page_id long, url string, html string, text string")
    assert as_set(h.html_text(df)) == sorted(((k, h.render(x)) for k, x in rows), key=repr)
    assert h.text_table(df.limit(0)).collect() == []
