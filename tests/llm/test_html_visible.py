"""Visible text of pages whose tags are left out or stand where they do not belong."""

import random

import pytest

from tickloom.llm.html_text import html_to_text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<head><title>T</title><a href=x>Home</a> news <p>more", "Home news\n\nmore"), ("<head><title>T</title><meta name=a>plain text only", "plain text only"), ("<head><style>a{}</style>\n<span>x</span> y", "x y"), ("<head><noscript><p>no</noscript><template><a>no</a></template><title>no</title></head><body>yes", "yes"),
        ("a <textarea>typed\nin</textarea>b", "a typed in b"), ("<select><optgroup label=Fruit><option>apple<option>pear</select>z", "Fruit apple pear z"), ("<map>area <a>one</a></map>", "area one"), ("<p aria-hidden=true>shown</p>", "shown"),
    ],
)
def test_visible(html, text):
    assert html_to_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<table><tbody><form><tr><td>x<td>y</table>", "x | y"), ("<table><tr>stray<td>x</table>", "stray\nx"), ("<table><img alt=picture><tr><td>x</table>", "picture\nx"), ("<table><tbody>in <b>group</b><tr><td>x</tbody></table>", "in group\nx"), ("<table><colgroup><col><tr><td>x</table>", "x"),
        ("<table><tr><form><td>a<td>b</form></table>", "a | b"), ("<table><tbody hidden><tr><td>no</tbody><tr><td>x</table>", "x"), ("<table><caption>cap</caption>s<tr><td><table><tr><td>in</table></table>", "cap\ns\nin"),
    ],
)
def test_malformed_tables(html, text):
    assert html_to_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"), ("<svg><title>no</title><desc>no</desc><text>drawn</text><text>too</text></svg>", "drawn too"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<style>.a, p#b {display:none} i{visibility:hidden} @media print {u{display:none}}</style><p class='x a'>no<p id=b>no<p>y<i>no</i><u>es</u>", "yes"), ("<style>.a{display:none}</style><p class=a style='display:block'>shown", "shown"),
        ("<table style='visibility:hidden'><tr><td>no<td><b style='visibility:visible'>yes</b></table>", "| yes"), ("<table><tr><td colspan=1000>wide<tr><td>a<td>b</table>", "wide |\na    | b"), ("<table><tr><td rowspan=70000>x<td>1<tr><td>2<tr><td>3</table>", "x | 1\n  | 2\n  | 3"), ("<table><tr><td colspan=0>a<td colspan=x>b</table>", "a | b"),
    ],
)
def test_visibility_and_spans(html, text):
    assert html_to_text(html).strip() == text


def test_deep_tables_keep_their_layout():
    assert html_to_text("<table><tr><td>a<td>" * 3000 + "x").endswith("x") and html_to_text("<table><tr><td>a<td>" * 3 + "x") == "a | a | a | x"


def test_no_word_of_a_malformed_table_is_lost():
    rng = random.Random(7)
    tags = ["table", "tbody", "thead", "tfoot", "tr", "tr", "td", "td", "th", "form", "div", "p", "b", "caption", "colgroup", "ul", "li"]
    for _ in range(1500):
        html, want = "<table>", []
        for i in range(rng.randrange(1, 25)):
            tag = rng.choice(tags)
            html += rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", ""])
            if rng.random() < 0.6:
                want.append(f"w{i}x")
                html += f" w{i}x " if rng.random() < 0.8 else f"<img alt=w{i}x>"
        got = html_to_text(html)
        assert sorted(w for w in got.split() if w[0] == "w") == sorted(want), html
