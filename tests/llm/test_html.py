import pytest

from tessera.llm import html

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("plain &amp; simple", "plain & simple"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n\n  - z"),
    ("<ol start=3><li>a</li><li>b<br>c</li></ol>", "3. a\n4. b\n   c"),
    ("<table><tr><th>Name<th>N<tr><td>Alpha<td>1<tr><td>B<td>22</table>", "Name   N\nAlpha  1\nB      22"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide</td><td>z</td></tr><tr><td>p<td>q<td>r</table>", "wide     z\np     q  r"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<script>x='</p>';</script><style>p{}</style><!-- c --> b", "a b"),
    ("<p style='display: none'>no</p><p hidden>no</p>yes", "yes"),
    ("<pre>\n a\n   b  \n</pre>", " a\n   b"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("x <b>y</b>  <i> z</i>", "x y z"),
    ("<p>a <unknown>b</p> c", "a b\n\nc"),
    ("1 < 2 and <3", "1 < 2 and <3"),
    ("<head><title>T</title></head><body>b", "b"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>o</table>", "in  ner  o"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("<html><head><title>T</title><body><p>Hello</p>", "Hello"),
    ("<head><title>T</title><p>Hello", "Hello"),
    ("<head><meta charset=x>\n words", "words"),
    ("<p>a<head>b", "ab"),
    ("<ol><li value='²'>a<li value=7>b<li>c<ol start=-1><li>d</ol></ol>", "1. a\n7. b\n8. c\n\n   -1. d"),
    (f"<table><tr><td colspan={'9' * 5000}>a<td rowspan={'0' * 6000}2>b<tr><td>c</table>", "a  b\nc"),
    (f"x&#{'9' * 6000};y&#{'0' * 6000}65;z", "x\ufffdyAz"),
    ("<div style='visibility: hidden'>no <b style='visibility:visible'>yes</b> no</div>", "yes"),
    ("<a title=\"x>y\" href='q'>t</a><b class=a\"b>u</b>", "tu"),
    ("<ul><li><p>a</p><p>b</p></li><li></li><li>c</ul>d", "- a\n\n  b\n- c\n\nd"),
    ("<ul><li><ul><li>x</ul><li>y</ul>", "- - x\n- y"),
    ("<blockquote><ul><li>a</ul>b</blockquote>", "  - a\n\n  b"),
    ("<noscript><p>no</p></noscript>x<title>t</title>", "x"),
    ("cut <a href='", "cut <a href='"),
    ("<p>a</p >b</body></html> c", "a\n\nb c"),
    ("<ul>loose<li>a</ul>", "loose\n- a"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_text(page, text):
    assert html.text_of(page) == text


def test_no_visible_word_is_lost_and_deep_nesting_ends():
    page = "".join(f"<div><span>w{k} " for k in range(5000))
    assert html.text_of(page).split() == [f"w{k}" for k in range(5000)]
    assert html.text_of("<" * 10_000).count("<") == 10_000


@pytest.mark.parametrize(
    "page",
    ['<a "' * 20_000, "<title>" * 20_000, "<title " * 20_000, "<a x='" * 20_000 + "z", "<b>" * 100_000 + "<div>" * 100_000 + "w", "<p><table><td>" + "<b>" * 50_000 + "<div>w" * 50_000,
     "<blockquote>" * 50_000 + "w", "<ul><li>" * 50_000 + "w", "<table><tr><td>" * 30_000 + "w", "<table><tr><td colspan=1000 rowspan=9>w" + "<tr><td>x" * 30_000, "<!--" * 50_000, "<" * 100_000, "&" * 100_000, "<tr>" * 50_000, "</x>" * 100_000],
)
def test_time_is_in_proportion(page):
    import time

    began = time.time()
    html.text_of(page)
    assert time.time() - began < 5


def test_deep_pages_lose_nothing():
    for depth in (10, 160, 5000):
        for tag in ("div", "b", "blockquote", "ul", "table><tr><td"):
            page = f"<{tag}>" * depth + "<img alt='see me'><input value=val><pre>a\n b</pre><table><tr><td>c<td>d</table>"
            found = html.text_of(page).split()
            assert [w for w in found if w != "-"] == ["see", "me", "val", "a", "b", "c", "d"] or [w for w in found if w != "-"] == ["see", "meval", "a", "b", "c", "d"]


def brute_words(page):
    """Words in order, by the parser of the standard library and a stack of its own; wants pages whose tags are closed."""
    import re
    from html.parser import HTMLParser

    out = []

    class Words(HTMLParser):
        hidden = 0

        def handle_starttag(self, tag, attributes):
            a = dict(attributes)
            if tag in html.VOID:
                if not self.hidden and tag == "img":
                    out.append(a.get("alt") or "")
                elif not self.hidden and tag in ("br", "hr"):
                    out.append(" ")
                return
            if self.hidden or tag in html.HIDDEN or "hidden" in a or "none" in a.get("style", ""):
                self.hidden += 1
            elif tag in html.BLOCK or tag in ("td", "th", "table"):
                out.append(" ")

        def handle_endtag(self, tag):
            if self.hidden:
                self.hidden -= 1
            elif tag in html.BLOCK or tag in ("td", "th", "table"):
                out.append(" ")

        def handle_data(self, data):
            if not self.hidden:
                out.append(data)

    words = Words()
    words.feed(page)
    words.close()
    return [w for w in re.split(r"\s+", "".join(out)) if w]


def test_words_of_random_trees_equal_brute_force():
    import random

    rnd = random.Random(7)

    def tree(depth):
        word = lambda: rnd.choice(["a", "bc", "d&amp;e", "ü", "x-y", "12"])
        if depth == 0 or rnd.random() < 0.2:
            return " ".join(word() for _ in range(rnd.randint(0, 4)))
        inner = lambda: "".join(tree(depth - 1) for _ in range(rnd.randint(0, 3)))
        kind = rnd.randrange(9)
        if kind == 0:
            return f"<ul>{''.join(f'<li>{inner()}</li>' for _ in range(rnd.randint(0, 3)))}</ul>"
        if kind == 1:
            rows = "".join(f"<tr>{''.join(f'<td>{inner()}</td>' for _ in range(rnd.randint(0, 3)))}</tr>" for _ in range(rnd.randint(0, 3)))
            return f"<table>{rows}</table>"
        if kind == 2:
            return f"<script>{word()} < 2</script><style>p {{}}</style><!-- {word()} -->"
        if kind == 3:
            return rnd.choice(["<br>", "<hr>", f"<img alt='{word()}'>", f"<div hidden>{inner()}</div>", f"<p style='display: none'>{word()}</p>"])
        name = ["div", "b", "section", "span", "blockquote"][kind - 4]
        return f"<{name}>{inner()}</{name}>"

    for _ in range(400):
        page = tree(6)
        plain = lambda words: [w for w in words if w != "-"]
        order = sorted if "<table" in page else list  # lines of several cells stand side by side
        assert order(plain(html.text_of(page).split())) == order(brute_words(page)), page


def test_extract(spark):
    rows = [(1, "<title>A &lt; B</title><p>x", "u", "t"), (1, "<title>A &lt; B</title><p>x", "u", "t"), (2, None, None, "t"), (None, "", "v", None)]
    frame = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    found = sorted(map(tuple, html.extract(frame).collect()), key=str)
    assert found == sorted([(1, "u", "A < B", "x")] * 2 + [(2, None, None, ""), (None, "v", None, "")], key=str)
    assert html.extract(frame.limit(0)).collect() == []
