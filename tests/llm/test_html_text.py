"""Displayed text and its layout."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from cartwright.llm import html_text
from cartwright.llm.html_text import extracted, page_text

CASES = {
    "plain &amp; simple": "plain & simple",
    "<p>one<p>two<br>three": "one\n\ntwo\nthree",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a <b> b</b>  c\n d": "a b c d",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>": "- a\n- b\n  3. x\n  4. y\n- c",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22<br>33</table>z":
        "Name       N\nlong name  1\nx          22\n           33\n\nz",
    "<table><caption>C</caption><td>日本<td>a<tr><td>abc<td>b</table>": "C\n日本  a\nabc   b",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "<head><title>no</title><style>x</style></head><script>if (a<b) '</p>'</script>yes": "yes",
    "a<div hidden>no</div><span style='color:red; Display : none'>no</span><i style=visibility:hidden>no</i>b": "ab",
    "<dl><dt>t<dd>d<dd>e</dl>": "t\n    d\n    e",
    "<blockquote>q<p>r</blockquote>s": "> q\n>\n> r\n\ns",
    "a<!-- no <b> --><b>c": "ac",
    "x < y &lt; z": "x < y < z",
    "<img alt='picture'> <input value=v><input type=hidden value=no>": "picture v",
    "<select><option>one<option>two</select>": "one\ntwo",
    "<h1>t<h2>u</h2><p><b>v<p>w": "t\n\nu\n\nv\n\nw",
    "<table>stray<tr><td>cell</table>": "stray\n\ncell",
    "<p>unfinished <a href='x": "unfinished",
    "<noscript>no</noscript><template>no</template><textarea> a  b</textarea>": "a  b",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert re.sub("(?m) +$", "", page_text(page)) == CASES[page].strip("\n") or page_text(page).strip() == CASES[page].strip()


@pytest.mark.parametrize("part", ["tr", "tbody", "thead", "tfoot"])
def test_rows_and_sections_without_a_table(part):
    assert page_text(f"<{part}>text").split() == ["text"]
    assert page_text(f"a<{part}>text<b>bold</b></{part}>z").split() == ["a", "textbold", "z"]
    assert page_text(f"<div><{part}>one<{part}>two</div>three").split() == ["one", "two", "three"]
    assert page_text(f"<{part}>x<td>cell</{part}><table><{part}>stray<tr><td>y</table>").split() == ["x", "cell", "stray", "y"]


def test_deep_and_long_pages():
    assert page_text("<div>" * 20000 + "deep") == "deep"
    assert page_text("<li>" * 3000 + "x").endswith("x")
    assert len(page_text("<p>word " * 50000).split()) == 50000
    assert page_text("<" * 2000).count("<") == 2000


class _Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "title", "template", "noscript")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "title", "template", "noscript")

    def handle_data(self, data):
        if self.depth <= 0:
            self.out.append(data)


def test_all_visible_text_of_the_pages(spark):
    """Without blanks and marks of lists the text is that of the standard library's parser."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = extracted(pages.withColumnRenamed("url", "text")).collect()
    assert len(rows) == pages.count()
    for row in rows:
        parser = _Words()
        parser.feed(row["html"] or "")
        parser.close()
        without_marks = re.sub(r"(?m)^\s*(- |\d+\. )+", "", row["text"])
        assert re.sub(r"\s", "", without_marks) == re.sub(r"\s", "", "".join(parser.out))


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (4, "<p>x"), (4, "<p>x")], "page_id long, html string")
    assert sorted(r["text"] for r in extracted(pages).collect()) == ["", "", "x", "x", "x"]
    assert extracted(pages.limit(0)).count() == 0


def filled(rows):
    """Rows of (text, columns, rows) as a plain grid: each row's texts by column."""
    grid = {}
    for r, row in enumerate(rows):
        c = 0
        for text, columns, down in row:
            while (r, c) in grid:
                c += 1
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + columns):
                    grid.setdefault((i, j), "")
            grid[r, c] = text
            c += columns
    return [{j: t for (i, j), t in grid.items() if i == r and t} for r in range(len(rows))]


@pytest.mark.parametrize("seed", range(25))
def test_cells_stand_in_their_columns(seed):
    rng = random.Random(seed)
    rows = [
        [(f"{chr(97 + r)}{c}" * rng.randint(1, 3), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for c in range(rng.randint(1, 5))]
        for r in range(rng.randint(1, 7))
    ]
    cells = lambda row: "".join(f"<td colspan={c} rowspan={d}>{t}" for t, c, d in row)
    lines = html_text.page_text("<table>" + "".join(f"<tr>{cells(row)}" for row in rows) + "</table>").split("\n")
    want = filled(rows)
    assert len(lines) == len(want)
    starts = {}
    for line, row in zip(lines, want):
        assert line.split() == [row[j] for j in sorted(row)]
        for j in sorted(row):
            at = line.index(row[j])
            assert starts.setdefault(j, at) == at  # a column begins at one place in all lines
    places = [starts[j] for j in sorted(starts)]
    assert places == sorted(places)


def test_spanned_rows_keep_columns_aligned():
    text = html_text.page_text("<table><tr><td rowspan=2>a<td>b<td>x<tr><td>c<td>d<tr><td>e<td colspan=2>f</table>")
    assert text == "a  b  x\n   c  d\ne  f"
    assert html_text.page_text("<table><tr><td rowspan=0>a<td rowspan=x>b<td rowspan=99999999>c</table>") == "a  b  c"


def test_closed_details_show_their_summary():
    page = "<details>before<summary>Sum</summary><p>body</p><summary>two</summary></details>after"
    assert html_text.page_text(page) == "Sum\nafter"
    assert html_text.page_text(page.replace("<details>", "<details open>")).split() == ["before", "Sum", "body", "two", "after"]


def test_what_is_visible_inside_the_hidden():
    page = "a<div style='visibility:hidden'>b<img alt=c><p style='visibility: visible'>d</p>e</div><p style='display:none'>f<b style='visibility:visible'>g</b></p>h"
    assert html_text.page_text(page).split() == ["a", "d", "h"]


@pytest.mark.parametrize(
    "piece", ["<div>x", "<blockquote>x", "<ul><li>x", "<ol><li>x", "<table><tr><td>x", "<p><b>x", "<span>x</p>", "<dl><dd>x", "<a>x", "<h1>x", "<details open>x",
              "<td>x", "<tr>x", "<table>x<tr>", "<li>x", "</div><i>x"]
)
def test_time_grows_with_the_page(piece):
    """Twelve times as many open elements take nothing like the 144 times as long of a square."""

    def seconds(n):
        best = 9e9
        for _ in range(2):
            begun = time.process_time()
            text = html_text.page_text(piece * n)
            best = min(best, time.process_time() - begun)
        assert text.count("x") == n
        return best

    small = max(seconds(2500), 0.02)
    assert seconds(30_000) < 60 * small


def test_deep_quotes_keep_every_line():
    text = html_text.page_text("".join(f"<blockquote>line{i}" for i in range(3000)))
    assert [line.lstrip("> ") for line in text.split("\n") if line.strip("> ")] == [f"line{i}" for i in range(3000)]
    assert max(map(len, text.split("\n"))) < 200
