from html.parser import HTMLParser

import numpy as np
import pytest

from glossa.llm import html_text
from glossa.llm.html_text import MARKS, extract, main_text, path_table, path_values, read

LONG = "A sentence with some words, commas, and a full stop. And another one, which is longer, to be sure."

PAGES = {
    "article": (f"<nav><a href=/>Menu</a></nav><article><h1>T</h1><p>{LONG}</p><p>Short.</p></article><footer>(c)</footer>", f"T\n{LONG}\nShort."),
    "no article": (
        f"<div class='site-header'><a href=/>Home</a></div><div id=wrap><div class=post><h2>T</h2><p>{LONG}<p>{LONG}<ul><li>one<li>two</ul></div><div class='sidebar'><p>{LONG}</p></div></div><div class=comments><p>{LONG}</p></div>",
        f"T\n{LONG}\n{LONG}\none\ntwo",
    ),
    "bare menu": (f"<ul><li><a href=1>A</a><li><a href=2>B</a><li><a href=3>C</a></ul><div><p>{LONG}</p></div>", LONG),
    "references": ("<p>caf&eacute; &amp; &#x4e2d;&#169; &lt;b&gt;</p>", "café & 中© <b>"),
    "white space": ("<p> a\n\t b &nbsp; c<br>d </p>", "a b c d"),
    "scripts": ('<p>a, b.</p><script>x="<p>no</p>"</script><style>p{}</style><noscript><p>no</p></noscript>', "a, b."),
    "comment": ("<p>a</p><!-- <p>no</p> --><p>b</p>", "a\nb"),
    "open": ("<p>a<p><b>b<p>c", "a\nb\nc"),
    "stray": ("</div><p>a</span></p></article>", "a"),
    "hidden": ("<p>a</p><p hidden>no</p><div style='display:none'>no</div>", "a"),
    "form": ("<p>a</p><form><p>no</p><textarea><p>no</p></textarea></form><p>b</p>", "a\nb"),
    "reader comments in main": (f"<main><p>{LONG}</p><section class=comments><article class=comment><p>{LONG}</p></article></section></main>", LONG),
    "own header": (f"<article><header class='entry-header'><h1>T</h1></header><p>{LONG}</p><footer>by</footer></article><div class='page-header'>no</div>", f"T\n{LONG}"),
    "layout word": (f"<div class='layout with-sidebar'><p>{LONG}</p></div><div class='sidebar'><p>Read more.</p></div>", LONG),
    "layout is the sidebar's": (f"<div class='sidebar-layout'><p>{LONG}<p>{LONG}</div>", f"{LONG}\n{LONG}"),
    "post header": (f"<div class=post><div class='post-header'><h1>T</h1></div><p>{LONG}</p></div><div class=footer>no</div>", f"T\n{LONG}"),
    "related work": (f"<article><p>{LONG}</p><section class='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>", f"{LONG}\nRelated work\n{LONG}"),
    "related posts": (f"<div><p>{LONG}</p><div class='related-posts'><a href=1>A</a></div></div>", LONG),
    "words that say nothing": (f"<div class=a><p>Buy this.</p></div><div class=b><p>{LONG}</p><p>{LONG}</p><p>x</p></div>", f"{LONG}\n{LONG}\nx"),
    "title outside": (f"<article><h1>T</h1><div class=text><p>{LONG}</p><p>{LONG}</p></div></article>", f"T\n{LONG}\n{LONG}"),
    "many reader comments": (f"<main><p>{LONG}</p><div class='comment-list'>" + f"<p>{LONG}</p>" * 5 + "</div></main>", LONG),
    "only an advert": ("<div class=ad>Buy.</div><article></article>", ""),
    "text": ("no markup", "no markup"),
    "empty": ("", ""),
    "null": (None, ""),
    "no text": ("<html><body></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_operator_on_nulls_repeats_long_pages_and_extra_columns(spark):
    huge = "<article>" + "<p>word, word.</p>" * 30000 + "</article>"
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "z"), (1, "u", "<p>a</p>", "z"), (2, None, None, None), (None, "v", huge, "")], "page_id long, url string, html string, text string")
    rows = extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 30000 * 12 - 1), (1, 1), (1, 1), (2, 0)]
    assert extract(pages.limit(0)).count() == 0
    assert extract(pages).columns == ["page_id", "url", "text", "n_chars"]


def test_ratios_select_without_any_word(monkeypatch):
    page = f"<div class=a><p>Buy this now, and save.</p></div><div class=b><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page) == f"{LONG}\n{LONG}"
    monkeypatch.setattr(html_text, "path_values", lambda p: dict.fromkeys(path_values(p), 1.0))
    assert main_text(page) == f"Buy this now, and save.\n{LONG}\n{LONG}"


class Plain(HTMLParser):
    """(path, text) of the blocks of a page whose markup is sound."""

    def __init__(self, page):
        super().__init__()
        self.path, self.found = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        words = dict(attrs).get("class")
        self.path.append(f"{tag}.{words.replace(' ', '.')}" if words else tag)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if data.strip() and "nav" not in self.path:
            self.found.append((">" + ">".join(self.path), data.strip()))


def test_ratios_decide_the_pages_of_the_tables(monkeypatch, spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    whole = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "_hint", lambda word, tag: 1.0)
    monkeypatch.setattr(html_text, "NAMED", 1.0)
    alone = [main_text(p) for p in pages]
    assert sum(a == b for a, b in zip(whole, alone)) >= 0.9 * len(pages)  # without a class word or article tag
    monkeypatch.setattr(html_text, "path_values", lambda p: dict.fromkeys(path_values(p), 1.0))
    assert not any(main_text(p) == w for p, w in zip(pages, whole))


def test_path_table_and_values_by_brute_force():
    page = f"<html><body><nav><p>no</p></nav><div class='a b'><h1>Title</h1><p>{LONG}</p><p>Short, one.</p></div><div class=c><p>{LONG}</p><ul><li>one</li><li>two;</li></ul></div></body></html>"
    blocks = Plain(page).found
    want = {p: (sum(len(t) for q, t in blocks if q == p), sum(len(MARKS.findall(t)) for q, t in blocks if q == p), sum(q == p for q, _ in blocks)) for p, _ in blocks}
    own = read(page)
    names = own.spelt()
    assert {names[p]: v for p, v in path_table(own).items()} == want
    length, marks = [want[p][0] / want[p][2] ** 0.5 for p, _ in blocks], [want[p][1] / want[p][2] + 1 for p, _ in blocks]

    def around(x, i):
        return 0.25 * x[max(i - 1, 0)] + 0.5 * x[i] + 0.25 * x[min(i + 1, len(x) - 1)]

    value = [(length[i] * around(length, i) * around(marks, i)) ** 0.5 for i in range(len(blocks))]
    for path, number in path_values(own).items():
        assert np.isclose(number, np.mean([v for v, (p, _) in zip(value, blocks) if p == names[path]]))


def test_deep_pages_take_time_in_proportion():
    assert main_text("<div>" * 20000 + "<p>a, b.") == "a, b."
    assert main_text("<div>a" * 20000).count("a") == 20000
