"""What the style tree finds by itself: pages whose names say nothing, menus that differ, deep pages, names inside a text."""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from html import unescape

import pytest

from skylattice.llm import html_extract

SF = "/root/testdata/sf0.1"
LONG = "This sentence is running text of more than ten words, number {n}."


def main_texts(spark, rows, **more):
    got = html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), **more).collect()
    return {x["page_id"]: x["text"] for x in got}


def article_of(html):
    inside = re.search(r"<article[^>]*>(.*?)</article>", html, re.S).group(1)
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return [x for x in parts if x]


def without_names(html):
    html = re.sub(r"<(/?)(?:nav|article|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"<div [^>]*>", "<div>", html)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_tree_alone_finds_articles(spark):
    """All elements are plain div, no class or tag names anything, and links and adverts differ from page to page."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = main_texts(spark, [(i, u, without_names(h)) for i, u, h in rows])
    words = lambda c: sum(len(t.split()) * k for t, k in c.items())
    exact = hit = more = less = 0
    for i, _, h in rows:
        a, b = Counter(got[i].split("\n\n")), Counter(article_of(h))
        exact += a == b
        hit, more, less = hit + words(a & b), more + words(a - b), less + words(b - a)
    assert exact >= 0.9 * len(rows) and hit / (hit + more) > 0.995 and hit / (hit + less) > 0.999
    assert all("\n\n".join(article_of(h)) != html_extract.extract(without_names(h), {}) for _, _, h in rows[:50])  # an empty tree doesn't


def test_a_menu_whose_links_differ_on_each_page_goes(spark):
    r = random.Random(3)
    rows, want = [], {}
    for n in range(30):
        text = [f"Title {n}", *[LONG.format(n=f"{n}.{k}") for k in range(r.randint(1, 6))]]
        links = "".join(f"<li><a href='/{r.random()}'>Story {r.random()}</a></li>" for _ in range(5))
        rows.append((n, "http://menus.example/", f"<body><div><ul>{links}</ul></div><div><h1>{text[0]}</h1>{''.join(f'<p>{t}</p>' for t in text[1:])}</div><div>Offer {r.random()}</div></body>"))
        want[n] = "\n\n".join(text)
    assert main_texts(spark, rows) == want


def test_one_form_for_all_pages_takes_nothing_away(spark):
    page = "<body><div><div><h1>Title {n}</h1><p>" + LONG + "</p></div></div></body>"
    assert main_texts(spark, [(n, "http://same.example/", page.format(n=n)) for n in range(12)]) == {n: f"Title {n}\n\n{LONG.format(n=n)}" for n in range(12)}


@pytest.mark.parametrize("name", ["section class=reply-letter", "div class=legal", "div class=card", "div class=share-price", "div class=social-history", "div class='related'", "div class=navigation-history"])
def test_names_inside_running_text_stay(name):
    inner = f"<{name}><p>{LONG.format(n=2)}</p></{name.split()[0]}>"
    page = f"<nav>Home</nav><article><p>{LONG.format(n=1)}</p>{inner}<p>{LONG.format(n=3)}</p></article>"
    assert html_extract.extract(page, {}) == "\n\n".join(LONG.format(n=n) for n in (1, 2, 3))


@pytest.mark.parametrize("name", ["class=share", "class='share-buttons'", "class=comments", "id=comments-section", "class=newsletter-box", "class=ad", "class='ad-slot top'", "class=sidebar", "class=main-nav", "class=cookie-notice", "role=navigation"])
def test_named_branches_of_an_article_go(name):
    page = f"<article><p>{LONG.format(n=1)}</p><div {name}>Tell others</div><p>{LONG.format(n=3)}</p></article>"
    assert html_extract.extract(page, {}) == f"{LONG.format(n=1)}\n\n{LONG.format(n=3)}"


def test_depth_has_no_bound():
    for depth in (399, 401, 30_000):
        page = "<div>" * depth + f"<p>{LONG}</p><div class=ad>Buy</div>" + "</div>" * depth + "<nav>x</nav>"
        assert html_extract.extract(page, {}) == LONG
    order, blocks = html_extract.parse("<div>" * 1000 + "a")
    assert len(order) == len({x.key for x in order}) == 1000 and blocks[0][0] is order[-1]
