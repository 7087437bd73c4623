import itertools
import math
import random

import pytest

from gradelake.llm import html_cut as H


def test_tables(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = H.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


WORDS = "Rain fell on the hills all morning, and the road to the village was closed by noon."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<!-- only a comment", ""), ("<script>var a='<p>" + WORDS + "</p>'", ""),
        (f"<main><h2>Title</h2><div>{WORDS}</div><form>{WORDS}</form></main>", f"Title\n{WORDS}"),
        (f"<article><p>{WORDS}<br>more\n\t of&nbsp;it &amp; &lt;b&gt; &eacute;</article>", f"{WORDS} more of it & <b> é"),
        (f"<article><p>{WORDS}</p><section class='comments'><p>{WORDS}</p></section><p>{WORDS} End.</p></article>", f"{WORDS}\n{WORDS} End."),
        (f"<header><p>{WORDS}</p></header><article><header><h1>Head</h1></header><p>{WORDS}</p></article><aside>{WORDS}</aside>", f"Head\n{WORDS}"),
        (f"<div id='cookie-notice'>{WORDS}</div><div class='post-content'><p>{WORDS}</p><p>{WORDS}</p></div><div class=sidebar>{WORDS}</div>", f"{WORDS}\n{WORDS}"),
        (f"<body><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><p>{WORDS}<p>{WORDS}<div><a href=z>Contact</a> <a href=q>Help</a></div>", f"{WORDS}\n{WORDS}"),
        (f"<article><p title='a > b'>{WORDS}</p><p hidden>{WORDS}</p><style>p{{}}</style></article", WORDS),
        (f"<article><p>{WORDS}</p><div class=\"ad\">{WORDS}</div></article><footer>&copy; x", WORDS),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='layout has-sidebar'><article><p>{WORDS}</p></article><div class=sidebar>{WORDS}</div></div>", WORDS),
        (f"<div class='sidebar-layout'><main><p>{WORDS}</p></main></div>", WORDS),
        (f"<div class='content no-sidebar'><p>{WORDS}</p><p>{WORDS}</p></div>", f"{WORDS}\n{WORDS}"),
        (f"<article><h2 id='side-effects'>Side effects</h2><p>{WORDS}</p><section id='related-work'><p>{WORDS}</p></section></article>", f"Side effects\n{WORDS}\n{WORDS}"),
        (f"<article><h2 id='search-algorithms'>Search</h2><p>{WORDS}</p><section id='navigation-principles'><h2>Ways</h2><p>{WORDS}</p></section></article>", f"Search\n{WORDS}\nWays\n{WORDS}"),
        (f"<form><article><p>{WORDS}</p></article></form>", WORDS),
        (f"<form action=x><div class=content><p>{WORDS}</p><p>{WORDS}</p></div></form>", f"{WORDS}\n{WORDS}"),
        (f"<article><p>{WORDS}</p></article><section class=comments>" + f"<article class=comment><p>{WORDS}</p></article>" * 5 + "</section>", WORDS),
    ],
)
def test_names_do_not_take_the_article(page, text):
    assert H.main_text(page) == text


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(labels, odds=odds, edges=edges):
            unary = sum(math.log1p(math.exp(-o if content else o)) for o, content in zip(odds, labels))
            return unary + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(map(cost, itertools.product([True, False], repeat=n)))
        assert math.isclose(cost(H.minimum_cut(odds, edges)), best, abs_tol=1e-6)


def test_odd_rows(spark):
    rows = [(None, None, None, "x", 1), (1, "u", "<article><p>a b c d</article>", "x", 1), (1, "u", "<article><p>a b c d</article>", "x", 1), (2, None, "<p>" * 3000 + "deep" + "<b>" * 5000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = H.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert got.where("page_id = 1 and text = 'a b c d'").count() == 2
    assert H.extract(pages.limit(0)).isEmpty()
