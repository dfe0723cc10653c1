import html
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_tree
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"
LONG = "This is a long sentence of the article, with commas and words. " * 4


def test_marginals_are_exact():
    rnd = random.Random(4)
    for n in (1, 2, 5, 8):
        parent = [-1] + [rnd.randrange(i) for i in range(1, n)]
        node = [rnd.uniform(-2, 2) for _ in range(n)]
        pair = [[[rnd.uniform(-3, 0) for _ in "ab"] for _ in "ab"] for _ in range(n)]
        mass = [[0.0, 0.0] for _ in range(n)]
        for labels in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(node[i] * labels[i] for i in range(n))
                         + sum(pair[i][labels[parent[i]]][labels[i]] for i in range(1, n)))
            for i, x in enumerate(labels):
                mass[i][x] += p
        got = html_tree.sum_product(parent, node, pair)
        assert got == pytest.approx([math.log(b / a) for a, b in mass])


@pytest.fixture(scope="module")
def model(spark):
    return html_tree.fit(table(spark, SF, "pages"))


def articles(source):
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark, model):
    pages = table(spark, SF, "pages")
    got = html_tree.main_text(pages, model, keep=("url",)).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(got) == 250
    for r in got:
        assert r.text == articles(r.html) and r.n_chars == len(r.text)


@pytest.mark.parametrize("source,want", [
    (f"<nav><a>Home</a></nav><div><h2>A title here.</h2><p>{LONG}</p><p>{LONG}</div><footer>x</footer>", ["A title here.", LONG, LONG]),
    (f"<main><p>{LONG}<div class='user-comments'><p>{LONG}</p></div><p>Caf&eacute; &#8212; a<br>b  c</main>", [LONG, "Café — a b c"]),
    (f"<article><div class=cookie-notice>We use them.</div><script>var a='<p>';</script><p>{LONG}</p>"
     "<form><p>Your name, please.</p></form><ul><li>one thing.<li>two things.</ul></article><p class=ad>Buy!</p>",
     [LONG, "one thing.", "two things."]),
    (f"<article><p>{LONG}<style>p{{}}</style><!-- <p>no</p> --><p title='a>b'>End &amp; &lt;tags&gt;.", [LONG, "End & <tags>."]),
    ("<html><body></body></html>", []), ("", []), (None, []), ("<nav><p>" + LONG, []), ("</p></div><", []),
])
def test_shapes(model, source, want):
    assert html_tree.extract(model, source) == "\n\n".join(" ".join(w.split()) for w in want)


def test_deep_and_broken_pages(model):
    assert html_tree.extract(model, "<div>" * 20_000 + "x").count("\n") == 0
    assert html_tree.extract(model, "<a href='" * 3000) is not None
    assert html_tree.extract(model, "<" * 50_000) is not None


def test_cases(frame, model):
    df = frame([(1, None, 1), (None, "<main><p>Hi there.</main>", 2), (2, "", 3), (2, "", 3)], "page_id long, html string, text int")
    got = html_tree.main_text(df, model)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "", 0), (None, "Hi there.", 9), (2, "", 0), (2, "", 0)], key=str)
    assert html_tree.main_text(df.filter("false"), model).count() == 0
    assert html_tree.fit(df.filter("false")).pair and html_tree.Model(Counter()).weight == {}
    assert html_tree.main_text(df.withColumn("n_chars", F.lit("x")), model).columns == ["page_id", "text", "n_chars"]


@pytest.mark.parametrize("source", [
    f"<body class='has-sidebar'><article><p>{LONG}</p></article></body>",
    f"<html class='no-cookies'><body class='single comments-open'><main id='sidebar-left'><p>{LONG}</p></main></body></html>",
    f"<article class='post comments-open'><p>{LONG}</p></article>",
    f"<main><div class='no-sidebar'><div id='share'><article><p>{LONG}</p></article></div></div></main>",
    f"<div class='layout sidebar'><div role='main'><p>{LONG}</p></div></div>",
    f"<body class='no-sidebar'><p>{LONG}</p><p>{LONG}</p></body>",
])
def test_words_at_the_main_part_or_around_it(model, source):
    want = "\n\n".join([LONG.strip()] * source.count(LONG))
    assert html_tree.extract(model, source) == want
    aside = "<div class='sidebar'><p>Other things to see.</p></div><nav class=menu><article>Menu things to see.</article></nav>"
    assert html_tree.extract(model, source + aside) == want


def test_words_inside_an_article_still_tell(model):
    source = f"<article><p>{LONG}</p><div class=comments><article><p>{LONG}</p></article></div></article>"
    assert html_tree.extract(model, source) == LONG.strip()


def test_pages_with_such_words_train():
    page = html_tree.Page(f"<body class='has-sidebar'><article><p>{LONG}</p></article><div class='sidebar'>x</div></body>")
    assert html_tree.GOOD in page.seen and page.labels()
