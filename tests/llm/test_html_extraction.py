import html
import random
import re
from itertools import product

import numpy as np
import pytest

from tessera.llm import html_extraction as hx
from tessera.llm import queries


P = "A paragraph of some length that says what there is to say. It has a second sentence, and a third. And so it goes on."
NAV = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Sport</a></li></ul>"


@pytest.fixture(scope="module")
def model():
    return hx.fit(hx.labelled_pages([]))


def text(model, page):
    p = hx.Page(page)
    return p.text(model.contents([p])[0] > 0.5)


def test_messages_are_exact_marginals():
    """Against sums over all labellings of small forests."""
    rnd = np.random.default_rng(3)
    pages = [hx.Page(x) for x in ("<div><p>a<p>b<ul><li>c</ul></div><p>d", "x", "<div><div><div>q</div></div></div>")]
    forest = hx.Forest(pages, {}, grow=True)
    n, unary, edges = len(forest.parent), rnd.normal(size=len(forest.parent)), rnd.normal(size=(hx.OTHER_KIND + 1, 2, 2))
    one, pair, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for y in product((0, 1), repeat=n):
        kids = [i for i in range(n) if forest.parent[i] >= 0]
        w = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(edges[forest.kind[i], y[forest.parent[i]], y[i]] for i in kids))
        total += w
        one += w * np.array(y)
        for i in kids:
            pair[i, y[forest.parent[i]], y[i]] += w
    marginal, pairs = forest.messages(unary, edges)
    kids = np.flatnonzero(forest.parent >= 0)
    assert np.allclose(marginal, one / total) and np.allclose(pairs[kids], pair[kids] / total)


def test_labels_of_held_out_layouts(model):
    rnd = random.Random(77)
    layout = hx._Layout(rnd, ["some words of other blocks " * i for i in range(1, 30)])
    pages = [hx.Page(layout.page()) for _ in range(300)]
    right, whole = [], 0
    for p, m in zip(pages, model.contents(pages), strict=True):
        held = [i for i in range(len(p.parent)) if any(n == i and x.strip() for n, x in p.parts)]
        ok = [(m[i] > 0.5) == p.label[i] for i in held]
        right += ok
        whole += all(ok)
    assert np.mean(right) > 0.99 and whole > 0.94 * 300


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><header class=site><h1>My site</h1><nav><a href=/>Home</a></nav></header><main><article><h1>The title</h1><p>Some prose here, a good deal of it.</p><p>Ok.</p><aside>Read also this</aside>"
         "<p>More &amp; more&nbsp;of  it</p><section id=comments><h2>Comments</h2><p>Great article, I liked it very much!</p></section></article></main><footer>&copy; me</footer></body>", "The title Some prose here, a good deal of it. Ok. More & more of it"),
        ("<div id=cookie-notice>We use cookies <button>OK</button></div><div class='sidebar'><p>Popular posts of this week</p></div><div class=post-body><h1>T</h1><p>Text of it, which is <b>lon</b>ger, for sure.<p>Be.</div>"
         "<div class='related-posts'><h3>Related</h3><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div><form><input><label>Email</label><button>Send</button></form>", "T Text of it, which is longer, for sure. Be."),
        ("<head><title>t</title><script>var t='</p>';</script><style>p{}</style><body><nav><ul><li><a href=/>x</a></ul></nav><!-- ad --><div class=ad>Buy it</div><article><h1>Head</h1><p><b>One.<br><p>Two &#233;&eacute;.</p><p>Three", "Head One. Two éé. Three"),
        (f"<div id='page'><div id='header'><a href=/>Site name</a></div><div id='nav'>{NAV}</div><div id='content'><h1>Title here</h1><p>{P}</p><p>{P}</p><p>Be.</p></div><div id='sidebar'><h3>Popular</h3>{NAV}</div><div id='footer'>&copy; site</div></div>", f"Title here {P} {P} Be."),
        (f"<table><tr><td class='menu'>{NAV}</td><td class='main'><h1>Title here</h1><p>{P}</p><p>{P}</p></td></tr></table><div class=footer>copyright</div>", f"Title here {P} {P}"),
        (f"<article class=post><h1>T</h1><p>{P}</p><div class='share-buttons'><a href=1>Mail</a></div><p class='ad'>Buy it</p><p>{P}</p><div class='comments'><h2>3 comments</h2><div class='comment'><b>Ann</b><p>{P}</p></div></div></article>", f"T {P} {P}"),
        (f"<nav>{NAV}</nav><section class='post'><h1>T</h1><p>{P} <a href=x>link one</a> and <a href=y>another</a>.</p><ul><li>Item one</li><li><a href=z>Item two</a></li></ul></section>", f"T {P} link one and another. Item one Item two"),
        (f"<nav>{NAV}</nav><article><h1>T</h1><h2>Sub</h2><blockquote><p>{P}</p></blockquote><pre>code  x = 1</pre><table><tr><th>a</th><td>b</td></tr></table></article><div class='advert'>Buy our thing today</div>", f"T Sub {P} code x = 1 a b"),
        (f"<div class='top'>{NAV}</div><div class='x9'><div class='k2'><h1>T</h1><div>{P}</div><div>{P}</div></div></div><div class='bottom'>{NAV}</div>", f"T {P} {P}"),
    ],
)
def test_pages(model, page, want):
    assert text(model, page) == want


def test_odd_pages_do_not_break(model):
    for page in ("", " ", "<", "<" * 3000, "<div>" * 5000 + "x", "</p></div>", "<p class", "<!-- x", "<script>x", "<article data-y=q class>a</article>", "&#0;&bogus;&#xffffffff;", "<table><tr><td>a<td>b<tr></table>"):
        assert isinstance(text(model, page), str)


def test_extract_on_a_frame(spark, model):
    page = "<body><nav><a href=/>m</a></nav><article><h1>A title</h1><p>Body of the text.</p><p>More of it.</p></article></body>"
    rows = [(1, page, "x", 5), (1, page, "x", 5), (2, None, "y", 6), (3, "", None, 7), (4, page.replace("More", "More " * 100_000), "z", 8)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, own int").repartition(3)
    out = hx.extract(df, model)
    assert out.columns == ["page_id", "html", "own", "text"]
    got = sorted((r.page_id, r.text[:36], len(r.text)) for r in out.collect())
    assert got == [(1, "A title Body of the text. More of it", 37)] * 2 + [(2, "", 0), (3, "", 0), (4, "A title Body of the text. More More ", 37 + 5 * 99_999)]
    assert hx.extract(df.limit(0), model).count() == 0 and hx.train(df.limit(0)).known


def test_query_on_the_table(spark, sf_dir):
    """The text of the element that marks the article, markup and character references by other means."""

    def want(page):
        inside = re.search(r"<article>(.*?)(</article>|<footer)", page, re.S).group(1)
        return " ".join(html.unescape(re.sub(r"<[^<>]*>", "", re.sub(r"<(p|/p|br|h1|/h1)>", " ", inside))).split())

    pages = {r.page_id: (r.url, want(r.html)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = queries.op11_html_extraction(spark, sf_dir)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: (r.url, r.text) for r in out.collect()} == pages and all(r.n_chars == len(r.text) for r in out.collect())
