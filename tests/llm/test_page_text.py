import html
import random
import re

import pytest

from phrasedex.llm import dom
from phrasedex.llm import page_text as X

WORDS = "river stone under morning people water light house winter garden letter summer table paper".split()


def blocks(text):
    return [t for _, t, _ in dom.parse(text)[1]]


def test_blocks_of_broken_pages():
    assert blocks("<p>a  b\n c<p>d<br>e<b>f</b><div>g</div>h") == ["a b c", "d ef", "g", "h"]
    assert blocks('<script>var t="</p>";</script><style>p{}</style>x &amp; y&nbsp;&#233;&lt;b&gt;<!-- no -->z') == ["x & y é<b>z"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("a < b and c > d") == ["a < b and c > d"]
    assert blocks("<p>cut <a href='x") == ["cut"] and blocks("<p>cut<!-- open") == ["cut"] and blocks("<script>x") == []
    assert blocks("<select><option>a<option>b</select><p>t<button>no</button>u<svg><text>n</text></svg></p></i></div>") == ["tu"]
    assert blocks('<p>a <span class="ad">buy</span>b <span hidden>x<span>y</span></span>c</p>') == ["a b c"]
    assert blocks('<P CLASS=x>a</P><A HREF="q>r">l</A>') == ["a", "l"] and blocks("") == []
    _, found = dom.parse("<p>see <a href=x>this one</a></p>")
    assert [(t, n) for _, t, n in found] == [("see this one", 8)]


def test_deep_and_long_pages():
    deep = "<div>" * 300 + "x" + "</div>" * 200
    assert blocks(deep) == ["x"] and dom.size_of(dom.loads(dom.dumps(dom.as_template(dom.parse(deep)[0])))) == 301
    assert len(blocks("<p>word</p>" * 20_000)) == 20_000
    wide = dom.as_template(dom.parse("<p>word</p>" * 20_000)[0])
    assert dom.size_of(wide) == 2 and wide.kids[0].repeated


def random_tree(rng, depth=3):
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return dom.Node("div", rng.choice("abc"), kids)


def by_definition(a, b):
    """Most matched nodes over every way to pair children in order."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        both = by_definition(x[0], y[0])
        return max(best(x[1:], y), best(x, y[1:]), both + best(x[1:], y[1:]) if both else 0)

    return 1 + best(a.kids, b.kids)


def test_simple_tree_matching():
    rng = random.Random(2)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        assert dom.matching(a, b) == by_definition(a, b)
        if a.label == b.label:
            both = dom.merge(a, b)
            assert dom.size_of(both) == dom.size_of(a) + dom.size_of(b) - dom.matching(a, b) and both.n == 2
    t = dom.as_template(dom.parse("<div><p>a</div>" * 3)[0])
    assert dom.dumps(dom.loads(dom.dumps(t))) == dom.dumps(t)
    big = dom.as_template(dom.parse("".join(f"<div class=c{chr(97 + i)}>x</div>" for i in range(20)))[0])
    assert dom.size_of(dom.pruned(big, 5)) <= 5


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def site(rng, kind, i):
    """(html, main text) of one page of a site without helpful names, or with many parts beside the article."""
    paras = [sentence(rng, rng.randrange(15, 60)) for _ in range(rng.randrange(2, 7))]
    title = sentence(rng, 5)
    if kind == "plain":
        menu = "".join(f'<div><a href="/{w}">{w}</a></div>' for w in ("start", "news", "about us"))
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paras)
        more = "".join(f'<li><a href="/{k}">{sentence(rng, 6)}</a></li>' for k in range(5))
        page = f"<html><body><div>{menu}</div><div>Welcome to our site, read daily.</div><div><h1>{title}</h1>{body}</div><div><ul>{more}</ul></div><div>All rights kept since 1999</div>"
        return page, "\n".join([title, *paras])
    body = "".join(f"<p>{p}" for p in paras[:1]) + f'<div class="ad-slot">{sentence(rng)}</div>' + "".join(f"<p>{p}</p>" for p in paras[1:])
    said = "".join(f'<li class="comment">{sentence(rng, 40)}</li>' for _ in range(rng.randrange(12)))
    page = (
        f'<body class="no-sidebar"><header><h2>{sentence(rng, 4)}</h2></header><div id="cookie-notice">{sentence(rng)}</div>'
        f'<form id="all"><main><article class="post post-{i}"><header><h1>{title}</h1></header>{body}<p>Thank you for reading this page.</p>'
        f'</article><section class="comments"><ul>{said}</ul></section></main><aside>{sentence(rng, 50)}</aside></form><footer>{sentence(rng)}</footer>'
    )
    return page, "\n".join([title, *paras])


@pytest.mark.parametrize("kind", ["plain", "busy"])
def test_sites_with_and_without_names(spark, kind):
    rng = random.Random(9)
    pages = [(i, f"https://{kind}.example.org/{i}", *site(rng, kind, i)) for i in range(40)]
    # A third of the pages are copies of one page.
    pages += [(100 + i, pages[0][1], pages[0][2], pages[0][3]) for i in range(20)]
    df = spark.createDataFrame([(*p[:3], "h", 1) for p in pages], "page_id long, url string, html string, host string, text int").repartition(7)
    got = {r["page_id"]: r for r in X.extract_text(df).collect()}
    assert {i: got[i]["text"] for i, *_ in pages} == {i: want for i, _, _, want in pages}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_edges(spark):
    rows = [(None, None, None), (1, "nonsense", ""), (1, "nonsense", ""), (2, "http://u:p@A.B:80/x", "<p>only one page &copy; here</p>"), (3, "//a.b", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["host"], r["text"], r["n_chars"]) for r in X.extract_text(df).collect()), key=str)
    assert got == sorted([(None, "", "", 0), (1, "", "", 0), (1, "", "", 0), (2, "a.b", "only one page © here", 20), (3, "a.b", "", 0)], key=str)
    assert X.extract_text(df.limit(0)).count() == 0


def by_article(text):
    """The article element's paragraphs, read with two plain patterns; holds for the given tables only."""
    inner = re.search(r"<article>(.*?)</article>", text, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in X.op13_page_text(spark, sf).collect()}
    assert len(got) == len(pages)
    assert {p["page_id"]: got[p["page_id"]]["text"] for p in pages} == {p["page_id"]: by_article(p["html"]) for p in pages}
    assert {p["url"] for p in pages} == {r["url"] for r in got.values()}
