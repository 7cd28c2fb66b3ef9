import html as entities
import itertools
import re

import numpy as np
import pytest

from quotelab.llm import html_content as H
from quotelab.llm import page_samples
from quotelab.llm import queries as Q
from quotelab.llm.html_dom import Page

PAGE = "page_id long, url string, html string, text string, n_chars long, key string"


@pytest.fixture(scope="module")
def model():
    return Q.page_model()


def _article(page):
    """The whole text of the article element of pages that have one."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", inner)
    return " ".join(" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x)) for x in parts).split())


def test_query_equals_whole_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.op12_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want := _article(pages[r.page_id].html), len(want))


def test_unseen_layouts(model):
    pages = page_samples.labelled_pages(500, seed=77)
    got = model.extract([p for p, _ in pages])
    assert sum(g == main for g, (_, main) in zip(got, pages, strict=True)) / len(pages) >= 0.9


def test_handwritten_pages(model):
    text = "It rained for the whole of the first day, and nobody went out. On the second it was dry. "
    body = f"<h1>Rain &amp; sun</h1><p>{text * 2}</p><p>{text}<br>Then&nbsp;\n <em>it</em> st<b>opp</b>ed.</p><ul><li>wet<li>dry</ul><p>Yes.</p>"
    main = f"Rain & sun {text * 2}{text}Then it stopped. wet dry Yes."
    main = " ".join(main.split())
    other = ('<header><a href="/">Site</a><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav></header>', '<div class="cookie-notice">We use cookies. Accept them all.</div>',
             '<aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>One thing</a><li><a href=/y>Other thing</a></ul></aside>',
             '<form class="search"><label>Find</label><input name=q><button>Go</button></form>')
    after = ('<section id="comments"><h3>Comments</h3><div class="comment"><div class=author>Ann</div><p>I saw it too, it was a lot of rain.</p></div></section>',
             '<div class="ad">Buy an umbrella now. They are cheap.</div>', "<footer>&copy; 2020 Site &middot; All rights reserved</footer></body></html>")
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><article>', "</article></div>")):
        page = "<!DOCTYPE html><html><head><title>x</title><script>if (a<b) t='<p>no</p>'</script></head><body>" + "".join(other) + start + body + end + "".join(after)
        assert model.extract([page, page.upper().replace("&AMP;", "&amp;").replace("&NBSP;", "&nbsp;"), ""])[::2] == [main, ""]


def test_marginals_equal_enumeration():
    """Sums over all labellings of small trees."""
    rng = np.random.default_rng(2)
    forest = H.Forest(["<div>a<p>b<p>c</div>d", "<ul><li>x<li>y<div>z</div></ul>", "", "<nav>q</nav>w"])
    n = len(forest.parent)
    unary, edges = rng.normal(size=(n, 2)), rng.normal(size=(n, 2, 2))
    nodes, pairs, whole = H.sum_product(forest, unary, edges)
    root = np.arange(n)
    for _ in range(n):
        root = np.where(forest.parent[root] >= 0, forest.parent[root], root)
    for r in set(root.tolist()):
        members = np.flatnonzero(root == r).tolist()
        total, one, two = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=len(members)):
            label = dict(zip(members, y, strict=True))
            w = np.exp(sum(unary[k, label[k]] for k in members) + sum(edges[k, label[forest.parent[k]], label[k]] for k in members if k != r))
            total += w
            for k in members:
                one[k, label[k]] += w
                if k != r:
                    two[k, label[forest.parent[k]], label[k]] += w
        assert np.allclose(nodes[members], one[members] / total) and np.allclose(pairs[members], two[members] / total)
        assert np.allclose(whole[members], np.log(total))


def test_fit_learns_what_binds_neighbours():
    """Text alone says nothing here; only its parent does."""
    pages = [f"<div class={'good' if k % 2 else 'bad'}><p>{w} same words</p></div>" * (1 + k % 3) for k, w in enumerate("abcdefgh")]
    mains = [" ".join([f"{w} same words"] * (1 + k % 3)) if k % 2 else "" for k, w in enumerate("abcdefgh")]
    assert H.fit(pages, mains).extract(pages) == mains


def test_tree():
    page = Page("<p>a &lt;b&gt; <b>bold<br>x</p><!-- no --><ul><li>1<li>2</ul><script>var t='</p>';</script>tail<table><tr><td>c<td>d<tr><td>e</table><P class='z'>end &amp <a href=x>li\nnk</a")
    runs = [(page.tag[page.parent[k]], page.text[k], page.linked[k]) for k, t in enumerate(page.tag) if t == "#text"]
    assert runs == [("p", "a <b> bold x", 0), ("li", "1", 0), ("li", "2", 0), ("html", "tail", 0), ("td", "c", 0), ("td", "d", 0), ("td", "e", 0), ("p", "end & li nk", 5)]
    assert [page.tag[k] for k in page.parent[1:]].count("tr") == 3
    for odd in ("", "<", "<<p>>", "a<b", "<p", "</p></div>", "<!--", "<a title=\"x>y", "&#x110000; &#0;", "<div>" * 20_000 + "x", "<script>", "<p/ ><br/>z"):
        assert len(Page(odd).tag) == len(Page(odd).parent)


def test_run_labels():
    assert H.run_labels(["The", "x", "The day", "The", "end"], "The day The end") == [False, False, True, True, True]
    assert H.run_labels(["a", "b"], "") == [False, False]
    assert H.run_labels(["a", "b", "c"], "a c d") == [True, False, True]


def test_odd_rows(spark, model, tmp_path):
    good = "<article><h1>Head line</h1><p>Some words, and more of them. " + "Again. " * 30 + "</p></article>"
    rows = [(1, "u", good), (1, "u", good), (None, None, good), (2, "u", None), (3, "u", ""), (4, "u", "<nav><a href=x>x</a></nav>"), (5, "u", good.replace("</p>", "</p><p>More text of the page. " + "w " * 600_000 + "</p>"))]
    spark.createDataFrame([(*r, "t", 1, "k") for r in rows], PAGE).write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.n_chars): r for r in Q.op12_html_extraction(spark, str(tmp_path)).collect()}
    assert {k for k, _ in got} == {1, None, 2, 3, 4, 5}
    main = ("Head line Some words, and more of them. " + "Again. " * 30).strip()
    assert got[1, len(main)].text == got[None, len(main)].text == main and {got[k, 0].text for k in (2, 3, 4)} == {""}
    assert (5, len(main) + 1 + len("More text of the page. ") + 1_200_000 - 1) in got
    trained = H.train(spark.createDataFrame([(good, main, 1), (None, "x", 2), (good, None, 3)], "html string, main string, text int"))
    assert trained.extract([good]) == [main]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGE).write.parquet(f"{tmp_path}/pages.parquet")
    assert Q.op12_html_extraction(spark, str(tmp_path)).count() == 0
