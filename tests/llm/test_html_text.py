import html
import random
import re

import pyarrow.parquet as pq

from ownergraph.llm import html_text
from ownergraph.llm.html_text import density, extract_pages, main_text


def test_every_given_page():
    """Against the pages' own structure: what stands in the article, block by block.  The article's tag tells nothing."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", inner)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
        want = "\n".join(b for b in want if b)
        assert main_text(r["html"]) == want, r["page_id"]
        assert main_text(re.sub(r"(</?)article\b", r"\1div", r["html"])) == want, r["page_id"]


def test_unnamed_link_lists_lose_to_text(monkeypatch):
    links = "<div>" + "".join(f"<div><a href=/{i}>Some long headline of another story number {i}</a></div>" for i in range(30)) + "</div>"
    body = f"<div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>"
    want = "\n".join(["Head", *[LONG.strip()] * 3])
    assert main_text(page(body, links, links)) == want
    rnd = random.Random(1)
    for other in (lambda *a: 1.0, lambda *a: rnd.random(), lambda chars, *a: float(chars)):
        monkeypatch.setattr(html_text, "density", other)
        assert main_text(page(body, links, links)) != want


LONG = "A sentence with quite a few words that says something of weight. " * 4


def page(middle, before="", after=""):
    return f"<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body>{before}{middle}{after}</body></html>"


def test_parts_that_are_no_article():
    noise = (
        "<header><h1>Site</h1><a href=/>home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies on this site to do things.</p></div><aside><p>Side text of some length here.</p></aside>"
        "<form><label>Name</label><input><button>Go</button></form>"
    )
    after = (
        f"<section id=comments><p>First! {LONG}</p></section><div class='ad banner'>Buy now</div><footer><p>Imprint and so on.</p></footer>"
        "<script>var x = '<p>no</p>';</script><!-- <p>no</p> -->"
    )
    body = f"<div class=wrap><div id=content><h2>Title &amp; more</h2><p>{LONG}</p><p>Two&nbsp;\n words <b>in</b> <a href=x>a link</a>.</p><ul><li>x1<li>x2</ul><p>{LONG}</div></div>"
    want = ["Title & more", LONG.strip(), "Two words in a link.", "x1", "x2", LONG.strip()]
    assert main_text(page(body, noise, after)) == "\n".join(want)
    assert main_text(page(f"<article><header><h1>T</h1><p>by me</p></header><p>{LONG}</p><div class=share-box>Share</div></article>", noise, after)) == f"T\n{LONG.strip()}"


def test_heading_beside_the_best_block():
    body = f"<div><h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div><div><a href=1>Link list one</a> <a href=2>two</a></div></div>"
    assert main_text(page(body)) == f"Head\n{LONG.strip()}\n{LONG.strip()}"


def test_broken_and_odd():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<nav>x</nav>") == ""
    assert main_text("just &lt;text&gt; &copy no tags") == "just <text> © no tags"
    assert main_text("<p>a<p>b<b>c<p>d") == "a\nbc\nd"
    assert main_text("<p>a <!-- open <p>b") == "a"
    assert main_text("<p title=\"x > y\" data='<p>'>a</p><p>1 < 2</p>") == "a\n1 < 2"
    assert main_text("<div><p>" + "x" * 300000 + "<a href='unclosed>y</a></div>").startswith("x" * 1000)
    assert main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert main_text("<p " + "'" * 5000) == ""


def test_density_prefers_text_to_links():
    assert density(400, 2, 0, 0, 0.1) > density(400, 40, 380, 38, 0.1) >= 0
    assert density(0, 3, 0, 0, 0.0) == 0.0


def test_operator(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>Ä b</p>"), (3, "u", "<p>Ä b</p>"), (None, "v", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "Ä b", 3), (3, "Ä b", 3)]
    assert extract_pages(df.limit(0)).count() == 0
